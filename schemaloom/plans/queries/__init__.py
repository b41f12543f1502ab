"""Importing this package registers every query."""

from . import checks, graph, metadata, names, scalars, scripts  # noqa: F401
