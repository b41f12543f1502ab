"""Row predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, first_text, trim_space

# Resource types that are tables.
TABLE_RESOURCE_TYPES = ("model", "seed", "snapshot")


def is_table_resource(resource_type) -> Column:
    return first_text(resource_type).isin(*TABLE_RESOURCE_TYPES)


def is_disabled(enabled, config_enabled) -> Column:
    """Only an explicit false disables; a missing flag means enabled."""
    return as_col(enabled).eqNullSafe(False) | as_col(config_enabled).eqNullSafe(False)


def is_ephemeral(materialized, config_materialized) -> Column:
    return F.lower(first_text(materialized, config_materialized)) == "ephemeral"


def is_skipped(kind, enabled, config_enabled, materialized, config_materialized) -> Column:
    """Disabled objects go; ephemeral ones too, unless they are sources."""
    return is_disabled(enabled, config_enabled) | (
        (as_col(kind) != "source") & is_ephemeral(materialized, config_materialized))


def fuzzy_match(query: str, text) -> Column:
    """Empty query, substring, or the query's characters in order."""
    query = query.lower()
    if not query:
        return F.lit(True)
    text = F.lower(F.coalesce(as_col(text), F.lit("")))
    # [^c]*+c steps to the next c and never looks back, so a miss costs one pass
    in_order = "".join(f"[^{_in_class(c)}]*+{_in_class(c)}" for c in query)
    return F.contains(text, F.lit(query)) | text.rlike(r"\A" + in_order)


def _in_class(char: str) -> str:
    return char if char.isalnum() else re.escape(char) if char.isascii() else f"\\x{{{ord(char):x}}}"


def valid_repo_name(value) -> Column:
    return F.coalesce(as_col(value).rlike(r"\A[\w.-]+/[\w.-]+\z"), F.lit(False))


def valid_branch(value) -> Column:
    text = trim_space(F.coalesce(as_col(value), F.lit("")))
    return text.rlike(r"\A[^\s/~^:?*\\\[][^\s~^:?*\\\[]*\z") & ~text.startswith("-")
