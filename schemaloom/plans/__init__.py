"""Whole pipelines built from the operators, and the registered queries."""
