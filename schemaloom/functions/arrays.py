"""Array, map and JSON helpers for declared tests and constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, clean_scalar, first_text, json_text_list, string_list, test_name


# Step between positions inside nested lists: the outer place times this, plus the inner one. Outer places are below
# 2^33, so the sum is below 2^60; a list of 2^24 tests or constraints on one column does not fit into a row.
NESTED = 1 << 24


def _none() -> Column:
    return F.array().cast("array<string>")


def as_array(value, many=None) -> Column:
    """A list stays, a single value becomes a list of one, a missing one an empty list."""
    value = as_col(value)
    single = F.when(value.isNotNull() & (value != ""), F.array(value))
    return F.coalesce(*([as_col(many)] if many is not None else []), single, _none())


def json_items(text) -> Column:
    """Items of a JSON list given as text; a single value is a list of one, null an empty list."""
    text = as_col(text)
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), _none())).otherwise(as_array(text))


def merge_test_args(kwargs, key: str) -> Column:
    """Argument of a declared test; nested ``arguments`` win over the top level."""
    kwargs = as_col(kwargs)
    return F.coalesce(F.get_json_object(kwargs, f"$.arguments.{key}"), F.get_json_object(kwargs, f"$.{key}"))


def parse_yaml_test(item) -> Column:
    """A test item: plain name, or JSON text of a one-key object -> struct(name, args)."""
    item = as_col(item)
    entry = F.element_at(F.map_entries(F.from_json(item, "map<string,string>")), 1)
    is_object = item.startswith("{")
    return F.struct(
        F.when(is_object, test_name(entry["key"])).otherwise(test_name(item)).alias("name"),
        F.when(is_object & entry["value"].startswith("{"), entry["value"]).otherwise(F.lit("{}")).alias("args"),
    )


def first_column(columns) -> Column:
    return F.coalesce(F.try_element_at(as_col(columns), F.lit(1)), F.lit(""))


def constraint_columns(owner, columns, column_names, column_name, column) -> Column:
    """Owning column, else the first declared list among four spellings (JSON text)."""
    owner = F.coalesce(as_col(owner), F.lit(""))
    listed = F.coalesce(as_col(columns), as_col(column_names), as_col(column_name), as_col(column))
    return F.when(owner != "", F.array(owner)).otherwise(string_list(json_text_list(listed)))


def columns_from_map(columns) -> Column:
    """Map of column objects -> array of (pos, name, type); the key stands in for a missing name."""
    entries = F.map_entries(as_col(columns))
    rows = F.transform(entries, lambda e, i: F.struct(
        i.cast("bigint").alias("pos"),
        first_text(e["value"]["name"], e["key"]).alias("name"),
        first_text(e["value"]["data_type"], e["value"]["type"], e["value"]["dtype"]).alias("type")))
    return F.filter(F.coalesce(rows, F.array().cast("array<struct<pos:bigint,name:string,type:string>>")),
                    lambda r: r["name"] != "")

