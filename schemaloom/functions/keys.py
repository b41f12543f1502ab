"""Candidate grouping keys of a table: business domain, layer, folder and schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, first_text

# Name prefixes that mark a layer, not a business domain.
LAYER_PREFIXES = (
    "stg", "staging", "int", "intermediate", "fct", "fact", "dim", "mart", "marts", "rpt", "agg",
    "dwh", "dw", "base", "src", "source", "raw", "snap", "snapshot", "seed", "ref", "final", "tmp", "temp",
)
# Kinds that are a layer of their own, strongest first.
KIND_LAYERS = ("source", "seed", "snapshot")


def _first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"\A[_.]*([^_.]+)", 1)


def _is_kind(kind, resource_type, wanted: str) -> Column:
    return (F.lower(first_text(resource_type)) == wanted) | (F.lower(first_text(kind)) == wanted)


def domain_key(kind, resource_type, source_name, ref_name, name, base_name) -> Column:
    prefix = r"\A(?:(?:" + "|".join(LAYER_PREFIXES) + r")[_.])+"
    token = _first_token(F.regexp_replace(F.lower(first_text(ref_name, name, base_name)), prefix, ""))
    source = F.lower(first_text(source_name))
    return (
        F.when(_is_kind(kind, resource_type, "source") & (source != ""), _first_token(source))
        .when(token != "", token)
        .otherwise(_first_token(F.lower(first_text(ref_name, name))))
    )


def path_segments(path_qualifier, original_file_path, path) -> Column:
    """Folder names of a model; a bare file path loses its file name first."""
    folder = first_text(path_qualifier)
    file = F.replace(first_text(original_file_path, path), F.lit("\\"), F.lit("/"))
    file = F.when(F.contains(file, F.lit("/")), F.regexp_replace(file, r"/[^/]*\z", "")).otherwise("")
    text = F.replace(F.when(folder != "", folder).otherwise(file), F.lit("\\"), F.lit("/"))
    return F.filter(F.split(text, "/"), lambda x: x != "")


def layer_key(kind, resource_type, segments, name) -> Column:
    segments, name = as_col(segments), F.lower(first_text(name))
    layer = F.when(_is_kind(kind, resource_type, KIND_LAYERS[0]), KIND_LAYERS[0])
    for winner in KIND_LAYERS[1:]:
        layer = layer.when(_is_kind(kind, resource_type, winner), winner)
    return (
        layer.when(F.size(segments) >= 2, F.try_element_at(segments, F.lit(2)))
        .when(name.rlike(r"\Astg_|\Astaging[_.]"), "staging")
        .when(name.rlike(r"\Aint_|\Aintermediate[_.]"), "intermediate")
        .when(name.rlike(r"\A(fct|dim|mart|rpt|agg|fact)_"), "marts")
        .otherwise("")
    )


def folder_key(segments) -> Column:
    segments = as_col(segments)
    return F.array_join(F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(1))), "/")


def schema_key(schema) -> Column:
    return F.lower(first_text(schema))


def build_group_keys(kind, resource_type, source_name, ref_name, name, base_name, schema,
                     path_qualifier, original_file_path, path) -> Column:
    segments = path_segments(path_qualifier, original_file_path, path)
    layer_name = F.when(F.coalesce(as_col(ref_name), F.lit("")) != "", as_col(ref_name)).otherwise(as_col(name))
    return F.struct(
        domain_key(kind, resource_type, source_name, ref_name, name, base_name).alias("domain"),
        layer_key(kind, resource_type, segments, layer_name).alias("layer"),
        folder_key(segments).alias("folder"),
        schema_key(schema).alias("schema"),
    )
