"""Declared constraints and tests folded into column flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import NESTED, constraint_columns, json_items
from ..functions.text import constraint_type, first_text, json_text_list, string_list
from .ordering import order_key

# Order in which a table's columns are first seen.
DECLARED, CATALOG, TESTED, HEADER, CONSTRAINED = 1, 2, 3, 4, 5

FLAGS = ("pk", "nn", "uniq")

CONSTRAINT = ("type string, columns string, column_names string, column_name string, column string, "
              "to string, expression string, references string, to_columns string")


def constraint_rows(table_level: DataFrame, column_level: DataFrame) -> DataFrame:
    """One row per declared constraint.

    Inputs carry project, uid, the JSON text ``constraints`` (a list or a single object) and, at column level,
    ``owner`` and ``pos``. Output: project, uid, type, columns, targets (non-blank texts), to_columns, pos.
    """
    items = F.transform(json_items("constraints"), lambda t: F.from_json(t, CONSTRAINT))
    table_level = table_level.select("project", "uid", F.lit("").alias("owner"), F.lit(0).cast("bigint").alias("pos"),
                                     F.posexplode(items).alias("cpos", "c"))
    column_level = column_level.select("project", "uid", "owner", (F.col("pos") + 1).cast("bigint").alias("pos"),
                                       F.posexplode(items).alias("cpos", "c"))
    c = F.col("c")
    texts = F.array(first_text(c["to"]), first_text(c["expression"]), first_text(c["references"]))
    return (
        table_level.unionByName(column_level).where(c.isNotNull())
        .select(
            "project", "uid", constraint_type(c["type"]).alias("type"),
            constraint_columns("owner", c["columns"], c["column_names"], c["column_name"],
                               c["column"]).alias("columns"),
            F.filter(texts, lambda t: t != "").alias("targets"),
            string_list(json_text_list(c["to_columns"])).alias("to_columns"),
            (F.col("pos") * F.lit(NESTED) + F.col("cpos")).alias("pos"))
        .where(F.size("columns") > 0)
    )


def constraint_flags(constraints: DataFrame) -> DataFrame:
    """Flags per named column: a primary key implies not-null, unique counts only on one column."""
    is_type = F.col("type")
    return constraints.select(
        "project", "uid", F.explode("columns").alias("name"), F.col("pos"),
        (is_type == "primary_key").alias("pk"),
        is_type.isin("primary_key", "not_null").alias("nn"),
        ((is_type == "unique") & (F.size("columns") == 1)).alias("uniq"),
    )


def test_flags(tests: DataFrame) -> DataFrame:
    """unique / not_null tests as flags of the owning table's column, known before or not."""
    return (tests.where(F.col("test").isin("unique", "not_null") & (F.col("column") != ""))
            .select("project", "uid", F.col("column").alias("name"), "pos", F.lit(False).alias("pk"),
                    (F.col("test") == "not_null").alias("nn"), (F.col("test") == "unique").alias("uniq")))


def _part(rows: DataFrame, phase: int) -> DataFrame:
    """Bring declared, catalog or flag rows to one shape."""
    has = set(rows.columns)
    return rows.select(
        "project", "uid", "name",
        (F.col("type") if "type" in has else F.lit("")).alias("type"),
        F.lit(phase).alias("phase"), order_key(F.lit(phase), "pos").alias("at"),
        *[(F.col(f) if f in has else F.lit(False)).alias(f) for f in FLAGS])


def assemble_columns(declared: DataFrame, catalog: DataFrame | None = None, tests: DataFrame | None = None,
                     constraints: DataFrame | None = None, header: DataFrame | None = None) -> DataFrame:
    """All sightings of a column -> one row: project, uid, col_key, name, type, ord, pk, nn, uniq.

    Catalog enrichment, test flags, constraint flags, key inference and column order are one
    aggregate over a union. Full outer joins would say the same with one shuffle per input, and no
    skew handling exists for them.
    """
    parts = [_part(declared, DECLARED)]
    for rows, phase in ((catalog, CATALOG), (tests, TESTED), (header, HEADER),
                        (constraints, CONSTRAINED)):
        if rows is not None:
            parts.append(_part(rows, phase))
    sightings = parts[0]
    for part in parts[1:]:
        sightings = sightings.unionByName(part)
    typed = F.col("type") != ""
    declared_type = F.min_by(F.when(typed & (F.col("phase") == DECLARED), F.col("type")),
                             F.when(typed & (F.col("phase") == DECLARED), F.col("at")))
    catalog_type = F.max_by(F.when(typed & (F.col("phase") == CATALOG), F.col("type")),
                            F.when(typed & (F.col("phase") == CATALOG), F.col("at")))
    return infer_pk(
        sightings.where("name <> ''").groupBy("project", "uid", F.lower("name").alias("col_key"))
        .agg(F.min_by("name", "at").alias("name"), F.coalesce(catalog_type, declared_type, F.lit("")).alias("type"),
             F.min("at").alias("ord"), *[F.bool_or(f).alias(f) for f in FLAGS]))


def enrich_from_catalog(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog types override when not blank; catalog-only columns are appended."""
    return assemble_columns(declared, catalog).select("project", "uid", "col_key", "name", "type", "ord")


def infer_pk(columns: DataFrame) -> DataFrame:
    return columns.withColumn("pk", F.col("pk") | (F.col("uniq") & F.col("nn")))


def default_target_columns(columns: DataFrame, table: list[str]) -> DataFrame:
    """Primary-key columns in order, else the first column, as array ``default_cols``.

    Only key columns are gathered, so the array is as long as the key and not as the table.
    """
    keys = F.array_sort(F.collect_list(F.when(F.col("pk"), F.struct("ord", "name"))))
    return columns.groupBy(*table).agg(keys.alias("_keys"), F.min_by("name", "ord").alias("_first")).select(
        *table, F.when(F.size("_keys") > 0, F.transform("_keys", lambda k: k["name"]))
        .otherwise(F.array("_first")).alias("default_cols"))
