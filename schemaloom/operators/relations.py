"""Edges between tables: from tests, constraints and specs, finished and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_column
from ..functions.text import call_label, clean_scalar, constraint_target, first_text, parse_call
from ..session import cut_lineage
from .constraints import default_target_columns
from .resolve import resolve_calls, resolve_relation, resolve_test_owner

NO_COLUMNS = "array<string>"


def _none():
    return F.array().cast(NO_COLUMNS)


def resolve_tests(tests: DataFrame, entries: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared tests with their owner and, for relationships, the entry their target call names.

    The target is passed over when the owner is looked for. ``columns`` are those known before any
    test is read: project, uid, name. Columns of attached ``unique`` and ``not_null`` tests count for the tests
    behind them.
    """
    is_rel = F.col("test") == "relationships"
    # columns of attached tests, candidates and the result all read the tests with their calls: they are parsed once
    called = cut_lineage(resolve_calls(
        tests.withColumn("call", F.when(is_rel, parse_call("target"))).withColumnRenamed("target", "to_text"),
        entries, "call", "called"))
    early = called.where(F.col("test").isin("unique", "not_null") & (F.col("column") != "") & (F.col("attached") != ""))
    columns = columns.select("project", "uid", "name", F.lit(-1).cast("bigint").alias("since")).unionByName(
        early.select("project", F.col("attached").alias("uid"), F.col("column").alias("name"), F.col("pos").cast("bigint").alias("since")))
    return resolve_test_owner(called.withColumn("excluded", F.col("called.uid")), entries, columns)


def edge_order(origin: int, first, second=None) -> Column:
    """Sortable place of a raw edge: origin, then two positions. Nothing is packed, so no place can overflow."""
    parts = [F.lit(origin), F.col(first), F.lit(0) if second is None else F.col(second)]
    return F.struct(*[p.cast("bigint").alias(n) for p, n in zip(parts, ("origin", "first", "second"), strict=True)])


def fk_from_test(resolved: DataFrame) -> DataFrame:
    """relationships tests -> raw edges. Target: the call, else the other dependency, else the text."""
    to_table = first_text(F.coalesce("called.display_name", "other.display_name"), call_label("call"),
                          clean_scalar("to_text"))
    return (
        resolved.where((F.col("test") == "relationships") & (F.col("column") != "") & F.col("owner").isNotNull())
        .select("project", F.col("owner.display_name").alias("from_table"),
                F.array("column").alias("from_cols"), to_table.alias("to_table"),
                F.when(F.col("field") != "", F.array("field")).otherwise(_none()).alias("to_cols"),
                edge_order(0, "pos").alias("ord"))
        .where("to_table <> ''")
    )


def fk_from_yaml(specs: DataFrame, entries: DataFrame) -> DataFrame:
    """Relationship specs of the schema files -> raw edges; an unresolved target keeps its text.

    Input: project, from_table, column, to_text, field, ord.
    """
    called = resolve_calls(specs.withColumn("call", parse_call("to_text")), entries, "call", "called")
    to_table = first_text("called.display_name", call_label("call"), "to_text")
    return called.select(
        "project", "from_table", F.array("column").alias("from_cols"), to_table.alias("to_table"),
        F.when(F.col("field") != "", F.array("field")).otherwise(_none()).alias("to_cols"), "ord",
    ).where("from_table <> '' and to_table <> ''")


def fk_from_constraint(constraints: DataFrame, entries: DataFrame, columns: DataFrame) -> DataFrame:
    """foreign_key constraints -> raw edges.

    Target columns: explicit, else written behind the target, else the target's key or first column.
    """
    names = entries.select("project", "uid", F.col("display_name").alias("from_table"), F.col("ord").alias("_entry"))
    fks = constraints.where(F.col("type") == "foreign_key").join(names, ["project", "uid"])
    calls = F.filter(F.transform("targets", parse_call), lambda c: c.isNotNull())
    text = F.coalesce(F.get("targets", F.lit(0)), F.lit(""))
    parsed = (fks.withColumn("call", F.get(calls, F.lit(0)))
              .withColumn("raw", F.when(F.col("call").isNull(), constraint_target(text))))
    called = resolve_calls(parsed, entries, "call", "called")
    raw = called.withColumn("raw_relation", F.coalesce("raw.relation", F.lit(""))).withColumn(
        "raw_leaf", F.coalesce("raw.leaf", F.lit("")))
    resolved = resolve_relation(raw, entries, "raw_relation", "raw_leaf", "by_name")
    target = F.coalesce("called", "by_name")
    defaults = default_target_columns(columns, ["project", "uid"]).withColumnRenamed("uid", "target_uid")
    joined = resolved.withColumn("target_uid", target["uid"]).withColumn("target_name", target["display_name"]).join(
        defaults, ["project", "target_uid"], "left")
    to_table = F.coalesce(F.nullif(F.coalesce("target_name", F.lit("")), F.lit("")),
                          F.nullif(call_label("call"), F.lit("")), F.nullif("raw_relation", F.lit("")), "raw_leaf")
    to_cols = (F.when(F.size("to_columns") > 0, F.col("to_columns"))
               .when(F.size("raw.columns") > 0, F.col("raw.columns"))
               .otherwise(F.coalesce("default_cols", _none())))
    return joined.select(
        "project", "from_table", F.col("columns").alias("from_cols"), to_table.alias("to_table"),
        to_cols.alias("to_cols"),
        # behind every test edge, then by table and place in the table
        edge_order(1, "_entry", "pos").alias("ord"),
    ).where("from_table <> '' and to_table <> ''")


def union_edges(*edges: DataFrame) -> DataFrame:
    """Edges of several origins in one frame; columns one side lacks become null."""
    rows = edges[0]
    for more in edges[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def with_manual_links(relations: DataFrame, links: DataFrame) -> DataFrame:
    """Drawn edges: relations reduced to their first columns, and links flagged manual."""
    drawn = relations.select(
        "project", F.lower("from_table").alias("from_key"), first_column("from_cols").alias("from_col"),
        F.lower("to_table").alias("to_key"), first_column("to_cols").alias("to_col"), F.lit(False).alias("manual"))
    return drawn.unionByName(links.select("project", "from_key", "from_col", "to_key", "to_col",
                                          F.lit(True).alias("manual")))


def finalize_relations(raw: DataFrame, tables: DataFrame, dedup: bool = True) -> DataFrame:
    """Known from-side required, unknown to-side kept as text, duplicates dropped, first one kept.

    ``raw``: project, from_table, from_cols, to_table, to_cols, ord. ``tables``: project, name.
    """
    keyed = raw.withColumn("from_key", F.lower("from_table")).withColumn("to_key", F.lower("to_table"))
    if dedup:
        keyed = distinct_edges(keyed, ["project", "from_key", F.concat_ws(",", "from_cols").alias("_fc"), "to_key",
                                       F.concat_ws(",", "to_cols").alias("_tc")], "ord")
    names = tables.groupBy("project", F.lower("name").alias("key")).agg(F.max("name").alias("known"))
    return (
        keyed.join(names.withColumnRenamed("key", "from_key").withColumnRenamed("known", "_from"),
                   ["project", "from_key"])
        .join(names.withColumnRenamed("key", "to_key").withColumnRenamed("known", "_to"),
              ["project", "to_key"], "left")
        .select("project", F.col("_from").alias("from_table"), "from_cols",
                F.coalesce("_to", "to_table").alias("to_table"), "to_cols",
                F.col("_to").isNull().alias("to_missing"), "ord")
    )


def distinct_edges(edges: DataFrame, keys: list, order: str | None = None) -> DataFrame:
    """One edge per key; with an order the first one stays."""
    names = [k if isinstance(k, str) else None for k in keys]
    if order is None:
        return edges.dropDuplicates([n for n in names if n])
    rest = [c for c in edges.columns if c not in names]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(
        *[f"_row.{c}" if c in rest else c for c in edges.columns])


def mark_fk_columns(columns: DataFrame, relations: DataFrame, tables: DataFrame) -> DataFrame:
    """``fk`` is true for columns named in any outgoing edge of their table."""
    keyed = tables.select("project", "uid", F.lower("name").alias("from_key"))
    named = (relations.select("project", F.lower("from_table").alias("from_key"), F.explode("from_cols").alias("c"))
             .select("project", "from_key", F.lower("c").alias("col_key")).distinct()
             .join(keyed, ["project", "from_key"]).select("project", "uid", "col_key", F.lit(True).alias("_fk"))
             .distinct())
    return columns.join(named, ["project", "uid", "col_key"], "left").withColumn(
        "fk", F.col("_fk").isNotNull()).drop("_fk")


def visible_edges(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges that touch no hidden table."""
    gone = hidden.select("project", F.lower("name").alias("_key")).distinct()
    for side in ("from_table", "to_table"):
        edges = edges.withColumn("_key", F.lower(side)).join(gone, ["project", "_key"], "left_anti").drop("_key")
    return edges


def export_edges(relations: DataFrame, columns_needed: bool = False) -> DataFrame:
    """Edges a text export shows: known target, and both first columns where the format names them."""
    kept = relations.where(~F.col("to_missing"))
    if columns_needed:
        kept = kept.where((first_column("from_cols") != "") & (first_column("to_cols") != ""))
    return kept
