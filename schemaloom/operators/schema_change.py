"""Renames, retypes, added columns, version differences and carried-over attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import dialect_default
from .ordering import next_free_name


def rename_tables(tables: DataFrame, changes: DataFrame, key: str = "table_key") -> DataFrame:
    """``changes``: project, key, new_name (one row per key)."""
    c = changes.select("project", F.col("key").alias(key), "new_name")
    return (tables.join(c, ["project", key], "left")
            .withColumn("name", F.coalesce("new_name", "name")).withColumn(key, F.lower("name")).drop("new_name"))


def rename_cascade(tables: DataFrame, relations: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A renamed table takes every edge that leaves it or points at it along."""
    for side in ("from_table", "to_table"):
        c = changes.select("project", F.col("key").alias("_key"), F.col("new_name").alias("_new"))
        relations = (relations.withColumn("_key", F.lower(side)).join(c, ["project", "_key"], "left")
                     .withColumn(side, F.coalesce("_new", side)).drop("_key", "_new"))
    return rename_tables(tables, changes), relations


def rename_column(columns: DataFrame, relations: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A renamed column changes in its own table and that table's own key lists.

    Lists of other tables that point at it stay as written. ``changes``: project, table_key,
    old_name, new_name. Relations need a unique ``ord`` per project.
    """
    c = changes.select("project", "table_key", F.col("old_name").alias("name"), "new_name")
    renamed = (columns.join(c, ["project", "table_key", "name"], "left")
               .withColumn("name", F.coalesce("new_name", "name")).drop("new_name"))
    keyed = changes.select("project", "table_key", F.lower("old_name").alias("col_key"), "new_name")
    # only lists that hold a renamed column are taken apart; the others pass by untouched
    items = relations.select("project", "ord", F.lower("from_table").alias("table_key"),
                             F.posexplode("from_cols").alias("pos", "col")).withColumn("col_key", F.lower("col"))
    hits = (items.join(keyed, ["project", "table_key", "col_key"])
            .groupBy("project", "ord").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new_name"))).alias("_new")))
    lists = (relations.join(hits, ["project", "ord"], "left")
             .withColumn("from_cols", F.when(F.col("_new").isNull(), F.col("from_cols")).otherwise(
                 F.transform("from_cols", lambda x, i: F.coalesce(F.col("_new")[i], x))))
             .drop("_new"))
    return renamed, lists


def retype_column(columns: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: project, table_key, name, new_type."""
    return (columns.join(changes, ["project", "table_key", "name"], "left")
            .withColumn("type", F.coalesce("new_type", "type")).drop("new_type"))


def schema_diff(old: DataFrame, new: DataFrame, scope: list[str], key: str = "table_key") -> DataFrame:
    """Key sets of two versions: added, dropped or kept. A tagged union, so no outer join can skew."""
    tagged = (old.select(*scope, key, F.lit(True).alias("_old"), F.lit(False).alias("_new"))
              .unionByName(new.select(*scope, key, F.lit(False).alias("_old"), F.lit(True).alias("_new"))))
    both = tagged.groupBy(*scope, key).agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
    status = F.when(F.col("_old") & F.col("_new"), "kept").when(F.col("_new"), "added").otherwise("dropped")
    return both.select(*scope, key, status.alias("status"))


def new_tables(diff: DataFrame) -> DataFrame:
    return diff.where("status = 'added'").drop("status")


def structure_changed(diff: DataFrame, scope: list[str]) -> DataFrame:
    return diff.groupBy(*scope).agg(F.bool_or(F.col("status") != "kept").alias("changed"))


def hidden_set_update(hidden: DataFrame, keys: DataFrame, hide: bool) -> DataFrame:
    """Hidden set after adding or removing the keys."""
    if hide:
        return hidden.unionByName(keys.select(*hidden.columns)).distinct()
    return hidden.distinct().join(keys, hidden.columns, "left_anti")


def hidden_set_changes(hidden: DataFrame, keys: DataFrame, hide: bool) -> DataFrame:
    """Keys whose state the update really changes; no rows mean no change."""
    return keys.select(*hidden.columns).distinct().join(
        hidden, hidden.columns, "left_anti" if hide else "left_semi")


def restore_attributes(tables: DataFrame, saved: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Carry saved attributes to tables with the same key; ``restored`` tells which got them.

    ``saved`` holds one row per key. A row counts only when its first attribute is set.
    """
    s = saved.where(F.col(attributes[0]).isNotNull()).select(
        *keys, *[F.col(a).alias(f"_{a}") for a in attributes], F.lit(True).alias("restored"))
    joined = tables.join(s, keys, "left").withColumn("restored", F.coalesce("restored", F.lit(False)))
    for a in attributes:
        kept = F.col(a) if a in tables.columns else F.lit(None)
        joined = joined.withColumn(a, F.coalesce(F.col(f"_{a}"), kept)).drop(f"_{a}")
    return joined


def keep_listed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose name is in a found set."""
    return rows.join(names.select(key), key, "left_semi")


def add_column(columns: DataFrame, tables: DataFrame, table: list[str], dialect: str) -> DataFrame:
    """Append one column per listed table: a free name, the dialect's default type, last place."""
    listed = tables.select(*table).distinct()
    names = next_free_name(columns.join(listed, table, "left_semi"), listed, table)
    last = columns.groupBy(*table).agg(F.max("ord").alias("_last"))
    fresh = names.join(last, table, "left").select(
        *table, F.col("free_name").alias("name"), dialect_default(F.lit(dialect)).alias("type"),
        (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("ord"))
    return columns.unionByName(fresh, allowMissingColumns=True)
