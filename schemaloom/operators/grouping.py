"""Statistics and grouping of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space

# Group dimensions in the order they are offered.
GROUP_MODES = ("domain", "layer", "folder", "schema")
# When a dimension splits the tables usefully.
MIN_GROUPS, MIN_MEMBERS, MAX_SHARE, MIN_ASSIGNED = 2, 2, 0.9, 0.5


def model_stats(tables: DataFrame, columns: DataFrame, relations: DataFrame, scope: list[str]) -> DataFrame:
    """Tables, relations, columns and typed columns per scope, one aggregate over tagged rows."""
    def tagged(rows, t, r, c, typed):
        return rows.select(*scope, *[v.cast("bigint").alias(n) for n, v in (
            ("tables", t), ("relations", r), ("columns", c), ("columns_typed", typed))])

    zero, one = F.lit(0), F.lit(1)
    rows = (tagged(tables, one, zero, zero, zero)
            .unionByName(tagged(relations, zero, one, zero, zero))
            .unionByName(tagged(columns, zero, zero, one, (trim_space("type") != "").cast("int"))))
    names = ("tables", "relations", "columns", "columns_typed")
    return rows.groupBy(*scope).agg(*[F.sum(n).alias(n) for n in names])


def typed_columns(columns: DataFrame, scope: list[str]) -> DataFrame:
    return columns.groupBy(*scope).agg(
        F.count_if(trim_space(F.coalesce("type", F.lit(""))) != "").alias("columns_typed"))


def _sizes(tables: DataFrame, scope: list[str], value: str) -> DataFrame:
    return tables.groupBy(*scope, trim_space(F.coalesce(value, F.lit(""))).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def group_signal(tables: DataFrame, scope: list[str], value: str) -> DataFrame:
    """Does the dimension split the tables into real clusters? Counts first, then the verdict."""
    filled = F.col("value") != ""
    stats = _sizes(tables, scope, value).groupBy(*scope).agg(
        F.count_if(filled).alias("groups"),
        F.count_if(filled & (F.col("n") >= MIN_MEMBERS)).alias("multi"),
        F.coalesce(F.max(F.when(filled, F.col("n"))), F.lit(0)).alias("biggest"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("assigned"),
        F.sum("n").alias("total"))
    verdict = ((F.col("groups") >= MIN_GROUPS) & (F.col("multi") >= MIN_GROUPS)
               & (F.col("biggest") / F.col("total") <= MAX_SHARE)
               & (F.col("assigned") >= F.col("total") * MIN_ASSIGNED))
    return stats.withColumn("signal", verdict)


def available_group_modes(tables: DataFrame, scope: list[str], modes=GROUP_MODES) -> DataFrame:
    """Useful dimensions in their fixed order, with the number of groups."""
    place = F.create_map(*[F.lit(v) for i, m in enumerate(modes) for v in (m, i)])
    long = tables.select(*scope, F.explode(F.create_map(
        *[c for m in modes for c in (F.lit(m), F.coalesce(F.col(m), F.lit("")))])).alias("mode", "value"))
    return (group_signal(long, [*scope, "mode"], "value").where("signal")
            .select(*scope, "mode", place[F.col("mode")].cast("bigint").alias("place"), F.col("groups"))
            .orderBy(*scope, "place"))


def apply_group(tables: DataFrame, scope: list[str], value: str | None, into: str = "group") -> DataFrame:
    """Keep a value as group only with two members or more; no dimension clears every group."""
    if value is None or value == "none":
        return tables.withColumn(into, F.lit(""))
    keyed = tables.withColumn("value", trim_space(F.coalesce(value, F.lit(""))))
    big = _sizes(tables, scope, value).where((F.col("value") != "") & (F.col("n") >= MIN_MEMBERS)).drop("n")
    return (keyed.join(big.withColumn("_big", F.lit(True)), [*scope, "value"], "left")
            .withColumn(into, F.when(F.col("_big"), F.col("value")).otherwise("")).drop("value", "_big"))


def group_extent(rows: DataFrame, scope: list[str], bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """Smallest low and largest high per group for each axis: name -> (low, high)."""
    return rows.groupBy(*scope).agg(*[
        agg for axis, (low, high) in bounds.items()
        for agg in (F.min(low).alias(f"{axis}_min"), F.max(high).alias(f"{axis}_max"))])


def mode_choice(stats: DataFrame, scope: list[str]) -> DataFrame:
    """Modes with edges, richest first (ERD on ties); a scope without edges keeps its bare ERD.

    ``stats``: scope, mode ('erd' / 'lineage'), tables, relations. Output adds rank and label.
    """
    fields = ("mode", "tables", "relations")
    per_scope = stats.groupBy(*scope).agg(*[
        F.max(F.when(F.col("mode") == mode, F.struct(*fields))).alias(mode) for mode in ("erd", "lineage")])
    erd, lineage = F.col("erd"), F.col("lineage")
    have_erd, have_lineage = erd["relations"] > 0, lineage["relations"] > 0
    lineage_first = lineage["relations"] > erd["relations"]
    chosen = (F.when(have_erd & have_lineage, F.when(lineage_first, F.array(lineage, erd)).otherwise(
                  F.array(erd, lineage)))
              .when(have_lineage, F.array(lineage)).otherwise(F.array(erd)))
    label = (F.when(F.col("c.relations") == 0, "tables only")
             .when(F.col("c.mode") == "lineage", "ref/source edges").otherwise("FK relations"))
    return per_scope.select(*scope, F.posexplode(chosen).alias("rank", "c")).select(
        *scope, F.col("rank").cast("bigint").alias("rank"), "c.*", label.alias("label"))


def visibility_counts(tables: DataFrame, scope: list[str], matches, hidden) -> DataFrame:
    """Tables that match the filter, all tables, hidden ones, and shown ones among the matches."""
    return tables.groupBy(*scope).agg(
        F.count_if(matches).alias("matched"), F.count(F.lit(1)).alias("total"),
        F.count_if(hidden).alias("hidden"), F.count_if(matches & ~hidden).alias("shown"))

