"""Links between columns: inferred from names, and edited by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fk_stem, singular_key


def _pair_key(a_key, a_col, b_key, b_col) -> Column:
    """The same value for a link and its reverse."""
    def end(key, col):
        return F.struct(F.lower(key).alias("k"), F.lower(col).alias("c"))
    a, b = end(a_key, a_col), end(b_key, b_col)
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def links_by_key_name(columns: DataFrame) -> DataFrame:
    """Rule 1: a plain column named like the key column of exactly one other table.

    Key columns are folded per name first. A name that several tables use as key (``id``) keeps one
    row there and matches nobody, so it never pairs its owners with its users.
    """
    per_table = (columns.where("pk").groupBy("project", "table_key", F.lower("name").alias("name_key"))
                 .agg(F.count(F.lit(1)).alias("own")))
    owners = (per_table.groupBy("project", "name_key")
              .agg(F.sum("own").alias("owners"), F.min("table_key").alias("low"), F.max("table_key").alias("high")))
    plain = columns.where(~F.col("pk")).withColumn("name_key", F.lower("name"))
    own = per_table.select("project", "table_key", "name_key", "own")
    joined = (plain.join(owners, ["project", "name_key"])
              .join(own, ["project", "table_key", "name_key"], "left")
              .where(F.col("owners") - F.coalesce("own", F.lit(0)) == 1))
    other = F.when(F.col("low") == F.col("table_key"), F.col("high")).otherwise(F.col("low"))
    return joined.select("project", F.col("table_key").alias("from_key"), F.col("name").alias("from_col"),
                         other.alias("to_key"), F.col("name").alias("to_col"), "ord")


def links_by_table_name(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Rule 2: ``<foo>_id`` / ``<foo>id`` points at the first key column of foo, foos or foes.

    Name forms are turned round: each table name yields the stems that would reach it, and one row
    per stem survives (exact form first, then +s, then +es; the last table of a form wins).
    """
    forms = tables.select(
        "project", "table_key",
        F.explode(F.array(
            F.struct(F.col("table_key").alias("form"), (F.col("ord") * 2).alias("seen")),
            F.struct(singular_key("table_key").alias("form"), (F.col("ord") * 2 + 1).alias("seen")))).alias("f"))
    by_form = forms.groupBy("project", "f.form").agg(F.max_by("table_key", "f.seen").alias("table_key"))
    stems = by_form.select("project", "table_key", F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("form").alias("stem")),
        F.when(F.endswith("form", F.lit("s")), F.struct(
            F.lit(2).alias("rank"), F.regexp_replace("form", r"s\z", "").alias("stem"))),
        F.when(F.endswith("form", F.lit("es")), F.struct(
            F.lit(3).alias("rank"), F.regexp_replace("form", r"es\z", "").alias("stem"))))).alias("s"))
    by_stem = (stems.where(F.col("s").isNotNull() & (F.col("s.stem") != "")).groupBy("project", "s.stem")
               .agg(F.min_by("table_key", "s.rank").alias("to_key")))
    keys = columns.where("pk").groupBy("project", F.col("table_key").alias("to_key")).agg(
        F.min_by("name", "ord").alias("to_col"))
    targets = by_stem.join(keys, ["project", "to_key"])
    plain = columns.where(~F.col("pk")).withColumn("stem", fk_stem("name")).where("stem <> ''")
    return (plain.join(targets, ["project", "stem"]).where(F.col("to_key") != F.col("table_key"))
            .select("project", F.col("table_key").alias("from_key"), F.col("name").alias("from_col"),
                    "to_key", "to_col", "ord"))


def infer_links(columns: DataFrame, tables: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Both rules, rule 1 first, without links that exist already in either direction.

    ``columns``: project, table_key, name, pk, ord (unique within a project). ``tables``: project,
    table_key, ord. ``known``: project, from_key, from_col, to_key, to_col.
    """
    both = links_by_key_name(columns).withColumn("rule", F.lit(1)).unionByName(
        links_by_table_name(columns, tables).withColumn("rule", F.lit(2)))
    best = both.groupBy("project", "from_key", "from_col", "ord").agg(
        F.min_by(F.struct("to_key", "to_col", "rule"), "rule").alias("to")).select(
        "project", "from_key", "from_col", "to.*", "ord")
    return add_links(best, known, "ord")


def add_links(new: DataFrame, known: DataFrame | None, order: str) -> DataFrame:
    """New links that join two different columns and are not there in either direction yet."""
    pair = _pair_key("from_key", "from_col", "to_key", "to_col")
    keyed = new.withColumn("_pair", pair).where(F.col("_pair.a") != F.col("_pair.b"))
    if known is not None:
        keyed = keyed.join(known.select("project", pair.alias("_pair")).distinct(), ["project", "_pair"], "left_anti")
    rest = [c for c in new.columns if c != "project"]
    return (keyed.groupBy("project", "_pair").agg(F.min_by(F.struct(*rest), order).alias("_row"))
            .select("project", *[f"_row.{c}" for c in rest]))
