"""Name resolution: exactly one match or nothing.

No resolver pairs references with entries. Entries are first folded into one row per key with its
number of owners (combined before the shuffle), keys with more than one owner are dropped, and
references join that table of unique keys. The result keeps one row per reference whatever the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, first_text, normalize_relation, relation_leaf
from ..session import cut_lineage

TARGET = "struct<uid:string, display_name:string>"


def _target() -> Column:
    return F.struct("uid", "display_name")


def _single_owner(keys: DataFrame, by: list[str]) -> DataFrame:
    return (keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("target"))
            .where("_n = 1").drop("_n"))


def call_lookup(entries: DataFrame) -> DataFrame:
    """Unique (project, call_kind, qualifier, call_name) -> target, for refs and sources at once."""
    name, package = F.lower("ref_name"), F.lower("package")

    def key(kind, qualifier):
        return F.struct(F.lit(kind).alias("call_kind"), qualifier.alias("qualifier"), name.alias("call_name"))

    keys = F.when(F.col("kind") == "source", F.array(key("source", F.lower("source_name")))) \
        .otherwise(F.array_distinct(F.array(key("ref", F.lit("")), key("ref", package))))
    exploded = entries.select("project", _target().alias("target"), F.explode(keys).alias("k")).select(
        "project", "target", "k.*").where(F.col("call_name") != "")
    exploded = exploded.where((F.col("call_kind") == "ref") | (F.col("qualifier") != ""))
    return _single_owner(exploded, ["project", "call_kind", "qualifier", "call_name"])


def resolve_calls(rows: DataFrame, entries: DataFrame, call: str = "call", into: str = "target") -> DataFrame:
    """Attach the entry a parsed call names, null when none or several fit."""
    c = as_col(call)
    lookup = call_lookup(entries).withColumnRenamed("target", into)
    qualifier = F.lower(first_text(F.when(c["kind"] == "source", c["source_name"]).otherwise(c["package"])))
    keyed = (rows.withColumn("call_kind", c["kind"]).withColumn("qualifier", qualifier)
             .withColumn("call_name", F.lower(first_text(c["name"]))))
    return (keyed.join(lookup, ["project", "call_kind", "qualifier", "call_name"], "left")
            .drop("call_kind", "qualifier", "call_name"))


def resolve_ref(rows: DataFrame, entries: DataFrame, name: str, package: str | None = None,
                into: str = "target") -> DataFrame:
    call = F.struct(F.lit("ref").alias("kind"), F.lit("").alias("source_name"),
                    (F.col(package) if package else F.lit("")).alias("package"), F.col(name).alias("name"))
    return resolve_calls(rows.withColumn("_call", call), entries, "_call", into).drop("_call")


def resolve_source(rows: DataFrame, entries: DataFrame, source_name: str, name: str,
                   into: str = "target") -> DataFrame:
    call = F.struct(F.lit("source").alias("kind"), F.col(source_name).alias("source_name"),
                    F.lit("").alias("package"), F.col(name).alias("name"))
    return resolve_calls(rows.withColumn("_call", call), entries, "_call", into).drop("_call")


def leaf_lookup(entries: DataFrame) -> DataFrame:
    """Unique (project, leaf) over ref name, name and the leaf of the rendered relation."""
    names = F.array_distinct(F.filter(
        F.array(F.lower("ref_name"), F.lower("name"), F.lower(relation_leaf("relation_name"))), lambda x: x != ""))
    exploded = entries.select("project", _target().alias("target"), F.explode(names).alias("leaf_key"))
    return _single_owner(exploded, ["project", "leaf_key"])


def resolve_leaf(rows: DataFrame, entries: DataFrame, leaf: str, into: str = "target") -> DataFrame:
    keyed = rows.withColumn("leaf_key", F.lower(relation_leaf(leaf)))
    lookup = leaf_lookup(entries).withColumnRenamed("target", into)
    return keyed.join(lookup, ["project", "leaf_key"], "left").drop("leaf_key")


def _relation_keys(entries: DataFrame) -> DataFrame:
    """(project, needle, schema_key, database_key) -> owners and one of them.

    A reference's leftover qualifiers may rule an owner out by schema or database. Owners are
    counted per (needle, schema, database) and, with '*', per coarser combination, so the check is
    an equality too and no owner list is ever built.
    """
    db, schema = F.lower(first_text("database")), F.lower(first_text("schema"))
    rel = normalize_relation("relation_name")
    rel_parts = F.split(rel, r"\.")

    def spelled(name: Column) -> list[Column]:
        some = name != ""
        return [
            F.when(some, name),
            F.when(some & (schema != ""), F.concat_ws(".", schema, name)),
            F.when(some & (schema != "") & (db != ""), F.concat_ws(".", db, schema, name)),
        ]

    needles = F.array(
        *spelled(F.lower("ref_name")), *spelled(F.lower("name")),
        F.lower(first_text("display_name")), rel,
        F.when(rel != "", F.element_at(rel_parts, -1)),
        F.when(F.size(rel_parts) >= 2, F.array_join(F.slice(rel_parts, -2, 2), ".")))
    needles = F.array_distinct(F.filter(needles, lambda x: x.isNotNull() & (x != "")))
    star = F.lit("*")
    views = F.array(*[F.struct(s.alias("schema_key"), d.alias("database_key"))
                      for s, d in ((star, star), (schema, star), (star, db), (schema, db))])
    return (
        entries.select("project", _target().alias("target"), F.explode(needles).alias("needle"), views.alias("v"))
        .select("project", "target", "needle", F.explode("v").alias("v"))
        .select("project", "target", "needle", "v.*")
        .groupBy("project", "needle", "schema_key", "database_key")
        .agg(F.count(F.lit(1)).alias("owners"), F.min("target").alias("target"))
    )


def resolve_relation(rows: DataFrame, entries: DataFrame, relation: str, leaf: str | None = None,
                     into: str = "target") -> DataFrame:
    """Longest dotted suffix with one owner whose schema and database do not contradict the rest.

    An unqualified name that finds none falls back to the leaf rule. Distinct texts are resolved
    once and joined back, so a reference repeated by half the fleet costs one lookup.
    """
    leaf_text = F.col(leaf) if leaf else F.lit("")
    # the texts and the result read the rows, suffixes and bare names the texts: both are worked out once
    keyed = cut_lineage(rows.withColumn("_rel", normalize_relation(relation)).withColumn("_leaf", leaf_text))
    texts = cut_lineage(keyed.where(F.col("_rel") != "").select("project", "_rel", "_leaf").distinct())
    parts = F.split("_rel", r"\.")
    takes = texts.withColumn("_parts", parts).withColumn("_n", F.size("_parts")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_take"))

    def options(pos: int) -> Column:
        """Values the owner's qualifier at this place from the right may have."""
        at = F.get("_parts", F.col("_n") - 1 - pos)
        return F.when((F.col("_take") <= pos) & (F.col("_n") > pos), F.array(F.lit(""), at)) \
            .otherwise(F.array(F.lit("*")))

    wanted = (
        takes.withColumn("needle", F.array_join(
            F.slice("_parts", F.col("_n") - F.col("_take") + 1, F.col("_take")), "."))
        .withColumn("schema_key", F.explode(options(1)))
        .withColumn("database_key", F.explode(options(2)))
    )
    found = (
        wanted.join(_relation_keys(entries), ["project", "needle", "schema_key", "database_key"])
        .groupBy("project", "_rel", "_leaf", "_take")
        .agg(F.sum("owners").alias("owners"), F.min("target").alias("target"))
        .where("owners = 1")
        .groupBy("project", "_rel", "_leaf").agg(F.max_by("target", "_take").alias("_by_suffix"))
    )
    bare = texts.where(~F.contains("_rel", F.lit("."))).withColumn(
        "leaf_key", F.lower(relation_leaf(F.when(F.col("_leaf") != "", F.col("_leaf")).otherwise(F.col("_rel")))))
    by_leaf = bare.join(leaf_lookup(entries), ["project", "leaf_key"]).select(
        "project", "_rel", "_leaf", F.col("target").alias("_by_leaf"))
    resolved = (found.join(by_leaf, ["project", "_rel", "_leaf"], "full_outer")
                .select("project", "_rel", "_leaf", F.coalesce("_by_suffix", "_by_leaf").alias(into)))
    return keyed.join(resolved, ["project", "_rel", "_leaf"], "left").drop("_rel", "_leaf")


def resolve_test_owner(tests: DataFrame, entries: DataFrame, columns: DataFrame) -> DataFrame:
    """Owner of each declared test: attached node, else the first dependency that has the column,
    else the first dependency; ``excluded`` (a uid, may be null) is passed over.

    A column with a ``since`` counts for tests at later positions only. Adds ``owner`` and ``other`` (first known dependency that is not the owner).
    """
    known = entries.select("project", "uid", "display_name")
    candidates = F.concat(
        F.array(F.struct(F.lit(True).alias("attached"), F.lit(-1).alias("pos"), F.col("attached").alias("uid"))),
        F.transform("deps", lambda d, i: F.struct(F.lit(False).alias("attached"), i.alias("pos"), d.alias("uid"))))
    if "since" not in columns.columns:
        columns = columns.withColumn("since", F.lit(None).cast("bigint"))
    has_column = columns.groupBy("project", "uid", F.lower("name").alias("col_key")).agg(
        F.min(F.coalesce("since", F.lit(-1).cast("bigint"))).alias("since"))
    rows = (
        tests.select("project", "test_id", F.lower("column").alias("col_key"),
                     F.coalesce("excluded", F.lit("")).alias("excluded"), (F.col("pos") if "pos" in tests.columns else F.lit(0)).alias("test_pos"),
                     F.explode(candidates).alias("c"))
        .select("project", "test_id", "col_key", "excluded", "test_pos", "c.*")
        .where(F.col("uid") != "")
        .join(known, ["project", "uid"])
        .join(has_column, ["project", "uid", "col_key"], "left")
        .withColumn("has_column", F.coalesce(F.col("since") < F.col("test_pos"), F.lit(False)))
    )
    kept = F.col("uid") != F.col("excluded")
    priority = (F.when(F.col("attached") & kept, 0)
                .when(~F.col("attached") & kept & F.col("has_column"), 1)
                .when(~F.col("attached") & kept, 2)
                .when(~F.col("attached"), 3))
    dep = F.struct("pos", "uid", "display_name")
    owners = (
        rows.withColumn("priority", priority)
        .groupBy("project", "test_id")
        .agg(F.min_by(F.when(F.col("priority").isNotNull(), _target()), F.struct(
                F.coalesce("priority", F.lit(9)), "pos")).alias("owner"),
             # the dependencies of one test, as many as its own array holds
             F.array_sort(F.collect_list(F.when(~F.col("attached"), dep))).alias("_deps"))
    )
    other = F.get(F.filter("_deps", lambda d: d["uid"] != F.coalesce(F.col("owner.uid"), F.lit(""))), 0)
    owners = owners.select("project", "test_id", "owner",
                           F.when(other.isNotNull(), F.struct(
                               other["uid"].alias("uid"), other["display_name"].alias("display_name"))).alias("other"))
    return tests.join(owners, ["project", "test_id"], "left")


def match_file_to_entry(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Attach each file to the one entry of its kind and name; ``uid`` is null for the rest."""
    keys = entries.select("project", "kind", F.lower("name").alias("name_key"), "uid")
    single = (keys.groupBy("project", "kind", "name_key")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("uid").alias("uid")).where("_n = 1").drop("_n"))
    return (files.withColumn("name_key", F.lower(first_text("name")))
            .join(single, ["project", "kind", "name_key"], "left").drop("name_key"))


def first_of_name(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``stands_in``: the relative path that names a file's own entry.

    Of files of one kind and name that no entry declares, the first path stands in for the others.
    """
    keys = ["project", "kind", "name_key"]
    named = files.withColumn("name_key", F.lower(first_text("name")))
    declared = entries.select("project", "kind", F.lower("name").alias("name_key")).distinct()
    first = named.join(declared, keys, "left_anti").groupBy(*keys).agg(F.min("relative").alias("_first"))
    return (named.join(first, keys, "left").withColumn("stands_in", F.coalesce("_first", "relative"))
            .drop("name_key", "_first"))


def exclude_skipped_files(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Drop files whose (kind, name) was disabled or ephemeral in the YAML."""
    gone = skipped.select("project", "kind", F.lower("name").alias("name_key")).distinct()
    return (files.withColumn("name_key", F.lower(first_text("name")))
            .join(gone, ["project", "kind", "name_key"], "left_anti").drop("name_key"))
