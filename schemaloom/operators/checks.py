"""Declared constraints run on data rows.

Every check folds its rows to keys before anything is shuffled by key, so a key that holds a third of
the table crosses the network as one row per task. No check collects a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _all_set(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Rows that break not-null."""
    return df.where(F.col(col).isNull())


def not_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Violations of several not-null columns in one scan: (column_name, violations)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column_name", "violations")


def _key_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; keys with a null part are exempt."""
    return _key_counts(df.where(_all_set(cols)), cols).where("n > 1")


def check_primary_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that are duplicated or hold a null, from one aggregate."""
    has_null = ~_all_set(cols)
    return (_key_counts(df, cols).withColumn("has_null", has_null)
            .withColumn("duplicated", (F.col("n") > 1) & ~F.col("has_null")).where("has_null or duplicated"))


def check_relationship(child: DataFrame, cols: Sequence[str], parent: DataFrame,
                       parent_cols: Sequence[str]) -> DataFrame:
    """Child keys without a parent and how many rows carry them; null keys are exempt."""
    keys = _key_counts(child.where(_all_set(cols)), cols)
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, cols, strict=True)])
    return keys.join(known, list(cols), "left_anti")


def relation_cardinality(child: DataFrame, cols: Sequence[str], parent: DataFrame,
                         parent_cols: Sequence[str]) -> DataFrame:
    """Children per parent: least, mean and most, and parents that have none."""
    keys = _key_counts(child.where(_all_set(cols)), cols)
    parents = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, cols, strict=True)]).distinct()
    n = F.coalesce("n", F.lit(0))
    return parents.join(keys, list(cols), "left").agg(
        F.count(F.lit(1)).alias("parents"), F.count_if(n == 0).alias("childless"),
        F.min(n).alias("min_children"), F.round(F.avg(n), 6).alias("avg_children"), F.max(n).alias("max_children"))


@dataclass(frozen=True)
class Link:
    """A child column and the parent column it may point at; tables are named."""

    child: str
    child_col: str
    parent: str
    parent_col: str


def verify_inferred_links(links: Iterable[Link], datasets: dict[str, DataFrame]) -> DataFrame:
    """Share of distinct child values found in the parent key, one row per link.

    A parent key several links point at is made distinct once per link; the values are compared as
    text only when the two types differ. For links that are rows, see ``verify_links``.
    """
    results = []
    for link in links:
        child, parent = datasets[link.child], datasets[link.parent]
        as_text = dict(child.dtypes)[link.child_col] != dict(parent.dtypes)[link.parent_col]

        def value(col, as_text=as_text):
            return (F.col(col).cast("string") if as_text else F.col(col)).alias("v")

        values = child.select(value(link.child_col)).where("v is not null").distinct()
        keys = parent.select(value(link.parent_col)).where("v is not null").distinct().withColumn("hit", F.lit(True))
        found = values.join(keys, "v", "left")
        results.append(found.agg(
            F.lit(f"{link.child}.{link.child_col}").alias("child"),
            F.lit(f"{link.parent}.{link.parent_col}").alias("parent"),
            F.count(F.lit(1)).alias("child_values"), F.count("hit").alias("found"),
            F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share")))
    return reduce(DataFrame.unionByName, results)


def _digest(*values: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds: 128 bits that stand for the values (nulls are passed over)."""
    return [F.xxhash64(F.lit(seed), *values).alias(f"k{seed}") for seed in (1, 2)]


def value_index(datasets: dict[str, DataFrame], wanted: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Every distinct non-null value of every column: (table_key, col_key, k1, k2).

    One scan per table, expanded to (column, digest of the value as text) and folded in the tasks
    before it is shuffled, so a frequent value moves as one row a task. Names are lower case; ``wanted``
    keeps the scans to these (table, column) pairs.
    """
    pairs = None if wanted is None else {(t.lower(), c.lower()) for t, c in wanted}
    parts = []
    for name, df in datasets.items():
        cols = [c for c in df.columns if pairs is None or (name.lower(), c.lower()) in pairs]
        if cols:
            cells = F.array(*[F.struct(F.lit(c.lower()).alias("col_key"), F.col(c).isNotNull().alias("filled"),
                                       *_digest(F.col(c).cast("string"))) for c in cols])
            parts.append(df.select(F.lit(name.lower()).alias("table_key"), F.inline(cells)).where("filled").drop("filled"))
    if not parts:
        return next(iter(datasets.values())).sparkSession.createDataFrame([], "table_key string, col_key string, k1 bigint, k2 bigint")
    return reduce(DataFrame.unionByName, parts).distinct()


def verify_links(links: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows of found links (project, from_key, from_col, to_key, to_col, ..) with child_values, found and share.

    All links are verified by one plan over one index of values: a link meets the index rows of its
    child column, and these the index rows of its parent column with the same value. Values are
    compared as text. Only the names of the linked columns are read to the driver, at most as many as
    the given tables have, so that the scans are kept to them. A link to a table or column that is not
    given has no child values (or finds none).
    """
    ends = links.select(F.explode(F.array(F.struct(F.lower("from_key").alias("t"), F.lower("from_col").alias("c")),
                                          F.struct(F.lower("to_key").alias("t"), F.lower("to_col").alias("c")))).alias("e")).select("e.*").distinct()
    given = links.sparkSession.createDataFrame(
        sorted({(n.lower(), c.lower()) for n, d in datasets.items() for c in d.columns}), "t string, c string")
    index = cut_lineage(value_index(datasets, [tuple(r) for r in ends.join(given, ["t", "c"], "left_semi").collect()]))
    keyed = links.withColumns({"_from": F.lower("from_key"), "_col": F.lower("from_col"), "_to": F.lower("to_key"), "_to_col": F.lower("to_col")})
    wanted = keyed.select("_from", "_col", "_to", "_to_col").distinct()
    child = index.select(F.col("table_key").alias("_from"), F.col("col_key").alias("_col"), "k1", "k2").join(wanted, ["_from", "_col"])
    parent = index.select(F.col("table_key").alias("_to"), F.col("col_key").alias("_to_col"), "k1", "k2", F.lit(True).alias("hit"))
    counts = child.join(parent, ["_to", "_to_col", "k1", "k2"], "left").groupBy("_from", "_col", "_to", "_to_col").agg(
        F.count(F.lit(1)).alias("child_values"), F.count("hit").alias("found"))
    share = F.round(F.col("found") / F.nullif("child_values", F.lit(0)), 6)
    return (keyed.join(counts, ["_from", "_col", "_to", "_to_col"], "left").select(
        *links.columns, F.coalesce("child_values", F.lit(0)).cast("bigint").alias("child_values"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), share.alias("share")))


# HLL sketches of 2^12 buckets: relative standard error about 1.6 %.
SKETCH_BITS = 12


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Filled, null and distinct counts per column.

    Exact: rows become (column, digest of the typed value) pairs, folded in the tasks and counted in two
    steps, so distinct values never meet in one task and no value crosses the network, whatever its
    length. Approximate: one aggregate without any shuffle of values; distinct counts come from sketches.
    """
    cols = list(cols or df.columns)
    if approximate:
        return profile_counts(profile_sketches(df, cols))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("has"), *_digest(F.col(c))) for c in cols])
    counts = df.select(F.inline(cells)).groupBy("column_name", "has", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("has"), F.col("n"))), F.lit(0)).alias("filled"),
        F.coalesce(F.sum(F.when(~F.col("has"), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if("has").alias("distinct_values"))


def profile_sketches(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, filled, nulls, sketch) from one scan; profiles of parts of a table merge (``merge_profiles``)."""
    cols = list(cols or df.columns)
    each = df.agg(*[x for c in cols for x in (
        F.count(c).alias(f"filled {c}"), F.count_if(F.col(c).isNull()).alias(f"nulls {c}"),
        F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(SKETCH_BITS)).alias(f"sketch {c}"))])
    return each.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"`filled {c}`").alias("filled"), F.col(f"`nulls {c}`").alias("nulls"),
        F.col(f"`sketch {c}`").alias("sketch")) for c in cols])))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Profiles of disjoint row sets -> the profile of them all."""
    return parts.groupBy("column_name").agg(F.sum("filled").alias("filled"), F.sum("nulls").alias("nulls"),
                                            F.hll_union_agg("sketch").alias("sketch"))


def profile_counts(sketches: DataFrame) -> DataFrame:
    return sketches.select("column_name", "filled", "nulls", F.hll_sketch_estimate("sketch").alias("distinct_values"))


@dataclass(frozen=True)
class Contract:
    """Checks declared for one table.

    Foreign keys: (columns, parent table, parent columns) and, if only some parent rows count, a condition on them.
    """

    table: str
    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    primary_key: Sequence[str] = ()
    foreign_keys: Sequence[tuple] = field(default=())


RESULT = ("table_name", "check_name", "columns", "violations", "failed_rows")
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _shared_types(left: DataFrame, cols: Sequence[str], right: DataFrame, others: Sequence[str]) -> list[str]:
    """The types two key lists are compared in: equal ones as they are, else what Spark makes of both, else text."""
    types = []
    for a, b in zip(cols, others, strict=True):
        one, two = left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()
        if one != two:
            try:
                both = F.coalesce(F.lit(None).cast(one), F.lit(None).cast(two))
                one = left.sparkSession.range(0).select(both.alias("v")).schema["v"].dataType.simpleString()
            except AnalysisException:
                one = "string"
        types.append(one)
    return types


def _key(df: DataFrame, cols: Sequence[str], types: Sequence[str] | None = None) -> tuple[Column, Column, Column]:
    """A key list as (which parts are null, two numbers): one or two whole numbers as they are, else a 128-bit digest."""
    types = list(types or (df.schema[c].dataType.simpleString() for c in cols))
    values = [F.col(c).cast(t) if df.schema[c].dataType.simpleString() != t else F.col(c) for c, t in zip(cols, types, strict=True)]
    nulls = reduce(lambda a, b: a + b, [F.when(v.isNull(), 1 << i).otherwise(0) for i, v in enumerate(values)])
    if len(values) <= 2 and all(t in _INTEGERS for t in types):
        numbers = [F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")) for v in values]
        return nulls, numbers[0], numbers[1] if len(numbers) == 2 else F.lit(0).cast("bigint")
    first, second = _digest(*values)
    return nulls, first, second


def run_contracts(contracts: Iterable[Contract], datasets: dict[str, DataFrame]) -> DataFrame:
    """All declared checks of all tables, one row per check: violating keys and the rows behind them.

    Each table is scanned once, whatever is declared for it or points at it: a row becomes one
    (key list, key) row per key list, as child or as parent, and a row per null where none may be. They
    are folded per task, and one shuffle by key serves all checks of all tables.
    """
    checks: list[tuple] = []
    cells: dict[str, list[Column]] = {}
    lists: dict[tuple, int] = {}

    def cell(number: int, nulls: Column, first: Column, second: Column, parent: bool = False) -> Column:
        return F.struct(F.lit(number).alias("list"), nulls.alias("nulls"), first.alias("k1"), second.alias("k2"), F.lit(parent).alias("parent"))

    def key_list(table: str, cols: Sequence[str]) -> int:
        if (table, *cols) not in lists:
            lists[table, *cols] = number = len(lists)
            cells.setdefault(table, []).append(cell(number, *_key(datasets[table], cols)))
        return lists[table, *cols]

    zero = F.lit(0).cast("bigint")
    for contract in contracts:
        name, df = contract.table, datasets[contract.table]
        cells.setdefault(name, [])
        for col in contract.not_null:
            lists[name, "not_null", len(checks), col] = number = len(lists)
            cells[name].append(F.when(F.col(col).isNull(), cell(number, F.lit(0), zero, zero)))
            checks.append((name, "not_null", col, number))
        for cols in contract.unique:
            checks.append((name, "unique", ",".join(cols), key_list(name, cols)))
        if contract.primary_key:
            checks.append((name, "primary_key", ",".join(contract.primary_key), key_list(name, contract.primary_key)))
        for cols, parent, parent_cols, *where in contract.foreign_keys:
            types = _shared_types(df, cols, datasets[parent], parent_cols)
            lists[name, "relationship", len(checks), *cols] = number = len(lists)
            for table, own, is_parent, test in ((name, cols, False, None), (parent, parent_cols, True, where[0] if where else None)):
                # keys with a null part are exempt, and match nothing
                wanted = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own] + ([F.expr(test)] if test else []))
                cells.setdefault(table, []).append(F.when(wanted, cell(number, *_key(datasets[table], own, types), parent=is_parent)))
            checks.append((name, "relationship", ",".join(cols), number))
    spark = next(iter(datasets.values())).sparkSession
    declared = spark.createDataFrame(checks, "table_name string, check_name string, columns string, list int")
    scans = [datasets[table].select(F.inline(F.array(*made))).where("list is not null") for table, made in cells.items() if made]
    keys = reduce(DataFrame.unionByName, scans).groupBy("list", "nulls", "k1", "k2").agg(
        F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("known"))
    n, whole = F.col("n"), F.col("nulls") == 0
    tests = {"not_null": n > 0, "unique": whole & (n > 1), "primary_key": ~whole | (n > 1), "relationship": ~F.col("known") & (n > 0)}
    folded = keys.groupBy("list").agg(*[x for k, t in tests.items() for x in (
        (F.sum("n") if k == "not_null" else F.count_if(t)).alias(f"{k} keys"), F.sum(F.when(t, n)).alias(f"{k} rows"))])

    def pick(what: str) -> Column:
        by_check = reduce(lambda rest, k: F.when(F.col("check_name") == k, F.col(f"`{k} {what}`")).otherwise(rest), tests, F.lit(None))
        return F.coalesce(by_check, F.lit(0)).cast("bigint")

    return declared.join(folded, "list", "left").select(
        "table_name", "check_name", "columns", pick("keys").alias("violations"), pick("rows").alias("failed_rows"))


def run_contract(contract: Contract, datasets: dict[str, DataFrame]) -> DataFrame:
    """The checks declared for one table."""
    return run_contracts([contract], datasets)


def contract_from_model(columns: DataFrame, relations: DataFrame, project: str, table: str,
                        parents: dict[str, str] | None = None) -> Contract:
    """Contract of one modelled table, read from its own flag and edge rows.

    This is the one read to the driver here: the rows are one table's flagged columns and its
    outgoing edges, as many as the declarations someone wrote for it.
    """
    flagged = (columns.where((F.col("project") == project) & (F.lower("table_name") == table.lower()))
               .where("pk or nn or uniq").select("name", "pk", "nn", "uniq", "ord").collect())
    flagged.sort(key=lambda r: r["ord"])
    edges = relations.where((F.col("project") == project) & (F.lower("from_table") == table.lower())
                            & ~F.col("to_missing")).select("from_cols", "to_table", "to_cols").collect()
    known = parents or {}
    return Contract(
        table=table,
        not_null=tuple(r["name"] for r in flagged if r["nn"]),
        unique=tuple((r["name"],) for r in flagged if r["uniq"]),
        primary_key=tuple(r["name"] for r in flagged if r["pk"]),
        foreign_keys=tuple((tuple(e["from_cols"]), known.get(e["to_table"], e["to_table"]), tuple(e["to_cols"]))
                           for e in edges if e["to_cols"] and len(e["from_cols"]) == len(e["to_cols"])))
