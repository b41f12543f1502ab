"""Numbering, first-of-key, heads and batches without a group ever sitting in one task.

A window over a hot key is one task. Counting and first-of-key are therefore aggregates (combined
before the shuffle), and row numbers are taken inside position blocks of a bounded height, with the
blocks' own counts summed up afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import as_col, first_text, safe_part, trim_space
from ..session import cut_lineage

# Rows one numbering block may hold.
BLOCK = 1 << 20


def number_rows(rows: DataFrame, group: list[str], order: str, into: str = "rn", block: int = BLOCK) -> DataFrame:
    """1-based row number per group by a unique integer position."""
    placed = rows.withColumn("_block", F.floor(F.col(order) / block))
    keys = [*group, "_block"]
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return (placed.withColumn("_inside", inside).join(offsets, keys)
            .withColumn(into, (F.col("_inside") + F.col("_offset")).cast("bigint"))
            .drop("_block", "_inside", "_offset"))


def number_by(rows: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """1-based row number per group by any sortable columns; equal places still get different numbers.

    Rows are dealt out by range and written, so that no group, however large, lies in one task.
    """
    placed = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    keys = [*group, "_part"]
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return cut_lineage(placed.withColumn("_inside", inside).join(offsets, keys)
                       .withColumn(into, (F.col("_inside") + F.col("_offset")).cast("bigint")).drop("_part", "_inside", "_offset"))


def stable_ordinals(columns: DataFrame, table: list[str], block: int = BLOCK) -> DataFrame:
    """Dense column order from (phase, pos): declared, then catalog-only, then first seen in a test."""
    placed = columns.withColumn("_at", order_key("phase", "pos"))
    return number_rows(placed, table, "_at", "ord", block).drop("_at")


def order_key(phase, pos) -> Column:
    """(phase, pos) as one sortable number; sparse, which is all that ordering needs. Positions stay below 2^60."""
    return (as_col(phase).cast("bigint") * F.lit(1 << 60) + as_col(pos).cast("bigint")).cast("bigint")


def dedupe_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key in input order."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
            .select(*[f"_row.{c}" if c in rest else c for c in rows.columns]))


def column_head(columns: DataFrame, table: list[str], order: str, k: int = 8) -> DataFrame:
    """First k columns of each table and the footer ``+N more`` (blank when nothing is hidden).

    The rank filter is limited per task before the shuffle, so a very wide table moves k rows per
    task; the total comes from a combined count.
    """
    rank = F.row_number().over(W.partitionBy(*table).orderBy(order))
    head = columns.withColumn("rn", rank).where(F.col("rn") <= k)
    totals = columns.groupBy(*table).agg(F.count(F.lit(1)).alias("_n"))
    more = F.col("_n") - k
    footer = F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).otherwise("")
    return head.join(totals, table).withColumn("footer", footer).drop("_n")


def batch_strings(rows: DataFrame, group: list[str], order: str, text: Column, prefix: str = "",
                  n: int = 5, block: int = BLOCK) -> DataFrame:
    """Batches of n rows in order, their texts joined by a space behind a prefix."""
    numbered = number_rows(rows.withColumn("_text", text), group, order, "_rn", block)
    batch = F.floor((F.col("_rn") - 1) / n).cast("bigint")
    parts = F.array_sort(F.collect_list(F.struct("_rn", "_text")))
    return (numbered.withColumn("batch", batch).groupBy(*group, "batch")
            .agg(F.concat(F.lit(prefix), F.array_join(F.transform(parts, lambda p: p["_text"]), " ")).alias("query")))


def owner_scope(kind, login) -> Column:
    """Search scope of an account: organisations and users have their own word."""
    return F.concat(F.when(as_col(kind) == "Organization", "org:").otherwise("user:"), as_col(login))


def _levels(entries: DataFrame) -> DataFrame:
    """The name of every entry at each level of qualification."""
    is_source = (F.col("kind") == "source") & (F.col("source_name") != "")
    tail = F.when(is_source, F.array("source_name", "name")).otherwise(F.array("name"))
    qualifier = first_text("schema", "path_qualifier")
    id_part = F.coalesce(F.nullif(F.try_element_at(F.split("uid", r"\."), F.lit(-2)), F.lit("")), F.col("uid"))
    prefixes = [
        [qualifier],
        [F.col("package"), qualifier],
        [F.col("database"), F.col("package"), qualifier],
        [F.col("database"), F.col("package"), qualifier, id_part],
    ]

    def name(prefix: list[Column]) -> Column:
        parts = F.filter(F.transform(F.concat(F.array(*prefix), tail), safe_part), lambda p: p != "")
        lowered = F.transform(parts, F.lower)
        # keep a part only where its lower-case form appears first
        kept = F.filter(parts, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)
        return F.coalesce(F.nullif(F.array_join(kept, "."), F.lit("")), F.col("base_name"))

    return entries.withColumn("_names", F.array(*[name(p) for p in prefixes]))


def qualify_names(entries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Give colliding names schema, package, database and id part, only while they collide.

    Counts are aggregates and not windows, since one popular name may hold a large share of the rows.
    The state is written out after each level that changed something; most fleets stop after two.
    """
    scope = scope or ["project"]
    named = cut_lineage(_levels(entries).withColumn("display_name", F.col("base_name")))
    final = F.concat("display_name", F.lit("."), F.replace(safe_part("uid"), F.lit("."), F.lit("_")))
    for rename in [*[F.col("_names")[i] for i in range(4)], final]:
        keyed = named.withColumn("_key", F.lower("display_name"))
        clashes = keyed.groupBy(*scope, "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if clashes.isEmpty():
            break
        renamed = keyed.join(clashes, [*scope, "_key"], "left").withColumn(
            "display_name", F.when(F.col("_n").isNotNull(), rename).otherwise(F.col("display_name")))
        named = cut_lineage(renamed.drop("_key", "_n"))
    return named.drop("_names")


def alias_base(name) -> Column:
    """Identifier characters only; never empty, never starting with a digit."""
    token = F.regexp_replace(as_col(name), r"[^A-Za-z0-9_]", "_")
    return F.when((token == "") | token.rlike(r"\A\d"), F.concat(F.lit("e_"), token)).otherwise(token)


def unique_alias(tables: DataFrame, scope: list[str], order: str, name: str = "name",
                 block: int = BLOCK) -> DataFrame:
    """Alias per table: the clean name, then ``_2``, ``_3`` in table order, skipping taken suffixes.

    A suffix s of a base b is not free once a table whose own base reads ``b_s`` has come by: such a claim
    moves later tables of b one further. ``_settle`` finds the claims that do; without a base of that form
    (the usual case) the row's number is the suffix.
    """
    based = number_rows(tables.withColumn("_base", alias_base(name)), [*scope, "_base"], order, "_k", block)
    slim = cut_lineage(based.select(*scope, "_base", "_k", F.col(order).alias("_at")))
    firsts = slim.where("_k = 1").select(*scope, F.col("_base").alias("_taken"), F.col("_at").alias("_taken_at"))
    # a suffix of over 18 digits is beyond the rows any base can have
    suffix = r"\A(.+)_([2-9]|[1-9]\d{1,17})\z"
    claims = (firsts.where(F.col("_taken").rlike(suffix))
              .select(*scope, F.regexp_extract("_taken", suffix, 1).alias("_base"),
                      F.regexp_extract("_taken", suffix, 2).cast("bigint").alias("_label"), "_taken", "_taken_at")
              .join(slim.select(*scope, "_base").distinct(), [*scope, "_base"], "left_semi"))
    if claims.isEmpty():
        return based.withColumn("alias", F.when(F.col("_k") == 1, F.col("_base")).otherwise(
            F.concat_ws("_", "_base", F.col("_k").cast("string")))).drop("_base", "_k")
    return based.join(_settle(slim, cut_lineage(claims), scope, block), [*scope, "_base", "_k"]).drop("_base", "_k")


def _last_before(events: DataFrame, keys: list[str], at: str, value: str, block: int, ties: Column | None = None) -> DataFrame:
    """Events with ``_last``: the largest ``value`` at or before their place, per key, found inside blocks of
    places and carried over between blocks, so that no key is one task."""
    blocked = events.withColumn("_block", F.floor(F.col(at) / block))
    order = [F.col(at)] + ([ties] if ties is not None else [])
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocked.groupBy(*keys, "_block").agg(F.max(value).alias("_most")).select(
        *keys, "_block", F.max("_most").over(before).alias("_carried"))
    return (blocked.withColumn("_inside", F.max(value).over(inside)).join(carried, [*keys, "_block"])
            .withColumn("_last", F.coalesce(F.greatest("_inside", "_carried"), F.lit(0))).drop("_block", "_inside", "_carried"))


def _passed(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims in order of their suffix -> how many suffixes below are skipped, and whether this one is.

    A claim on suffix s that came after r rows of its base is skipped exactly when the row that
    reaches it, number s less the skipped ones below, comes after those r. One running count per
    base says it all; it is kept for both cases of the bare base being lost or not (``_c0``, ``_c1``).
    Claims are read as a stream in order, so a base with very many needs no memory.
    """
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ordered = claims.withColumn("_group", group).withColumn("_limit", F.col("_label") - F.col("_last"))

    def count(batches):
        group, held = None, [0, 1]
        for batch in batches:
            below = []
            for name, limit in zip(batch["_group"], batch["_limit"].tolist(), strict=True):
                if name != group:
                    group, held = name, [0, 1]
                below.append(tuple(held))
                held = [c + (c < limit) for c in held]
            batch["_c0"], batch["_c1"] = [c[0] for c in below], [c[1] for c in below]
            yield batch

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    streamed = ordered.repartition("_group").sortWithinPartitions("_group", "_label").mapInPandas(count, f"{kinds}, _c0 bigint, _c1 bigint")
    return cut_lineage(streamed.withColumns({f"_skip{i}": F.col(f"_c{i}") < F.col("_limit") for i in (0, 1)}).drop("_group", "_limit"))


def _lost(passed: DataFrame, scope: list[str]) -> DataFrame:
    """(.., _base, _lost): bases whose bare text an earlier row of the base they are a suffix of has taken.

    Whether it is taken depends on the upper base having lost its own bare text or not: a map of two
    values, composed along nested suffixes (``a_2_3``) by doubling.
    """
    keys = [*scope, "_base"]
    up = passed.select(*scope, F.col("_taken").alias("_base"), F.col("_base").alias("_up"), (~F.col("_skip0")).alias("_m0"), (~F.col("_skip1")).alias("_m1"))
    nested = passed.select(*scope, F.col("_taken").alias("_up"), F.lit(True).alias("_nested"))
    known = F.when(F.col("_nested").isNull() | (F.col("_m0") == F.col("_m1")), F.col("_m0"))
    now = cut_lineage(up.join(nested, [*scope, "_up"], "left").withColumn("_lost", known).drop("_nested"))
    while not now.where("_lost is null").isEmpty():
        above = now.select(*scope, F.col("_base").alias("_up"), F.col("_up").alias("_up2"), F.col("_m0").alias("_n0"), F.col("_m1").alias("_n1"),
                           F.col("_lost").alias("_lost2"))
        met = now.join(above, [*scope, "_up"], "left")

        def after(which, first="_m0", second="_m1"):
            return F.when(F.col(which), F.col(second)).otherwise(F.col(first))

        now = cut_lineage(met.select(
            *keys, F.coalesce("_up2", "_up").alias("_up"), F.coalesce("_lost", F.when(F.col("_lost2").isNotNull(), after("_lost2"))).alias("_lost"),
            after("_n0").alias("_m0"), after("_n1").alias("_m1")))
    return now.where("_lost").select(*keys, "_lost")


def _settle(slim: DataFrame, claims: DataFrame, scope: list[str], block: int) -> DataFrame:
    """Aliases for rows whose bases compete for suffixes, in a fixed number of steps."""
    keys = [*scope, "_base"]
    bases = claims.select(*keys).distinct()
    rows = slim.join(bases, keys, "left_semi")
    # how many rows of the base came before each claim
    events = rows.select(*keys, "_at", "_k", F.lit(None).cast("bigint").alias("_label"), F.lit(None).cast("string").alias("_taken")).unionByName(
        claims.select(*keys, F.col("_taken_at").alias("_at"), F.lit(None).cast("bigint").alias("_k"), "_label", "_taken"))
    met = _last_before(events, keys, "_at", "_k", block).where("_label is not null").select(*keys, "_label", "_taken", "_last")
    passed = _passed(met, keys)
    lost = _lost(passed, scope)
    # the n-th skipped suffix moves the rows from its own number less the n - 1 below it
    own = passed.join(lost, keys, "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)))
    below = F.when(F.col("_lost"), F.col("_c1")).otherwise(F.col("_c0"))
    skipped = own.where(F.when(F.col("_lost"), F.col("_skip1")).otherwise(F.col("_skip0"))).select(
        *keys, (F.col("_label") - below).alias("_k"), (below + 1).alias("_rank"))
    moved = skipped.unionByName(lost.select(*keys, F.lit(1).cast("bigint").alias("_k"), F.lit(1).cast("bigint").alias("_rank")))
    steps = slim.join(moved.select(*keys).distinct(), keys, "left_semi").select(
        *keys, "_k", F.lit(None).cast("bigint").alias("_rank")).unionByName(moved)
    shifted = _last_before(steps, keys, "_k", "_rank", block, F.col("_rank").asc_nulls_last()).where("_rank is null").select(*keys, "_k", "_last")
    label = F.col("_k") + F.coalesce("_last", F.lit(0))
    alias = F.when(label == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", label.cast("string")))
    return slim.join(shifted, [*keys, "_k"], "left").select(*keys, "_k", alias.alias("alias"))


def next_free_name(columns: DataFrame, tables: DataFrame, table: list[str], stem: str = "new_column",
                   name: str = "name") -> DataFrame:
    """Per table the first of ``stem``, ``stem_2``, ``stem_3`` … that no column has.

    The taken numbers of a table are few whatever its width, and the answer is the smallest gap:
    number n is free when the n-th taken number, in order, is larger than n.
    """
    number = F.when(F.lower(name) == stem, 1).otherwise(
        F.regexp_extract(F.lower(name), rf"\A{stem}_([2-9]|[1-9]\d{{1,17}})\z", 1).try_cast("bigint"))
    taken = columns.select(*table, number.cast("bigint").alias("_n")).where("_n is not null").distinct()
    rank = F.row_number().over(W.partitionBy(*table).orderBy("_n"))
    runs = taken.withColumn("_rank", rank).where(F.col("_n") == F.col("_rank"))
    free = runs.groupBy(*table).agg((F.max("_n") + 1).alias("_free"))
    pick = F.coalesce("_free", F.lit(1))
    return (tables.select(*table).distinct().join(free, table, "left")
            .select(*table, F.when(pick == 1, F.lit(stem)).otherwise(
                F.concat(F.lit(f"{stem}_"), pick.cast("string"))).alias("free_name")))


def default_first(rows: DataFrame, is_default: Column, order: str) -> DataFrame:
    """Default item first, the others in their order."""
    return rows.orderBy(F.when(is_default, 0).otherwise(1), order)


def sorted_names(rows: DataFrame, *names: str) -> DataFrame:
    """Distinct non-blank names in order."""
    return rows.select(*names).where(reduce(lambda a, b: a & b, [trim_space(n) != "" for n in names])) \
        .distinct().orderBy(*names)
