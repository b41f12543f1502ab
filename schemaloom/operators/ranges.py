"""Pairs of overlapping boxes by a sweep over ranges of low ends."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

# Boxes that start in one range, and candidate pairs a task looks at together.
RANGE_ROWS, AT_ONCE = 1 << 15, 1 << 20


def _forward(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by low end, and for each how many later ones start before it ends."""
    order = np.argsort(low, kind="stable")
    ends = np.searchsorted(low[order], high[order], "left")
    return order, np.maximum(ends - np.arange(len(order)) - 1, 0)


def _listed(low: np.ndarray, high: np.ndarray, order: np.ndarray, ahead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each box with those that start while it is open, ``AT_ONCE`` or so at a time; those that meet on every axis."""
    total = np.cumsum(ahead)
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE, "right")))
        # one box may be open over very many: its partners are taken in slices too
        for skip in range(0, max(1, int(ahead[start])) if stop == start + 1 else 1, AT_ONCE):
            count = ahead[start:stop] if stop > start + 1 else np.minimum(ahead[start:stop] - skip, AT_ONCE)
            a = np.repeat(np.arange(start, stop), count)
            b = a + 1 + skip + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            a, b = order[a], order[b]
            meet = (np.minimum(high[a], high[b]) > np.maximum(low[a], low[b])).all(1)
            if meet.any():
                yield a[meet], b[meet]
        start = stop


def sweep(low: np.ndarray, high: np.ndarray, region: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes (rows of ``low`` and ``high``, one column per axis) that meet on every axis.

    The axis on which fewer boxes start inside others is swept. If still many more candidates than
    boxes are left, the boxes are parted at the middle low end, those that reach over it going to both
    sides, and each pair belongs to the side that holds the larger of its two low ends.
    """
    found = [_forward(low[:, k], high[:, k]) for k in range(low.shape[1])]
    sums = [int(ahead.sum()) for _, ahead in found]
    axis = int(np.argmin(sums))
    region = region or ((-np.inf, np.inf),) * low.shape[1]
    if sums[axis] > 32 * len(low) + 4096:
        # the axis whose middle parts the boxes best
        best = None
        for k in range(low.shape[1]):
            middle = low[found[k][0][len(low) // 2], k]
            left, right = low[:, k] < middle, high[:, k] > middle
            right |= low[:, k] >= middle
            size = max(int(left.sum()), int(right.sum()))
            if region[k][0] < middle < region[k][1] and size < 0.9 * len(low) and (best is None or size < best[0]):
                best = size, k, middle, left, right
        if best:
            _, k, middle, left, right = best
            for side, bounds in ((left, (region[k][0], middle)), (right, (middle, region[k][1]))):
                own = np.flatnonzero(side)
                for a, b in sweep(low[own], high[own], (*region[:k], bounds, *region[k + 1:])):
                    yield own[a], own[b]
            return
    for a, b in _listed(low, high, *found[axis]):
        start = np.maximum(low[a], low[b])
        inside = np.logical_and.reduce([(start[:, k] >= region[k][0]) & (start[:, k] < region[k][1]) for k in range(low.shape[1])])
        if inside.any():
            yield a[inside], b[inside]


def _dealt(boxes: DataFrame, lead: str, axis: int, tie: list[str], ranges: int) -> DataFrame:
    """Boxes in ranges of (lead, low end): one row for the range a box starts in and for each it reaches into.

    ``_at`` is the range, ``_own`` says whether the box starts there. The ranges' first low ends, one for
    each of ``ranges`` tasks, are all that the driver sees.
    """
    low, high = f"_low{axis}", f"_high{axis}"
    placed = cut_lineage(boxes.repartitionByRange(ranges, lead, low, *tie).withColumn("_at", F.spark_partition_id()))
    seen = {r["_at"]: {"lead": r["lead"], "low": r["low"]} for r in placed.groupBy("_at").agg(
        F.min(F.struct(F.col(lead).alias("lead"), F.col(low).alias("low"))).alias("f")).select("_at", "f.*").collect()}
    starts = [seen.get(max(seen, default=0))] if seen else []
    for at in range(max(seen, default=0) - 1, -1, -1):  # a range without rows starts where the next one does
        starts.append(seen.get(at, starts[-1]))
    kind = placed.schema[lead].dataType.simpleString()
    firsts = F.from_json(F.lit(json.dumps(starts[::-1])), f"array<struct<lead:{kind},low:double>>")
    after = F.get(firsts, F.col("_at") + 1)
    # few boxes reach over the start of the next range; only these look through all starts
    reached = F.size(F.filter(firsts, lambda f: (f["lead"] < F.col(lead)) | ((f["lead"] == F.col(lead)) & (f["low"] < F.col(high))))) - 1
    last = F.when((after["lead"] == F.col(lead)) & (after["low"] < F.col(high)), reached).otherwise(F.col("_at"))
    return placed.withColumn("_start", F.col("_at")).withColumn("_at", F.explode(F.sequence("_start", last))).withColumn(
        "_own", F.col("_at") == F.col("_start")).drop("_start")


def overlap_pairs(boxes: DataFrame, key: str, axes: list[tuple[str, str]], gap: float, scope: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals overlap on every axis, counting a gap between them.

    Boxes are dealt into ranges of about equal numbers by their low end on the first axis, and inside
    these by the second, so that a crowd with one low end is parted by the other. A box costs one row for
    each range it reaches into, however large it is. Each range is swept by itself, and a pair is
    reported where the later starting box of the two starts, on both axes, so nothing has to be made
    distinct. Rows with a missing end, or of one key, pair with nothing (with each other).
    """
    scope = scope or []
    spark = boxes.sparkSession
    ship(spark)
    name = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}) if scope else F.lit("")
    ends = [c for pair in axes for c in pair]
    sides = [x for i, (lo, hi) in enumerate(axes) for x in (F.col(lo).cast("double").alias(f"_low{i}"), (F.col(hi).cast("double") + gap).alias(f"_high{i}"))]
    rows = boxes.dropna(subset=[key, *ends]).select(name.alias("_scope"), *scope, F.col(key).alias("_key"), *sides)
    count, two = len(axes), len(axes) > 1
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if two:
        rows = _dealt(rows, "_scope", 0, [], least).withColumnsRenamed({"_at": "_first", "_own": "_own0"})
        rows = _dealt(rows, "_first", 1, ["_key"], max(least, -(-rows.count() // RANGE_ROWS)))
    else:
        rows = _dealt(rows, "_scope", 0, ["_key"], max(least, -(-rows.count() // RANGE_ROWS)))
        rows = rows.withColumn("_first", F.col("_at")).withColumn("_own0", F.col("_own"))
    pair_schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in scope],
                             *[f"{side} {rows.schema['_key'].dataType.simpleString()}" for side in ("left_key", "right_key")]])

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        # scopes and first ranges are one more axis, on which only equal ones meet
        group = frame.groupby(["_scope", "_first"], sort=False).ngroup().to_numpy(np.float64)
        low = np.column_stack([*[frame[f"_low{i}"] for i in range(count)], group]).astype(np.float64)
        high = np.column_stack([*[frame[f"_high{i}"] for i in range(count)], group + 0.5]).astype(np.float64)
        keys, own0, own = frame["_key"].to_numpy(), frame["_own0"].to_numpy(), frame["_own"].to_numpy()
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in sweep(low, high):
            back = keys[a] > keys[b]
            a, b = np.where(back, b, a), np.where(back, a, b)
            # at home: where the later start is, by low end, and by key among equal ones on the axis split last
            tie = own0[a] & own0[b] if two else own0[b]
            here = np.where(low[a, 0] > low[b, 0], own0[a], np.where(low[a, 0] < low[b, 0], own0[b], tie))
            if two:
                here &= np.where(low[a, 1] > low[b, 1], own[a], own[b])
            here &= keys[a] != keys[b]
            lefts.append(a[here])
            rights.append(b[here])
        a, b = np.concatenate(lefts), np.concatenate(rights)
        return pd.DataFrame({**{c: frame[c].take(a).reset_index(drop=True) for c in scope}, "left_key": keys[a], "right_key": keys[b]})

    return rows.groupBy("_at").applyInPandas(cell, pair_schema)
