"""Overlapping boxes against every pair looked at, with many small ranges."""

import random

import numpy as np
import pytest

from schemaloom.operators import ranges

SCHEMA = "s string, id long, x0 double, x1 double, y0 double, y1 double"
AXES = [("x0", "x1"), ("y0", "y1")]


def plain(boxes, gap, axes=2):
    def meet(a, b):
        return all(min(a[2 * k + 3], b[2 * k + 3]) - max(a[2 * k + 2], b[2 * k + 2]) + gap > 0 for k in range(axes))

    return sorted((a[0], a[1], b[1]) for a in boxes for b in boxes
                  if None not in a[1:] and None not in b[1:] and a[0] == b[0] and a[1] < b[1] and meet(a, b))


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 30)
    monkeypatch.setattr(ranges, "AT_ONCE", 50)


def found(spark, boxes, gap, axes=AXES, scope=("s",)):
    rows = ranges.overlap_pairs(spark.createDataFrame(boxes, SCHEMA), "id", axes, gap, list(scope)).collect()
    return sorted((r["s"], r["left_key"], r["right_key"]) for r in rows)


def some(n, seed, spread=100.0, long=12.0, scopes=("a", "b")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(0, spread), float(rng.randrange(10))]), rng.uniform(0, spread)
        out.append((rng.choice(scopes), i, x, x + rng.uniform(0, long), y, y + rng.choice([0.0, rng.uniform(0, long)])))
    return out


def test_random_boxes(spark):
    boxes = some(400, 1)
    assert found(spark, boxes, 2.0) == plain(boxes, 2.0) != []


def test_one_box_across_everything_and_a_crowd_at_one_place(spark):
    crowd = [("a", 1000 + i, 5.0, 6.0, float(i * 3), float(i * 3 + 1)) for i in range(300)]
    boxes = some(100, 2) + crowd + [("a", 9000, -1e9, 1e9, -1e9, 1e9), ("a", 9001, 5.0, 5.0, -1e9, 1e9)]
    assert found(spark, boxes, 0.5) == plain(boxes, 0.5)


def test_equal_boxes_missing_ends_and_repeated_keys(spark):
    boxes = [("a", i % 40, 1.0, 2.0, 1.0, 2.0) for i in range(60)] + [("a", 100, None, 2.0, 1.0, 2.0), ("a", 101, 1.0, 2.0, 1.0, None)]
    got = found(spark, boxes, 0.0)
    assert got == plain(boxes, 0.0)
    assert found(spark, boxes[:0], 0.0) == []


def test_one_axis(spark):
    boxes = some(200, 3, long=3.0)
    assert found(spark, boxes, 0.25, AXES[:1]) == plain(boxes, 0.25, 1)


def test_candidates_stay_near_the_pairs(monkeypatch):
    """Long thin boxes lying crosswise in strips: sweeping any one axis alone meets nearly all pairs."""
    monkeypatch.setattr(ranges, "AT_ONCE", 1 << 20)
    rng = np.random.default_rng(4)
    low = rng.uniform(0, 1000, (6000, 2))
    high = low + np.where(rng.random((6000, 1)) < 0.5, [[30.0, 0.01]], [[0.01, 30.0]])
    looked = 0
    listed = ranges._listed

    def counting(low, high, order, ahead):
        nonlocal looked
        looked += int(ahead.sum())
        return listed(low, high, order, ahead)

    monkeypatch.setattr(ranges, "_listed", counting)
    pairs = sum(len(a) for a, _ in ranges.sweep(low, high))
    meet = sum(int(((np.minimum(high[i], high[i + 1:]) > np.maximum(low[i], low[i + 1:])).all(1)).sum()) for i in range(len(low)))
    assert pairs == meet and looked < 40 * len(low)


def test_a_small_box_is_one_row(spark):
    """Nothing in the plan grows with a box's size next to others: only the start of the next range matters."""
    boxes = spark.createDataFrame([("a", i, float(i), i + 0.5, 0.0, 1e12) for i in range(200)], SCHEMA)
    dealt = ranges._dealt(boxes.selectExpr("s AS _scope", "id AS _key", "x0 AS _low0", "x1 AS _high0"), "_scope", 0, ["_key"], 10)
    assert dealt.count() == 200 and dealt.select("_at").distinct().count() == 10
    wide = boxes.selectExpr("s AS _scope", "id AS _key", "x0 AS _low0", "1e9D AS _high0")
    assert ranges._dealt(wide, "_scope", 0, ["_key"], 10).groupBy("_key").count().agg({"count": "max"}).first()[0] == 10
