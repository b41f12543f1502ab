"""Near-duplicate vectors by sorted projection passes.

Copies of one vector are one node with a count. A pass hashes a label's nodes, less the label's mean (so that
a label that lies in a cone is told apart as well), to the signs of 64 random projections, puts them in the
lexicographic order of these bits, and compares each node with the ``WINDOW`` before it in double precision.
All passes of a round are one sort: it is dealt out by range, and a range is handed the last rows of those
before it, so that windows do not end at its border. Verified pairs of all passes are united.

A label that fits one window is compared whole. A larger one gets as many passes as a pair at the limit needs
to be missed with a chance of ``MISSED`` at most (from the chance that the leading bits agree), and further
rounds until one finds no new link. A pair counts in the first pass whose window holds it, which the places of its
nodes in the earlier passes tell, so that a range gives out one line per linked node (how many vectors it is
linked to there, and the head of those it hangs together with there), never pairs.

Where half of a window or more is linked, nodes are a crowd that no bounded window can count. Crowds are set
apart and compared with themselves tile by tile, work in proportion to their links; the passes leave pairs
inside a crowd out. All other work is nodes x window x passes. Measured recall is in the README.

Defined results: vectors without label or id, null, empty or zero vectors, and those with null or
non-finite components link with nothing: n_links 0, their own component, kept. Vectors are compared only
with others of their label and length. Repeated rows of an id count as further vectors, and an id on two
vectors is two rows of their own. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship
from .common import components, small, tasks

LIMIT = 0.93
# Rows before a row that it is compared with, bits of a hash, and the chance of missing a pair at the limit.
WINDOW, BITS, MISSED = 512, 64, 1e-4
# Further rounds of a label whose links have not stopped growing, and rows compared at once.
ROUNDS, BLOCK = 12, 1024
# Crowds: nodes of a tile at least, numbers (nodes times length) of a tile at most, and cosines held at once.
TILE, NUMBERS, COSINES = 512, 1 << 20, 1 << 21


def usable(vector: str) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole & (square > 0)


def _unit(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision (by the largest part first, against overflow)."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_for(size: int, window: int = WINDOW, limit: float = LIMIT, missed: float = MISSED) -> int:
    """Passes of a label of this size: one whole comparison, or enough for pairs at the limit."""
    if size <= window + 1:
        return 1
    agree = 1 - math.acos(limit) / math.pi
    return math.ceil(math.log(missed) / math.log(1 - agree ** math.log2(size / window)))


def _means(nodes: DataFrame) -> DataFrame:
    """(label, dim, size, mean): the mean unit vector of each label, summed up in the tasks first."""
    kind = nodes.schema["label"].dataType.simpleString()

    def part(batches):
        for batch in batches:
            for (label, dim), rows in batch.groupby(["label", "dim"], sort=False):
                yield pd.DataFrame({"label": [label], "dim": [dim], "size": [len(rows)], "mean": [_unit(rows["vector"]).sum(axis=0)]})

    def whole(rows):
        size = int(rows["size"].sum())
        return pd.DataFrame({"label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1], "size": [size], "mean": [np.sum(rows["mean"].tolist(), axis=0) / size]})

    schema = f"label {kind}, dim int, size bigint, mean array<double>"
    parts = nodes.select("label", "dim", "vector").mapInPandas(part, schema)
    return cut_lineage(parts.groupBy("label", "dim").applyInPandas(whole, schema))


def _keys(nodes: DataFrame, first: int, more: int | None, window: int, limit: float) -> DataFrame:
    """(pass, label, dim, key, node): a label's passes from number ``first`` on, as many as its size asks for or ``more``."""
    kind = nodes.schema["label"].dataType.simpleString()

    def run(batches):
        places = 1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            for (dim, size), rows in batch.groupby(["dim", "size"], sort=False):
                x = _unit(rows["vector"]) - np.stack(rows["mean"].tolist())
                for k in range(first, first + (more or passes_for(size, window, limit))):
                    planes = np.random.default_rng([k, dim]).standard_normal((dim, BITS))
                    key = (x @ planes >= 0).astype(np.uint64) @ places
                    yield pd.DataFrame({"pass": k, "label": rows["label"], "dim": dim, "key": (key ^ np.uint64(1 << 63)).view(np.int64), "node": rows["node"]})

    return nodes.mapInPandas(run, f"pass int, label {kind}, dim int, key bigint, node bigint")


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The heads after uniting the trees of linked rows (i, j)."""
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compared(x: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked vectors and head of each row, from all pairs of a row in ``left`` and one in ``right`` (both equal or disjoint)."""
    linked, root, same = np.zeros(len(x)), np.arange(len(x)), left is right
    step = max(1, COSINES // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at:at + step]
        near = x[some] @ x[right].T >= limit
        if same:
            near[np.arange(len(some)), at + np.arange(len(some))] = False
        if not near.any():
            continue
        linked[some] += near @ copies[right]
        if not same:
            linked[right] += copies[some] @ near
        near &= root[some][:, None] != root[right][None, :]
        i, j = np.nonzero(near)
        root = _united(root, some[i], right[j])
    return linked, root


def _crowd_links(nodes: DataFrame, limit: float = LIMIT, tile: int = TILE) -> DataFrame:
    """(node, linked, head) of all pairs of the given nodes of a label, tile by tile: for crowds, whose pairs are nearly all links."""
    sizes = cut_lineage(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    total = nodes.count()
    # enough pieces for all tasks when a label holds a large share
    wanted = max(tile, int(total / (2 * math.sqrt(tasks(nodes.sparkSession)))))
    tiles = F.ceil(F.col("n") / F.least(F.lit(wanted), F.greatest(F.lit(tile), F.floor(F.lit(NUMBERS) / F.col("dim"))))).cast("int")
    shelf = F.pmod(F.xxhash64("label", "dim"), F.lit(max(1, total // (4 * tile) + 1)))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (nodes.join(small(sizes), ["label", "dim"]).withColumn("tiles", tiles).withColumn("tile", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("place", F.when(F.col("tiles") == 1, shelf).otherwise(F.xxhash64("label", "dim")))
             .withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")))

    def compare(frame):
        out = []
        for _, part in frame.groupby(["label", "dim"], sort=False):
            x, copies, names = _unit(part["vector"]), part["copies"].to_numpy().astype(np.float64), part["node"].to_numpy()
            lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
            left = np.flatnonzero(part["tile"].to_numpy() == lo)
            right = left if lo == hi else np.flatnonzero(part["tile"].to_numpy() == hi)
            linked, root = _compared(x, copies, left, right, limit)
            hit = np.flatnonzero(linked)
            out.append(pd.DataFrame({"node": names[hit], "linked": linked[hit].astype(np.int64), "head": names[root[hit]]}))
        return pd.concat(out)

    return cut_lineage(dealt.groupBy("tiles", "place", "lo", "hi").applyInPandas(compare, "node bigint, linked bigint, head bigint"))


def _sorted(nodes: DataFrame, first: int, more: int | None, window: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """Passes in order: (to, own, place, pass, label, dim, node), a row for its range and for each whose first windows
    reach back to it; and (node, spots), a node's places in the passes."""
    keys = _keys(nodes, first, more, window, limit)
    order = ["pass", "label", "dim", "key", "node"]
    ranges = max(1, min(4 * tasks(nodes.sparkSession), nodes.count() * (more or 4) // (2 * window)))
    placed = cut_lineage(keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "pass", "label", "dim", "node", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = max(counts, default=0) + 1
    starts = np.concatenate([[0], np.cumsum([counts.get(r, 0) for r in range(ranges)])]).tolist()
    # the driver sees one number a range; rows of the last window before a range go to it as well
    begins = F.from_json(F.lit(str(starts[:ranges])), "array<bigint>")
    placed = placed.withColumn("place", F.get(begins, F.col("range")) + F.col("at"))
    later = F.filter(F.sequence(F.col("range") + 1, F.lit(ranges)), lambda r: (r < ranges) & (F.get(begins, r) > F.col("place")) & (F.get(begins, r) - window <= F.col("place")))
    near = F.when(F.get(begins, F.col("range") + 1) - window <= F.col("place"), later).otherwise(F.array().cast("array<int>"))
    dealt = placed.withColumn("to", F.explode(F.concat(F.array("range"), near))).withColumn("own", F.col("to") == F.col("range"))
    spots = placed.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"]).alias("spots"))
    return dealt.select("to", "own", "place", "pass", "label", "dim", "node"), cut_lineage(spots)


def _round(nodes: DataFrame, first: int, more: int | None, window: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """(node, linked, head, full) of the passes from ``first`` on, and the nodes with these passes' places in ``spots``.

    ``nodes``: label, dim, vector, node, copies, size, mean, crowd, spots (places in all passes before).
    """
    dealt, spots = _sorted(nodes, first, more, window, limit)
    nodes = cut_lineage(nodes.join(spots.withColumnRenamed("spots", "_new"), "node").withColumn("spots", F.concat("spots", "_new")).drop("_new"))
    met = dealt.join(nodes.select("node", "vector", "copies", "crowd", "spots"), "node")

    def compare(frame):
        frame = frame.sort_values("place", kind="stable")
        group = frame.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
        out = []
        for g in np.unique(group[frame["own"].to_numpy()]):
            part = frame.iloc[np.flatnonzero(group == g)]
            x, copies, names = _unit(part["vector"]), part["copies"].to_numpy().astype(np.float64), part["node"].to_numpy()
            place, own, crowd = part["place"].to_numpy(), part["own"].to_numpy(), part["crowd"].to_numpy()
            spot = np.stack(part["spots"].tolist())
            # this pass and those before it: a pair belongs to the first whose window holds it
            earlier = spot[:, :int(np.flatnonzero((spot == place[:, None]).all(axis=0))[-1])]
            linked, full, root = np.zeros(len(part)), np.zeros(len(part), bool), np.arange(len(part))
            for s in range(0, len(part), BLOCK):
                left, end = max(0, int(np.searchsorted(place, place[s] - window))), min(s + BLOCK, len(part))
                gap = place[s:end, None] - place[None, left:end]
                close = (x[s:end] @ x[left:end].T >= limit) & (gap > 0) & (gap <= window) & own[s:end, None]
                full[s:end] = 2 * close.sum(axis=1) >= window
                close &= ~(crowd[s:end, None] & crowd[None, left:end])
                i, j = np.nonzero(close)
                i, j = s + i, left + j
                for q in range(earlier.shape[1]):
                    fresh = np.abs(earlier[i, q] - earlier[j, q]) > window
                    i, j = i[fresh], j[fresh]
                np.add.at(linked, i, copies[j])
                np.add.at(linked, j, copies[i])
                root = _united(root, i, j) if len(i) else root
            hit = np.flatnonzero((linked > 0) | full)
            out.append(pd.DataFrame({"node": names[hit], "linked": linked[hit].astype(np.int64), "head": names[root[hit]], "full": full[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "linked": [], "head": [], "full": []})

    return cut_lineage(met.groupBy("to").applyInPandas(compare, "node bigint, linked bigint, head bigint, full boolean")), nodes


def linked_nodes(nodes: DataFrame, limit: float = LIMIT, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(node, linked, head): a line per linked node, range and pass, from (label, vector, node, copies)."""
    nodes = nodes.withColumn("dim", F.size("vector"))
    means = _means(nodes)
    nodes = cut_lineage(nodes.join(small(means), ["label", "dim"]).withColumns({"crowd": F.lit(False), "spots": F.array().cast("array<bigint>")}))
    found, after = _round(nodes, 0, None, window, limit)
    lines = [found]
    crowd = cut_lineage(found.where("full").select("node").distinct().withColumn("_crowd", F.lit(True)))
    if not crowd.isEmpty():
        nodes = cut_lineage(nodes.join(crowd, "node", "left").withColumn("crowd", F.coalesce("_crowd", F.lit(False))).drop("_crowd"))
        found, after = _round(nodes, 0, None, window, limit)
        lines = [found, _crowd_links(nodes.where("crowd").select("label", "dim", "vector", "node", "copies"), limit)]
    large = means.where(F.col("size") > window + 1).agg(F.max("size")).first()[0]
    if large is not None:
        wide, least = after.where(F.col("size") > window + 1), passes_for(large, window, limit)
        for k in range(rounds):
            found, wide = _round(wide, least * (k + 2), max(2, least // 2), window, limit)
            if found.where("linked > 0").isEmpty():
                break
            lines.append(found)
    return cut_lineage(reduce(DataFrame.unionByName, [x.select("node", "linked", "head") for x in lines]).where("linked > 0"))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
               limit: float = LIMIT, window: int = WINDOW) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"), F.lit(False)))
    # a node is a vector of a label, with a number of its own: an id may stand on several
    nodes = cut_lineage(rows.where("ok").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
                        .withColumn("node", F.monotonically_increasing_id()))
    links = linked_nodes(nodes.drop("least"), limit, window)
    counted = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    part = components(links.select(F.col("head").alias("a"), F.col("node").alias("b")))
    heads = nodes.join(part, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    told = part.join(heads, "component").select("node", "component_id")
    known = cut_lineage(nodes.join(told, "node", "left").join(counted, "node", "left")
                        .select("label", "vector", F.coalesce("component_id", "least").alias("component_id"),
                                (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    good = rows.where("ok").join(known, ["label", "vector"])
    good = good.select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
