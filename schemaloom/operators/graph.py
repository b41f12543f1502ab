"""Degrees, neighbourhoods, lineage and levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import TABLE_RESOURCE_TYPES
from ..functions.scores import hub_weight
from ..functions.text import call_label, parse_call
from ..session import cut_lineage, ship
from .relations import edge_order
from .resolve import resolve_calls


# Nodes (of some 100 bytes) that one task may hold to finish a chain in memory.
FEW = 1 << 20


def _ends(edges: DataFrame, scope: list[str]) -> DataFrame:
    return edges.select(*scope, F.explode(F.array("from_key", "to_key")).alias("node"))


def degree(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Edge ends per node; an edge from a node to itself does not count."""
    return (_ends(edges.where("from_key <> to_key"), scope).groupBy(*scope, "node")
            .agg(F.count(F.lit(1)).alias("degree")))


def edge_weights(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Weight of each edge from the busier of its two ends."""
    degrees = degree(edges, scope)
    a = degrees.withColumnRenamed("node", "from_key").withColumnRenamed("degree", "_a")
    b = degrees.withColumnRenamed("node", "to_key").withColumnRenamed("degree", "_b")
    return (edges.where("from_key <> to_key").join(a, [*scope, "from_key"], "left")
            .join(b, [*scope, "to_key"], "left").withColumn("weight", hub_weight("_a", "_b")).drop("_a", "_b"))


def neighbours(edges: DataFrame, key: str, scope: list[str], tables: DataFrame | None = None) -> DataFrame:
    """The node and its one-hop neighbours in both directions.

    ``tables`` (scope, node): a listed node without edges is its own result.
    """
    out = edges.where(F.col("from_key") == key).select(*scope, F.explode(F.array(F.lit(key), "to_key")).alias("node"))
    back = edges.where(F.col("to_key") == key).select(*scope, F.explode(F.array(F.lit(key), "from_key")).alias("node"))
    found = out.unionByName(back)
    if tables is not None:
        found = found.unionByName(tables.where(F.col("node") == key).select(*scope, "node"))
    return found.distinct()


def orphans(tables: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """Tables no edge touches. ``tables`` has ``node``; the ends are made distinct before the join."""
    return tables.join(_ends(edges, scope).distinct(), [*scope, "node"], "left_anti")


def focus_edges(edges: DataFrame, key: str) -> DataFrame:
    return edges.withColumn("connected", (F.col("from_key") == key) | (F.col("to_key") == key))


def lineage_from_artifacts(entries: DataFrame) -> DataFrame:
    """Recorded dependencies -> upstream-to-downstream raw edges between tables."""
    known = entries.select("project", "uid", "display_name")
    tables = entries.where((F.col("kind") != "source") & F.col("resource_type").isin(*TABLE_RESOURCE_TYPES))
    deps = tables.select("project", F.col("display_name").alias("to_table"), F.col("ord").alias("_entry"),
                         F.posexplode("depends_on").alias("pos", "uid"))
    return deps.join(known, ["project", "uid"]).select(
        "project", F.col("display_name").alias("from_table"), F.array().cast("array<string>").alias("from_cols"),
        "to_table", F.array().cast("array<string>").alias("to_cols"),
        edge_order(0, "_entry", "pos").alias("ord"))


def sql_calls(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """Every ref and source call of a script, in order, as (.., pos, call)."""
    calls = F.regexp_extract_all(F.col(sql), F.lit(r"\b(?:ref|source)\s*\([^)]*\)"), F.lit(0))
    return (scripts.select(*[c for c in scripts.columns if c != sql], F.posexplode_outer(calls).alias("pos", "_text"))
            .withColumn("call", parse_call("_text")).where(F.col("call").isNotNull()).drop("_text"))


def lineage_from_sql(scripts: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls in model scripts -> raw edges; an unresolved call keeps its label as from-side.

    ``scripts``: project, to_table, sql, ord.
    """
    resolved = resolve_calls(sql_calls(scripts), entries, "call", "called")
    return resolved.select(
        "project", F.coalesce("called.display_name", call_label("call")).alias("from_table"),
        F.array().cast("array<string>").alias("from_cols"), "to_table",
        F.array().cast("array<string>").alias("to_cols"),
        F.struct(F.col("ord").alias("script"), "pos").alias("ord")).where("from_table <> ''")


def _anchors(single: DataFrame, scope: list[str], rounds: list | None = None) -> DataFrame:
    """Nodes with one open parent -> (.., node, up, a, b): level = max(level of up + a, b), ``up`` no such node itself.

    Pointer jumping: each round a node takes over what its target points at, so the steps behind a
    pointer double. Such bounds compose, so nothing is lost on the way. Only nodes that have not arrived
    are moved again. A node that has not arrived after as many steps as there are nodes it could pass
    hangs on a ring: its ``up`` is null.
    """
    key = [*scope, "node"]
    steps = single.select(*key, "up", "a", F.col("base").alias("b"))
    inner = single.select(*scope, F.col("node").alias("up"), F.lit(True).alias("_more"))
    first = cut_lineage(steps.join(inner, [*scope, "up"], "left").select(*key, "up", "a", "b", F.col("_more").isNull().alias("done")))
    arrived, waiting = [first.where("done")], first.where("not done")
    span, enough = 1, None
    pointed = [F.col("node").alias("up"), F.col("up").alias("_up"), F.col("a").alias("_a"), F.col("b").alias("_b")]
    over = [F.col("_up").alias("up"), (F.col("a") + F.coalesce("_a", F.lit(0))).alias("a"),
            F.greatest("b", F.col("_b") + F.col("a")).alias("b")]
    while (left := waiting.count()) > 0:
        if left <= FEW:
            # whoever still waits comes to a node that has arrived, or to a ring
            target = reduce(DataFrame.unionByName, arrived).select(*scope, *pointed)
            arrived.append(cut_lineage(_jumped(waiting, scope).join(target, [*scope, "up"], "left").select(*key, *over, F.lit(True).alias("done"))))
            break
        enough = left + span if enough is None else min(enough, left + span)
        if span >= enough:
            arrived.append(waiting.withColumn("up", F.lit(None).cast(waiting.schema["up"].dataType)))
            break
        target = reduce(DataFrame.unionByName, [*arrived, waiting]).select(*scope, *pointed, F.col("done").alias("_done"))
        moved = cut_lineage(waiting.join(target, [*scope, "up"]).select(*key, *over, F.col("_done").alias("done")))
        arrived.append(moved.where("done"))
        waiting, span = moved.where("not done"), 2 * span
        if rounds is not None:
            rounds.append(left)
    return reduce(DataFrame.unionByName, arrived).drop("done")


def _jumped(waiting: DataFrame, scope: list[str]) -> DataFrame:
    """At most ``FEW`` nodes with the last of them that each comes to, in one task and in memory; ``up`` is where that one points."""
    names = [*scope, "node"]

    def run(batches):
        rows = pd.concat(list(batches), ignore_index=True)
        places = pd.MultiIndex.from_frame(rows[names])
        at = places.get_indexer(pd.MultiIndex.from_frame(rows[[*scope, "up"]].set_axis(names, axis=1)))
        a, b = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)
        # a node whose hop leaves the set is where the others stop
        end = np.flatnonzero(at < 0)
        at[end], hop = end, a.copy()
        hop[end], least = 0, b.copy()
        least[end] = 0
        for _ in range(int(len(rows)).bit_length() + 1):
            least, hop, at = np.maximum(least, least[at] + hop), hop + hop[at], at[at]
        arrived = np.zeros(len(rows), bool)
        arrived[end] = True
        held = arrived[at]
        ring = pd.Series([None] * len(rows), dtype=object)
        out = rows.assign(up=rows["up"].astype(object).take(at).reset_index(drop=True).where(held, ring),
                          a=np.where(held, hop + a[at], a), b=np.where(held, np.maximum(least, b[at] + hop), b), done=True)
        yield out

    return waiting.coalesce(1).mapInPandas(run, waiting.schema)


def lineage_levels(edges: DataFrame, scope: list[str] | None = None, rounds: list | None = None) -> DataFrame:
    """Depth of each node from the roots (longest path) -> (.., node, level, cyclic).

    Each phase places the nodes without an open parent and contracts those with one: a chain's nodes
    follow the node at its upper end at a known distance, however long it is, and edges that started in
    the chain start at that end. Parallel edges keep the longest. So a chain, and a chain of diamonds, takes
    a few phases of logarithmically many rounds, and only a mesh takes a phase per layer. What is placed or
    follows leaves the state; followers get their levels at the end, last phase first. What remains when
    no node can be placed lies on a cycle or below one: ``level`` is null and ``cyclic`` true.

    ``rounds`` collects, for tests, one number per phase and per jump.
    """
    scope = scope or []
    ship(edges.sparkSession)
    key = [*scope, "node"]
    opened = cut_lineage(edges.select(*scope, "from_key", "to_key").where("from_key <> to_key").distinct().withColumn("w", F.lit(1).cast("bigint")))
    nodes = None
    known: list[DataFrame] = []
    followers: list[DataFrame] = []
    while True:
        # both ends of every edge, and what is known of the nodes, folded to one row a node
        end = [F.struct(F.col("to_key").alias("node"), F.lit(1).alias("n"), F.col("from_key").alias("up"), F.col("w").alias("a")),
               F.struct(F.col("from_key").alias("node"), F.lit(0).alias("n"), F.lit(None).alias("up"), F.lit(None).alias("a"))]
        ends = opened.select(*scope, F.inline(F.array(*end))).withColumn("base", F.lit(0).cast("bigint"))
        if nodes is not None:
            ends = ends.unionByName(nodes.withColumns({"n": F.lit(0), "up": F.lit(None), "a": F.lit(None)}))
        state = cut_lineage(ends.groupBy(*key).agg(F.sum("n").alias("parents"), F.min("up").alias("up"), F.max("a").alias("a"), F.max("base").alias("base")))
        free = state.where("parents = 0").select(*key, F.col("base").alias("level"))
        if free.isEmpty():
            break
        if rounds is not None:
            rounds.append(0)
        known.append(free)
        single, several = state.where("parents = 1"), state.where("parents > 1")
        following = None
        if not single.isEmpty():
            following = _anchors(single, scope, rounds)
            met = cut_lineage(following.join(free.select(*scope, F.col("node").alias("up"), "level"), [*scope, "up"], "left"))
            known.append(met.where("level is not null").select(*key, F.greatest(F.col("level") + F.col("a"), "b").alias("level")))
            following = met.where("level is null").select(*key, "up", "a", "b")
            followers.append(following)
        if several.isEmpty():
            state = None
            break
        # where each edge into what is left comes from now: a known level, another start, or its old one
        none = F.lit(None)
        at = reduce(DataFrame.unionByName, [
            k.select(*key, none.cast(opened.schema["from_key"].dataType).alias("up"), none.cast("bigint").alias("a"), none.cast("bigint").alias("b"), "level")
            for k in known[-2 if following is not None else -1:]]
            + ([following.withColumn("level", none.cast("bigint"))] if following is not None else []))
        at = at.withColumnRenamed("node", "from_key").withColumn("_moved", F.lit(True))
        into = opened.join(several.select(*scope, F.col("node").alias("to_key")), [*scope, "to_key"], "left_semi")
        # a follower of a ring blocks what it leads to, as an edge of that node to itself
        start = F.when(F.col("level").isNotNull(), none).when(F.col("_moved"), F.coalesce("up", "to_key")).otherwise(F.col("from_key"))
        turned = cut_lineage(into.join(at, [*scope, "from_key"], "left").select(
            *scope, start.alias("from_key"), "to_key", (F.col("w") + F.coalesce("a", F.lit(0))).alias("w"),
            (F.coalesce("level", "b", F.lit(0)) + F.when(F.col("_moved"), F.col("w")).otherwise(0)).alias("least")))
        opened = turned.where("from_key is not null").groupBy(*scope, "from_key", "to_key").agg(F.max("w").alias("w"))
        least = turned.groupBy(*scope, F.col("to_key").alias("node")).agg(F.max("least").alias("_least"))
        nodes = several.select(*key, "base").join(least, key).select(*key, F.greatest("base", "_least").alias("base"))
    levels = [k.select(*key, "level", F.lit(False).alias("cyclic")) for k in known]
    if state is not None:
        levels.append(state.select(*key, F.lit(None).cast("bigint").alias("level"), F.lit(True).alias("cyclic")))
    done = reduce(DataFrame.unionByName, levels)
    for following in reversed(followers):
        above = done.select(*scope, F.col("node").alias("up"), F.col("level").alias("_level"))
        # below a ring nothing is known: greatest() would pass over the null
        level = F.when(F.col("_level").isNotNull(), F.greatest(F.col("_level") + F.col("a"), "b"))
        found = following.join(above, [*scope, "up"], "left").select(*key, level.alias("level"))
        done = done.unionByName(cut_lineage(found.withColumn("cyclic", F.col("level").isNull())))
    return done


def cluster_members(tables: DataFrame, scope: list[str], group: str = "group") -> DataFrame:
    """Cluster node -> member rows; ungrouped tables have none.

    One row per member: a cluster may hold a third of the fleet and is not gathered into an array.
    """
    return tables.where(F.col(group) != "").select(
        *scope, F.concat(F.lit("cluster::"), F.col(group)).alias("cluster"), F.col("node").alias("member"))

