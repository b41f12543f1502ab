"""Repair of conversation structure by the cheapest edits, in chunks that are solved side by side.

A conversation's rows in turn order are edited until their roles' initials read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 3, Delete 4 (all that blank and duplicate rows allow), Insert of an empty turn 3,
and a truncated row that stays 3 more. That is a shortest path over four states (nothing yet, after s, after u,
after a), a Viterbi recursion from the end of the conversation: the cost vector above a row gives the one below.

Rows are dealt out by range, so a conversation of any length is many chunks. The recursion converges in rank:
whatever vector a chunk starts from, after some rows the result differs by a constant only, which no decision
sees. So every chunk runs at once from a speculative vector, and fix-up passes rerun those whose neighbour came
to another vector, until no two differ by more than a constant. What has not converged after ``PASSES`` (rows
of unknown roles keep their parity for ever) is composed by doubling from 4 x 4 chunk costs instead, which is
as exact. The stitched backward costs then drive a trace from the front that takes the least initial that is
still cheapest (D, I, K, R); where a chunk's first state depends on earlier ones, the chunks' state maps are
composed by doubling too.

Defined results: null role and text are one space; rows of a null conversation are one conversation; null turns
come first; rows of one turn are in the order of role, the text's first 64 code points, digest (so repeated
rows follow each other); other columns are not read; an empty table gives an empty result. A conversation's
audit is one string and its digest is over one text, so these two are made in one task each, the digest as a
stream; everything else is split within a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship
from .common import WORD, numbered, ranged, tasks

# Rows of a chunk: 2^BITS.
BITS, PASSES = 9, 8
KEEP, INSERT, DELETE, REROLE, TRUNCATED = 0, 3, 4, 3, 3
BIG = 1 << 28
# Cells (chunks x rows) of a cost table that a task holds at a time.
CELLS = 1 << 20

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 4 stands for no way. What a written turn leads to:
NEXT = np.array([2, 2, 3, 2])
# Cost of the turns still wanted when the conversation ends in a state, and how many they are.
END, WANTED = [0, 2 * INSERT, INSERT, 0], np.array([0, 2, 1, 0])
# A row's code is 4 * initial (s, u, a, other) + fault (none, truncated, blank, duplicate); 16 is no row.
NONE = 16
_LEADS = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
LEADS = np.vstack([np.repeat(_LEADS, 4, axis=0), [[4] * 4]])
STAYS = np.array([0, TRUNCATED, BIG, BIG] * 4 + [0], np.int32)
LEGAL = ((0, 1), (1, 2), (2, 1))


def damage(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with the faults that crc32(conv:turn) % 20 names: 0 drops a row, 1 empties its
    text, 2 takes its end marks, 3 repeats it, 4 gives it to the user. Nulls in key, role and text are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = talks.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
                        F.coalesce(F.col(text), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_way"))
    way = F.col("_way")
    body = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(way != 0).select("conv", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
                                       F.explode(copies).alias("_copy")).drop("_copy")


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost vectors above each row, (rows + 1, chunks, 5), from the vectors below the last; rows are right-aligned."""
    table = np.full((codes.shape[1] + 1, len(codes), 5), BIG, np.int32)
    table[-1, :, :4] = ends
    for j in range(codes.shape[1] - 1, -1, -1):
        code, below = codes[:, j], table[j + 1]
        stays = STAYS[code][:, None]
        best = np.minimum(below[:, :4] + DELETE, stays + KEEP + np.take_along_axis(below, LEADS[code], 1))
        best = np.minimum(best, stays + REROLE + below[:, NEXT])
        best[:, 2], best[:, 3] = np.minimum(best[:, 2], best[:, 3] + INSERT), np.minimum(best[:, 3], best[:, 2] + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        table[j, :, :4] = np.where((code == NONE)[:, None], below[:, :4], best)
    return table


def trace(codes: np.ndarray, table: np.ndarray, state: np.ndarray):
    """From a state per chunk, the least of the cheapest edits: (inserts before, state at, edit) per row, last state."""
    chunks, rows = codes.shape
    each, before, at = np.arange(chunks), np.zeros((chunks, rows), np.int8), np.zeros((chunks, rows), np.int8)
    edits = np.zeros((chunks, rows), "S1")
    for j in range(rows):
        code, above, below = codes[:, j], table[j], table[j + 1]
        real = code != NONE
        for _ in range(len(NEXT)):
            cost, follow = above[each, state], NEXT[state]
            inserts = real & (below[each, state] + DELETE != cost) & (above[each, follow] + INSERT == cost)
            state = np.where(inserts, follow, state)
            before[:, j] += inserts
        at[:, j], cost = state, above[each, state]
        drop = below[each, state] + DELETE == cost
        lead = LEADS[code, state]
        keep = ~drop & (STAYS[code] + KEEP + below[each, lead] == cost)
        edits[:, j] = np.where(real, np.where(drop, b"D", np.where(keep, b"K", b"R")), b"")
        state = np.where(real, np.where(drop, state, np.where(keep, lead, NEXT[state])), state)
    return before, at, edits, state


def _groups(codes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of like length together: (places in the batch, right-aligned code matrix)."""
    sizes = np.array([len(c) for c in codes], np.int64)
    order, start = np.argsort(sizes, kind="stable"), 0
    while start < len(order):
        most = int(np.searchsorted(np.cumsum(sizes[order[start:]] + 1), CELLS)) + 1
        picked = order[start:start + most]
        # a long chunk at the end widens the whole matrix
        while len(picked) > 1 and len(picked) * (sizes[picked[-1]] + 1) > CELLS:
            picked = picked[:(len(picked) + 1) // 2]
        width = int(sizes[picked[-1]])
        matrix = np.full((len(picked), width), NONE, np.uint8)
        for i, p in enumerate(picked):
            matrix[i, width - sizes[p]:] = np.frombuffer(codes[p].encode(), np.uint8) - 65
        yield picked, matrix
        start += len(picked)


def _runs(chunks: DataFrame, ends: list[list[int]] | None = None) -> DataFrame:
    """Chunks with ``above``: the cost vector above their first row, from ``used`` or from each of the given vectors, flat."""
    def run(batches):
        for batch in batches:
            above = [None] * len(batch)
            for picked, matrix in _groups(batch["codes"].tolist()):
                given = [np.stack(batch["used"].iloc[picked].tolist())] if ends is None else [np.tile(e, (len(picked), 1)) for e in ends]
                found = np.hstack([np.minimum(backward(matrix, e)[0, :, :4], BIG) for e in given])
                for i, p in enumerate(picked):
                    above[p] = found[i]
            batch["above"] = pd.Series(above, index=batch.index, dtype=object)
            yield batch

    rows = chunks.select("talk", "no", "of", "codes", "used")
    return rows.mapInPandas(run, "talk string, no bigint, of bigint, codes string, used array<int>, above array<int>")


def _maps(chunks: DataFrame) -> DataFrame:
    """(talk, no, map): the state each of the four first states leads to."""
    def run(batches):
        for batch in batches:
            found = [None] * len(batch)
            for picked, matrix in _groups(batch["codes"].tolist()):
                table = backward(matrix, np.stack(batch["used"].iloc[picked].tolist()))
                ends = np.stack([trace(matrix, table, np.full(len(picked), s))[3] for s in range(4)], axis=1)
                for i, p in enumerate(picked):
                    found[p] = ends[i]
            yield pd.DataFrame({"talk": batch["talk"], "no": batch["no"], "map": pd.Series(found, index=batch.index, dtype=object)})

    return chunks.select("talk", "no", "codes", "used").mapInPandas(run, "talk string, no bigint, map array<int>")


def _level(vector: Column) -> Column:
    """A cost vector without its constant."""
    return F.transform(vector, lambda x: x - F.array_min(vector))


def _below(chunks: DataFrame, value: str) -> DataFrame:
    """``value`` of the next chunk, by number: keys are unique, so no conversation is a hot key."""
    return chunks.select("talk", (F.col("no") - 1).alias("no"), F.col(value).alias("_below"))


def stitch(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """Chunks (talk, no, of, codes) with ``used``, the true cost vector below their last row but for a constant."""
    end = F.array(*[F.lit(x).cast("int") for x in END])
    now = cut_lineage(_runs(chunks.withColumn("used", end)))
    for _ in range(passes):
        met = now.join(_below(now, "above"), ["talk", "no"], "left").withColumn("_want", F.coalesce(_level(F.col("_below")), end))
        stale = cut_lineage(met.where("_want != used").select("talk", "no", "of", "codes", F.col("_want").alias("used")))
        if stale.isEmpty():
            return now.select("talk", "no", "used")
        now = cut_lineage(now.join(stale.select("talk", "no"), ["talk", "no"], "left_anti").unionByName(_runs(stale)))
    return _composed(now)


def _composed(chunks: DataFrame) -> DataFrame:
    """The same by doubling over chunk costs: in each round a chunk's costs reach twice as far."""
    units = (np.full((4, 4), BIG, np.int64) - (BIG * np.eye(4)).astype(np.int64)).tolist()
    # flat, one row of four per last state: costs from each first state
    reach = cut_lineage(_runs(chunks, units).select("talk", "no", "of", F.col("no").alias("to"), F.col("above").alias("cost")))
    both = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.least(F.lit(BIG), F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("cost")[k * 4 + i % 4] + F.col("_cost")[F.floor(i / 4).cast("int") * 4 + k]))))
    while not reach.where("to < of").isEmpty():
        on = reach.select("talk", (F.col("no") - 1).alias("to"), F.col("to").alias("_to"), F.col("cost").alias("_cost"))
        reach = cut_lineage(reach.join(on, ["talk", "to"], "left").select(
            "talk", "no", "of", F.coalesce("_to", "to").alias("to"), F.when(F.col("_to").isNull(), F.col("cost")).otherwise(both).alias("cost")))
    vector = F.array(*[F.array_min(F.array(*[F.col("cost")[k * 4 + s] + END[k] for k in range(4)])) for s in range(4)])
    vectors = reach.select("talk", "no", vector.alias("above"))
    end = F.array(*[F.lit(x).cast("int") for x in END])
    return chunks.select("talk", "no").join(_below(vectors, "above"), ["talk", "no"], "left").select(
        "talk", "no", F.coalesce(_level(F.col("_below")), end).alias("used"))


def first_states(chunks: DataFrame) -> DataFrame:
    """(talk, no, start): the state before each chunk, by doubling over the chunks' state maps."""
    maps = cut_lineage(_maps(chunks))
    # steps: how the state before chunk `lo` becomes the state before this one
    now = maps.select("talk", (F.col("no") + 1).alias("no"), F.col("no").alias("lo"), F.col("map").alias("steps"))
    now = maps.select("talk", "no").join(now, ["talk", "no"], "left")
    only = F.array_min("steps") == F.array_max("steps")
    known = F.when(F.col("lo").isNull(), 0).when(only, F.col("steps")[0]).when(F.col("lo") == 1, F.col("steps")[0])
    now = cut_lineage(now.withColumn("start", known.cast("int")))
    while not now.where("start is null").isEmpty():
        at = now.select("talk", F.col("no").alias("lo"), F.col("lo").alias("_lo"), F.col("steps").alias("_steps"), F.col("start").alias("_start"))
        met = now.join(at, ["talk", "lo"], "left")
        further = F.transform("_steps", lambda s: F.get(F.col("steps"), s))
        met = met.select("talk", "no", F.col("_lo").alias("lo"), F.coalesce("start", F.get(F.col("steps"), F.col("_start"))).alias("start"),
                         F.when(F.col("_start").isNull(), further).alias("steps"))
        now = cut_lineage(met.withColumn("start", F.coalesce("start", F.when(only, F.col("steps")[0]))))
    return now.select("talk", "no", "start")


_EDITED = ("talk string, chunk bigint, first bigint, rows int, no bigint, of bigint, edits string, inserts string, states string, tail int, "
           "end int, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, left int, right int")


def _edited(chunks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            last = (batch["no"] == batch["of"]).to_numpy()
            out = [None] * len(batch)
            for picked, matrix in _groups(batch["codes"].tolist()):
                table = backward(matrix, np.stack(batch["used"].iloc[picked].tolist()))
                before, at, edits, state = trace(matrix, table, batch["start"].to_numpy()[picked])
                fault, kind = matrix % 4, matrix // 4
                tail = np.where(last[picked], WANTED[state], 0)
                real, held = matrix != NONE, (edits != b"D") & (matrix != NONE)
                pairs = [(kind[:, :-1] == a) & (kind[:, 1:] == b) for a, b in LEGAL]
                illegal = (real[:, :-1] & ~np.logical_or.reduce(pairs)).sum(1)
                cost = (DELETE * (edits == b"D").sum(1) + REROLE * (edits == b"R").sum(1) + INSERT * (before.sum(1) + tail)
                        + TRUNCATED * (held & (fault == 1)).sum(1))
                counts = [(real & (fault == f)).sum(1) for f in (2, 3, 1)]
                for i, p in enumerate(picked):
                    own = real[i]
                    letters, fills = edits[i, own].tobytes().decode(), before[i, own]
                    audit = "".join("I" * n + e for n, e in zip(fills, letters, strict=True)) if fills.any() else letters
                    out[p] = (letters, (fills + 48).astype(np.uint8).tobytes().decode(), (at[i, own] + 48).astype(np.uint8).tobytes().decode(),
                              int(tail[i]), int(state[i]), audit + "I" * int(tail[i]), int(cost[i]), *(int(c[i]) for c in counts), int(illegal[i]),
                              int(kind[i, own][0]), int(kind[i, own][-1]))
            made = pd.DataFrame(out, index=batch.index, columns=["edits", "inserts", "states", "tail", "end", "audit", "cost", "blank",
                                                                 "duplicate", "truncated", "illegal", "left", "right"])
            yield pd.concat([batch[["talk", "chunk", "first"]], batch["codes"].str.len().rename("rows"), batch[["no", "of"]], made], axis=1)

    return chunks.mapInPandas(run, _EDITED)


@dataclass(frozen=True)
class Repair:
    """Rows as read, in order; edits by chunk; a summary per conversation (all but the digest)."""

    rows: DataFrame
    chunks: DataFrame
    bits: int

    def turns(self) -> DataFrame:
        """(talk, place, edit, role, text): the repaired turns; places grow in order. Inserted turns have edit I."""
        spot = (F.col("id") - F.col("first") + 1).cast("int")
        at = [F.substring(c, spot, F.lit(1)) for c in ("edits", "inserts", "states")]
        edits = self.chunks.select("talk", "chunk", "first", "edits", "inserts", "states")
        met = self.rows.select("talk", F.shiftright("id", self.bits).alias("chunk"), "id", "role", "text").join(edits, ["talk", "chunk"]).select(
            "talk", "id", "role", "text", at[0].alias("edit"), at[1].cast("int").alias("fills"), at[2].cast("int").alias("state"))
        wanted = F.when(F.col("state") == 2, "assistant").otherwise("user")

        def turn(place: Column, edit: str | Column, role: Column, text: Column) -> Column:
            return F.struct(place.alias("place"), (F.lit(edit) if isinstance(edit, str) else edit).alias("edit"), role.alias("role"), text.alias("text"))

        def written(odd: Column) -> Column:
            return F.when(odd, "user").otherwise("assistant")

        # written turns alternate, and the last of them leads to the state: u to 2, a to 3
        fills = F.transform(F.filter(F.sequence(F.lit(0), F.col("fills")), lambda j: j < F.col("fills")), lambda j: turn(
            F.col("id") * 4 + j, "I", written((F.col("fills") - 1 - j + F.col("state")) % 2 == 0), F.lit("")))
        own = F.when(F.col("edit") == "D", F.array().cast("array<struct<place:bigint,edit:string,role:string,text:string>>")).otherwise(F.array(
            turn(F.col("id") * 4 + 3, F.col("edit"), F.when(F.col("edit") == "K", F.col("role")).otherwise(wanted), F.col("text"))))
        inside = met.select("talk", F.explode(F.concat(fills, own)).alias("_turn")).select("talk", "_turn.*")
        tails = self.chunks.where("tail > 0").select("talk", F.explode(F.transform(F.sequence(F.lit(1), F.col("tail")), lambda j: turn(
            (F.col("first") + F.col("rows")) * 4 - 1 + j, "I", written((F.col("tail") - j) % 2 == 1), F.lit("")))).alias("_turn"))
        return inside.unionByName(tails.select("talk", "_turn.*"))

    def summary(self) -> DataFrame:
        """(talk, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation."""
        spread = (self.rows.groupBy("talk", "turn").agg(F.count(F.lit(1)).alias("_n")).groupBy("talk")
                  .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")))
        parts = F.array_sort(F.collect_list(F.struct("no", "audit", "left", "right")))
        sums = self.chunks.groupBy("talk").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                               parts.alias("_parts"))
        pair = F.zip_with(F.slice("_parts", F.lit(1), F.size("_parts") - 1), F.slice("_parts", F.lit(2), F.size("_parts") - 1),
                          lambda a, b: a["right"] * 4 + b["left"])
        broken = F.size(F.filter(pair, lambda p: ~p.isin([4 * a + b for a, b in LEGAL])))
        whole = sums.select("talk", "blank", "duplicate", "truncated", (F.col("illegal") + broken).alias("illegal"), "cost",
                            F.array_join(F.transform("_parts", lambda p: p["audit"]), "").alias("audit"))
        return whole.join(spread, "talk")

    def digests(self) -> DataFrame:
        """(talk, repaired_sha256) of the turns as ``role:text``, newline-joined, read as a stream in order."""
        def run(batches):
            talk, state, done = None, None, []
            for batch in batches:
                for name, role, text in zip(batch["talk"], batch["role"], batch["text"], strict=True):
                    if name != talk:
                        if state is not None:
                            done.append((talk, state.hexdigest()))
                        talk, state = name, hashlib.sha256()
                        state.update(f"{role}:{text}".encode())
                    else:
                        state.update(f"\n{role}:{text}".encode())
                yield pd.DataFrame(done, columns=["talk", "repaired_sha256"])
                done = []
            if state is not None:
                yield pd.DataFrame([(talk, state.hexdigest())], columns=["talk", "repaired_sha256"])

        turns = self.turns().select("talk", "place", "role", "text")
        return (turns.repartition(tasks(turns.sparkSession), "talk").sortWithinPartitions("talk", "place")
                .mapInPandas(run, "talk string, repaired_sha256 string"))


def talk_key(conv: Column) -> Column:
    """The conversation as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS,
           passes: int = PASSES) -> Repair:
    ship(talks.sparkSession)
    blank = F.lit(" ")
    rows = talks.select(talk_key(F.col(conv)).alias("talk"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
                        F.coalesce(F.col(text), blank).alias("text"))
    same = F.unhex(F.md5(F.concat(F.length("talk").cast("string"), F.lit(":"), "talk", F.length("role").cast("string"), F.lit(":"), "role", "text")))
    order = [F.col("talk"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("same")]
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("same", same).repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut_lineage(rows.select(
        "talk", "turn", "role", "text", "same", F.monotonically_increasing_id().alias("id"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")))
    seen = placed.groupBy("same").agg(F.min("id").alias("_seen"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    fault = F.when(F.col("blank"), 2).when(F.col("id") > F.col("_seen"), 3).when(F.col("cut"), 1).otherwise(0)
    facts = placed.select("talk", "same", "id", "kind", "blank", "cut").join(seen, "same", "left").select(
        "talk", "id", F.char(F.lit(65) + 4 * F.col("kind") + fault).alias("code"))
    grouped = facts.groupBy("talk", F.shiftright("id", bits).alias("chunk")).agg(
        F.min("id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda r: r["code"]), "").alias("codes"))
    chunks = numbered(ranged(grouped, F.col("talk"), F.col("first")), ["talk"], [F.col("first")], "no")
    chunks = cut_lineage(chunks.join(chunks.groupBy("talk").agg(F.count(F.lit(1)).alias("of")), "talk").select(
        "talk", "chunk", "first", "codes", F.col("no").cast("bigint").alias("no"), "of"))
    # a conversation that lies in one chunk needs no stitching
    many = chunks.where("of > 1")
    many = many.join(stitch(many.select("talk", "no", "of", "codes"), passes), ["talk", "no"])
    many = cut_lineage(many)
    many = many.join(first_states(many), ["talk", "no"])
    end = F.array(*[F.lit(x).cast("int") for x in END])
    alone = chunks.where("of = 1").withColumn("used", end).withColumn("start", F.lit(0))
    edited = cut_lineage(_edited(alone.unionByName(many)))
    return Repair(placed, edited, bits)


def audit(talks: DataFrame, conv: str = "conv_id", **names) -> DataFrame:
    """Every conversation of ``talks`` after ``damage`` and ``repair``: summary and digest; zeros where no row is left."""
    fixed = repair(damage(talks, conv, **names), "conv")
    found = fixed.summary().join(fixed.digests(), "talk", "left")
    every = talks.select(F.col(conv).alias("_conv"), talk_key(F.col(conv)).alias("talk")).groupBy("_conv", "talk").agg(F.count(F.lit(1)).alias("_n"))
    met = every.join(found, "talk", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("_conv").alias(conv), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
