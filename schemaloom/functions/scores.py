"""Hashes and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col

# Contract of the fuzzy score.
SUBSTRING_SCORE = 1000
STEP_SCORE = 1
RUN_SCORE = 6
# Fixed value: cap on the weight a hub adds to its edges.
HUB_CAP = 12


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def hash_bucket(value, buckets: int = 10) -> Column:
    """Rolling x31 hash over UTF-16 units, modulo 2^32, then modulo the bucket count."""

    def step(h, unit):
        return F.pmod(h * 31 + unit, F.lit(4294967296))

    def per_char(h, char):
        point = F.ascii(char).cast("bigint")
        high = F.lit(0xD800) + F.floor((point - 0x10000) / 1024)
        low = F.lit(0xDC00) + (point - 0x10000) % 1024
        return F.when(point < 0x10000, step(h, point)).otherwise(step(step(h, high), low))

    code = F.aggregate(_chars(as_col(value)), F.lit(0).cast("bigint"), per_char)
    return F.pmod(code, F.lit(buckets)).cast("bigint")


def fuzzy_score(query: str, text) -> Column:
    """0 for an empty query, 1000-index for a substring, greedy in-order score, else -1."""
    query = query.lower()
    if not query:
        return F.lit(0).cast("bigint")
    text = F.lower(F.coalesce(as_col(text), F.lit("")))
    found = F.instr(text, query)
    wanted = F.array(*[F.lit(c) for c in query])
    start = F.struct(*[F.lit(v).cast("int").alias(k)
                       for k, v in (("at", -1), ("next", 0), ("score", 0), ("last", -2))])

    def per_char(state, char):
        at = state["at"] + 1
        hit = (state["next"] < len(query)) & (char == F.get(wanted, state["next"]))
        gain = F.when(state["last"] == at - 1, RUN_SCORE).otherwise(STEP_SCORE)
        return F.struct(
            at.alias("at"),
            F.when(hit, state["next"] + 1).otherwise(state["next"]).alias("next"),
            F.when(hit, state["score"] + gain).otherwise(state["score"]).alias("score"),
            F.when(hit, at).otherwise(state["last"]).alias("last"),
        )

    greedy = F.aggregate(
        _chars(text), start, per_char,
        lambda s: F.when(s["next"] == len(query), s["score"]).otherwise(-1))
    return F.when(found > 0, SUBSTRING_SCORE - (found - 1)).otherwise(greedy).cast("bigint")


def hub_weight(degree_a, degree_b) -> Column:
    busiest = F.greatest(F.coalesce(as_col(degree_a), F.lit(0)), F.coalesce(as_col(degree_b), F.lit(0)))
    return (F.lit(1) + F.least(busiest, F.lit(HUB_CAP))).cast("bigint")
