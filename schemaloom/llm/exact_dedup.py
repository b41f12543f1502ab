"""Exact duplicates by a two-pass Bloom filter, with DataFrame functions only.

Pass one counts Bloom slots over all text digests (two slots per digest inside one 64-bit word, combined
before the shuffle) and keeps the slots that were hit twice or more, as a table (word, bits). Pass two
tests every row against it: a row whose slots are not all repeated is the only one of its text and
passes straight through; the others ("possibly repeated", false positives included) meet by digest.
The answer never depends on the filter's size, only the number of rows that are shuffled does.

Defined results: a null text counts as empty; white space runs count as one space; of equal texts the
smallest doc_id stays, null ids last. Repeated rows of the staying id are all marked kept (one id), while
``dedup`` returns one row. Extra columns are carried, columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import FILE_ROWS, SPACE, cut, small

# Filter slots per row (a power of two of slots is taken, at least this many per row).
SLOTS_PER_ROW = 16

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(words))


def _places() -> list[Column]:
    second = F.xxhash64("text_sha256", F.lit(1))
    return [F.shiftright(second, n).bitwiseAND(F.lit(63)).cast("int") for n in (0, 6)]


def repeated_slots(digests: DataFrame) -> tuple[DataFrame, int]:
    """(word, bits) of all Bloom slots that two or more rows hit, and the number of words."""
    rows = digests.count()
    words = 1 << max(6, (rows * SLOTS_PER_ROW // 64).bit_length())
    slots = digests.select(F.explode(F.array(*[_word(words) * 64 + p for p in _places()])).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    table = twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return cut(table, rows), words


def _tested(rows: DataFrame, table: DataFrame, words: int) -> DataFrame:
    """Rows with ``_again``: all their slots are repeated ones."""
    mask = F.lit(0).cast("bigint")
    for place in _places():
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    probe = rows.withColumn("_word", _word(words))
    return (probe.join(small(table), F.col("_word") == F.col("word"), "left")
            .withColumn("_again", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)))
            .drop("_word", "word", "bits"))


def _marked(rows: DataFrame, digests: DataFrame, id_col: str) -> DataFrame:
    """Rows that have text_sha256, with keep_id, group_size and kept; only possibly repeated ones are shuffled."""
    size = digests.count()
    table, words = repeated_slots(digests)
    groups = cut(_tested(digests, table, words).where("_again").groupBy("text_sha256")
                 .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), size)
    tested = _tested(rows, table, words)
    alone = tested.where("not _again").withColumn("keep_id", F.col(id_col)).withColumn("group_size", F.lit(1).cast("bigint"))
    met = (tested.where("_again").join(groups, "text_sha256", "left")
           .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
           .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint"))))
    out = [*rows.columns, "keep_id", "group_size"]
    return alone.select(*out).unionAll(met.select(*out)).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def _digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return cut_lineage(docs.select(F.col(id_col).alias("id"), digest(text).alias("text_sha256")))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row; the texts are read once."""
    digests = _digests(docs, id_col, text)
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-digests.count() // FILE_ROWS))
    return _marked(digests.withColumnRenamed("id", id_col), digests, id_col).coalesce(files)


def annotate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with keep_id, group_size, kept and text_sha256."""
    rows = docs.drop(*RESULT).withColumn("text_sha256", digest(text))
    return _marked(rows, _digests(docs, id_col, text), id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, with the input's columns; rows of a single text are not shuffled."""
    kept = annotate(docs, id_col, text).where("kept")
    once = kept.where("group_size = 1")
    firsts = kept.where("group_size > 1")
    rest = [c for c in firsts.columns if c != "text_sha256"]
    folded = (firsts.groupBy("text_sha256").agg(F.first(F.struct(*rest)).alias("_row"))
              .select(*[f"_row.{c}" if c != "text_sha256" else c for c in firsts.columns]))
    lost = [F.col(c) if c not in RESULT else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return once.unionAll(folded).select(*lost)
