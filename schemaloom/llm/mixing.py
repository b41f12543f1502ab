"""Mixing sources to target weights by systematic sampling.

A source's documents are put in order of size (ties by a digest of the id), their expected copies
(target / source size, the same for all) are summed up along that order, one random offset of the source
is added, and a document is taken once for each whole number its step crosses. Neighbours in size stand
for each other, so the words taken differ from the target by about one document.

Defined results: null text has size 0; a source of only empty texts has target 0. Sources are put in code
point order, null last, and weigh 3, 1, 2, repeating. Repeated rows are documents of their own. ``mix``
returns the columns below whatever else the input has; ``taken_rows`` returns the input's columns, each
row as often as it was taken. Offsets come from a digest of the seed and the source, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, cut, numbered, ranged, small

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"

# Rows with their copies that may be sent to every task (about 150 bytes each), so that no text is shuffled.
SENT_ROWS = 500_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per source: number, size, target words and offset. Sources are few next to documents.

    The level at which shares meet their caps is found along the order of cap / weight: the first
    source that can take its share of what is left, and all after it, take it; those before are full. Any later
    source would give a lower level, so the level sought is the highest that a source can take.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    given = sums.select("source", "source_size", n.alias("source_no"), weight.alias("weight"),
                        (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    along = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(along.rowsBetween(W.currentRow, W.unboundedFollowing)))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = given.withColumn("level", level)
    found = levels.withColumn("best", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole))
    target = F.least("cap", F.coalesce(F.col("best") * F.col("weight"), F.col("cap")))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\x00"))))
    offset = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536
    return cut(found.select("source", "source_no", "source_size", target.alias("target"), offset.alias("offset")), 1)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per document."""
    sized = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"),
                                    words_in(F.col(text)).alias("size")))
    quota = targets(sized, **settings)
    joined = sized.join(quota, sized["source"].eqNullSafe(quota["source"])).drop(quota["source"])
    tie = F.md5(F.col("id").cast("string"))
    order = [F.col("source_no"), F.col("size"), F.col("tie").asc_nulls_last(), F.col("id").asc_nulls_last()]
    placed = numbered(ranged(joined.withColumn("tie", tie), *order), ["source_no"], order[1:], "place")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = (F.floor(step * F.col("place") + F.col("offset")) - F.floor(step * (F.col("place") - 1) + F.col("offset"))).cast("bigint")
    return placed.withColumn("copies", crossed).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def taken_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of the input as often as it is taken.

    Rows known by id, source and size meet their copies in one exchange of the texts (none where the copies are few enough to be
    sent to them); only repeated ones are put in order first.
    """
    keys = ["_id", "_source", "_size"]
    chosen = cut_lineage(mix(docs, id_col, text, source, **settings).select(
        F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.col(source).alias("_source"),
                       words_in(F.col(text)).alias("_size"))
    total = chosen.count()
    repeated = cut(chosen.groupBy(*keys).count().where("count > 1").select(*keys), total)

    def met(left, right, on, how="inner"):
        return left.join(right, [left[c].eqNullSafe(right[c]) for c in on], how)

    def sent(copies):
        return F.broadcast(copies) if total <= SENT_ROWS else copies

    if repeated.isEmpty():
        taken = met(rows, sent(chosen.where("copies > 0")), keys).select("_doc", "copies")
    else:
        taken = met(rows, sent(met(chosen.where("copies > 0"), small(repeated), keys, "leftanti")), keys).select("_doc", "copies")
        # repeated rows are told apart by a count of their own, inside one id
        again = W.partitionBy(*keys)
        wanted = met(chosen.where("copies > 0"), small(repeated), keys, "leftsemi").withColumn(
            "_row", F.row_number().over(again.orderBy(F.col("copies").desc())))
        several = met(rows, small(repeated), keys, "leftsemi").withColumn("_row", F.row_number().over(again.orderBy(F.col(f"_doc.{text}"))))
        taken = taken.unionAll(met(several, wanted, [*keys, "_row"]).select("_doc", "copies"))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
