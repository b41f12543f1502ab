"""Members of large JSON documents, found by many tasks at once.

A manifest is one object whose sections (``nodes``, ``sources``) are objects with one member per node.
Read as one document it is one task, however large. Here the file is read as text cut at every closing
brace, which the text source splits like any other file. Two running sums over the pieces, taken inside the
blocks of the file and carried over between them, tell each piece whether it starts inside a string and how
deep: the number of quotes before it, and of brackets outside strings. A member of a section is then the
run of pieces up to one that closes at depth two, so a task never holds more than a member's text.

A document is an object of objects of objects; members of a section that are not objects themselves are
passed over. Text after the document's end is ignored; an empty file has no members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = rf'\[(?:{_STRING}|[^\[\]"{{}}])*+\]'
_ARRAY = rf'\[(?:{_STRING}|[^\[\]"{{}}]|{_FLAT})*+\]'
_VALUE = rf'(?:{_STRING}|{_ARRAY}|[^\s,{{}}\[\]"]++)'
# members that are no objects, then the name of one that is
_NAME = rf'(?:{_STRING}\s*+:\s*+{_VALUE}\s*+,\s*+)*+({_STRING})\s*+:\s*+'
SECTION = rf"(?s)\A\s*+[{{,]?\s*+{_NAME}\{{"
MEMBER = rf"(?s)\A\s*+,?\s*+{_NAME}(?=\{{)"


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _features(value: Column) -> list[Column]:
    """Quotes of a piece, and the levels it adds when it starts outside (``_d0``) or inside (``_d1``) a string."""
    bare = F.regexp_replace(value, r"(?s)\\.", "")

    def levels(text: Column) -> Column:
        outside = F.regexp_replace(text, r'"[^"]*+"?', "")
        return _count(outside, "{") + _count(outside, "[") - _count(outside, "]")

    return [_count(bare, '"').alias("_quotes"), levels(bare).alias("_d0"), levels(F.regexp_replace(bare, r'\A[^"]*+"?', "")).alias("_d1")]


def _running(rows: DataFrame, value: str, into: str) -> DataFrame:
    """Sum of a value over the pieces of the file before this one: inside its block, and over the blocks before."""
    key = ["file", "block"]
    before = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.sum(value).alias("_n"))
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(*key, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_offset"))
    return (rows.withColumn("_inside", F.coalesce(F.sum(value).over(before), F.lit(0))).join(offsets, key)
            .withColumn(into, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset"))


def split_members(spark: SparkSession, paths, glob: str, more_than: int = -1) -> DataFrame:
    """(file, section, pos, key, text) of the files larger than ``more_than`` bytes; pos counts within a section."""
    pieces = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").text(paths)
              .where(F.col("_metadata.file_size") > more_than)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value"))
    return members_of(cut_lineage(pieces))


def members_of(pieces: DataFrame) -> DataFrame:
    """Pieces (file, block, at, value) of documents cut at their closing braces -> members."""
    narrow = _running(pieces.select("file", "block", "at", *_features(F.col("value"))), "_quotes", "_before")
    odd = F.col("_before") % 2 == 1
    closes = (F.col("_before") + F.col("_quotes")) % 2 == 0
    turned = cut_lineage(narrow.select("file", "block", "at", closes.alias("closes"),
                                       (F.when(odd, F.col("_d1")).otherwise(F.col("_d0")) - F.when(closes, 1).otherwise(0)).alias("_levels")))
    deep = _running(turned, "_levels", "depth")
    # a run of pieces ends where a brace outside strings closes a member, a section or the document
    ends = F.when(F.col("closes") & (F.col("depth") + F.col("_levels") <= 2), 1).otherwise(0)
    runs = _running(cut_lineage(deep.select("file", "block", "at", "depth", (F.col("depth") + F.col("_levels")).alias("after"), ends.alias("_end"))),
                    "_end", "run")
    whole = (pieces.join(runs.select("file", "block", "at", "depth", "after", "run"), ["file", "block", "at"]).groupBy("file", "run")
             .agg(F.array_sort(F.collect_list(F.struct("block", "at", "value", "depth", "after"))).alias("p")))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    runs = cut_lineage(whole.select("file", "run", text.alias("text"), F.col("p")[0]["depth"].alias("depth"), F.element_at("p", -1)["after"].alias("after")))
    # a document has as many sections as it has top-level names
    sections = (runs.where("depth < 2").select("file", "run", F.regexp_extract("text", SECTION, 1).alias("section")).where("section <> ''")
                .groupBy("file").agg(F.array_sort(F.collect_list(F.struct("run", "section"))).alias("sections")))
    inside = F.when(F.col("depth") < 2, F.regexp_replace("text", SECTION, "")).otherwise(F.col("text"))
    members = runs.where("after = 2").withColumn("text", inside).join(sections, "file").select(
        "file", "run", F.element_at(F.filter("sections", lambda s: s["run"] <= F.col("run")), -1)["section"].alias("section"),
        F.regexp_extract("text", MEMBER, 1).alias("key"), F.concat(F.regexp_replace("text", MEMBER, ""), F.lit("}")).alias("text"))
    first = members.groupBy("file", "section").agg(F.min("run").alias("_first"))

    def plain(name: str) -> Column:
        return F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>")[0]

    return members.join(first, ["file", "section"]).select(
        "file", plain("section").alias("section"), (F.col("run") - F.col("_first")).cast("bigint").alias("pos"), plain("key").alias("key"), "text")
