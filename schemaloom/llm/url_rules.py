"""URL rules by a sort-merge range join, with DataFrame functions only.

A host's key is its labels in reverse, each followed by a dot (``www.example.net`` is
``net.example.www.``), so a host and its subdomains are one interval: from ``net.example.`` up to
``net.example/`` (the slash follows the dot and is in no host). Rule hosts give two boundaries each, and a
boundary carries the stack of rules that are active after it: at its start those of the host and of all
its parents, at its end those of its parents. Urls and boundaries are sorted together by range, the last
boundary before a url is its stack (a range starts from the last boundary of the ranges before it), and
the longest rule in the stack whose path starts the url's path wins.

Defined results: a null url or one without ``://`` has empty host and path and meets no rule. Ties between
rules of one length go to the smaller rule text; a rule given twice counts once (block before allow).
Urls with no rule get ``default``. Rows are kept one to one, repeated ones too; other columns are not
carried through the sort (join them by id if needed), so clashing names cannot meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack) where the stack of active rules changes; rules are (host, path, verdict)."""
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    chain = own.select("host").distinct().select(F.col("host").alias("at"), F.explode(parents).alias("host"))
    rule = F.struct((F.length("host") + F.length("path")).alias("long"), F.concat("host", "path").alias("rule"), "path", "verdict")
    met = chain.join(own, "host").groupBy("at").agg(
        F.collect_set(rule).alias("inside"), F.collect_set(F.when(F.col("host") != F.col("at"), rule)).alias("after"))
    key = host_key(F.col("at"))
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    starts = met.select(key.alias("key"), F.col("inside").alias("stack"))
    return starts.unionAll(met.withColumn("key", key).select(end.alias("key"), F.col("after").alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), one row per url."""
    seen = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = boundaries(rules)
    stack = marks.schema["stack"].dataType
    events = seen.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "id", "host",
                         F.lit(None).cast(stack).alias("stack")).unionByName(
        marks.select("key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True)
    placed = ranged(events, F.col("key"), F.col("kind"), F.col("path"), F.col("id"))
    # the stack with which a range begins: the last boundary in the ranges before it
    last = placed.where("kind = 0").groupBy("_bucket").agg(F.max_by("stack", "key").alias("left"))
    every = placed.select("_bucket").distinct()
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = every.join(last, "_bucket", "left").select("_bucket", F.last("left", ignorenulls=True).over(before).alias("begin"))
    sweep = W.partitionBy("_bucket").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    active = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("begin"))
    swept = placed.join(F.broadcast(begins), "_bucket").withColumn("active", active).where("kind = 1")  # a row per range
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_sort(fits, lambda x, y: F.when(x["long"] != y["long"], y["long"] - x["long"])
                        .when(x["rule"] < y["rule"], -1).when(x["rule"] > y["rule"], 1).otherwise(0))
    won = F.get(best, F.lit(0))
    return swept.select(F.col("id").alias(id_col), "host", "path", won["rule"].alias("rule"),
                        F.coalesce(won["verdict"], F.lit(default)).alias("verdict"))
