"""Ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fuzzy_score


def fuzzy_rank(items: DataFrame, query: str, name: str, description: str, order: str,
               limit: int | None = None) -> DataFrame:
    """Items that match, best first, input order on ties. With a limit it is a distributed top-k."""
    if not query:
        ranked = items.withColumn("score", F.lit(0).cast("bigint")).orderBy(order)
    else:
        text = F.concat(F.col(name), F.lit(" "), F.coalesce(F.col(description), F.lit("")))
        ranked = (items.withColumn("score", fuzzy_score(query, text)).where("score >= 0")
                  .orderBy(F.desc("score"), order))
    return ranked.limit(limit) if limit is not None else ranked
