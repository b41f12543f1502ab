"""Licence scans by sparse TF-IDF cosine, with DataFrame functions only, and inheritance down directories.

Every file is cut into header candidates, its lines and sentences; licence files are scored as wholes beside
that. Terms weigh term frequency times inverse frequency among the templates (terms that no template has
weigh as the rarest), and a piece has the licence of the template with the highest cosine, if that is
``LIMIT`` or more. Only pieces with two template terms or more are scored. A file without a licence of
its own inherits from the nearest directory above that has a licence file: directories are folded first,
their parents are joined by path, and files join their directory's answer.

Defined results: null or empty texts have no own licence; null paths lie in the root directory. Of equal
cosines the smaller licence name wins, of several licence files in a directory the smallest path.
Rows are kept one to one; repeated ids share the best find of their rows. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small

LIMIT = 0.6

# Well-known notices and tags of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower case, with inner dots (``2.0``)."""
    # plain letters and digits first, and nothing to go back to: most characters are settled by one comparison
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\p{L}\p{N}]++(?:\.[\p{N}]++)*+"), F.lit(0))


def weighted(templates: DataFrame) -> tuple[DataFrame, float, list[str]]:
    """(term, template, license, weight, idf) of unit template vectors, the weight of foreign terms, all template terms."""
    listed = templates.withColumn("template", F.xxhash64("license", "text"))
    total = listed.count()
    counts = listed.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(
        F.count(F.lit(1)).cast("double").alias("tf"))
    idf = counts.groupBy("term").agg((F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    table = cut_lineage(raw.join(norm, "template").select("term", "template", "license", (F.col("raw") / F.col("norm")).alias("weight"), "idf"))
    return table, math.log(1.0 + total) + 1, sorted(r["term"] for r in table.select("term").distinct().collect())  # template terms only


def reach(table: DataFrame) -> Column:
    """The highest sum of squared template weights over the terms in ``shared``."""
    squares: dict[int, list] = {}
    for r in table.collect():  # the templates' terms
        squares.setdefault(r["template"], []).extend([r["term"], r["weight"] ** 2])
    def total(flat: list) -> Column:
        of = F.create_map(*[F.lit(x) for x in flat])
        return F.aggregate("shared", F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(of, t), F.lit(0.0)))

    return F.greatest(F.lit(0.0), F.lit(0.0), *[total(flat) for flat in squares.values()])


def own_licenses(files: DataFrame, templates: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(id, license, score) of files (id, text, whole) that have a licence of their own."""
    table, foreign, vocabulary = weighted(templates)
    known = F.array_distinct(F.filter("terms", lambda t: t.isin(*vocabulary)))
    parts = F.split(F.coalesce("text", F.lit("")), r"[\r\n]+|(?<=[.;!?])\s+")
    pieces = F.when(F.col("whole"), F.concat(parts, F.array("text"))).otherwise(parts)
    # the outer explodes keep terms and shared terms from being computed again wherever the conditions name them
    split = files.select("id", F.posexplode(pieces).alias("piece", "part")).select("id", "piece", F.explode_outer(F.array(terms(F.col("part")))).alias("terms"))
    # a cosine is at most the length of the template's part in shared terms, so others are not taken apart
    shared = split.select("id", "piece", "terms", F.explode_outer(F.array(known)).alias("shared")).where(F.size("shared") > 1)
    scored = shared.where(reach(table) >= limit * limit).drop("shared").withColumn("row", F.monotonically_increasing_id())
    scored = cut_lineage(scored)  # row numbers must not change
    counts = scored.select("id", "row", F.explode("terms").alias("term")).groupBy("id", "row", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    idf = table.select("term", "idf").distinct()
    weighed = counts.join(small(cut_lineage(idf)), "term", "left").withColumn("raw", F.col("tf") * F.coalesce("idf", F.lit(foreign)))
    norms = weighed.groupBy("id", "row").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    dots = (weighed.join(small(table.select("term", "template", "license", "weight")), "term")
            .groupBy("id", "row", "template", "license").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot")))
    cosine = dots.join(norms, ["row"]).select(dots["id"], "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = cosine.where(F.col("score") >= limit).groupBy("id").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))
    return best.select("id", "license", "score")


def directory(path: Column) -> Column:
    """The path before the last slash; empty for the root."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def scan(files: DataFrame, id_col: str, path: str, text: str, licence_file: Column, templates: DataFrame,
         limit: float = LIMIT) -> DataFrame:
    """(id, path, own_license, own_score, license, license_from), one row per file."""
    rows = files.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"),
                        F.coalesce(licence_file, F.lit(False)).alias("whole"))
    own = cut_lineage(own_licenses(rows.select("id", "text", "whole"), templates, limit))
    named = rows.select("id", "path", "whole", directory(F.col("path")).alias("dir"))
    found = cut_lineage(named.join(own, named["id"].eqNullSafe(own["id"]), "left").drop(own["id"]))
    given = (found.where("whole and license is not null").groupBy("dir")
             .agg(F.min_by("license", F.struct("path", "license")).alias("given")))
    given = cut_lineage(given.withColumnRenamed("dir", "above"))
    # parents of each directory, the nearest first: the path itself, then shorter and shorter, at last the root
    steps = F.split("dir", "/")
    parents = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, F.size(steps) - n), "/"))
    up = found.select("dir").distinct().select("dir", F.posexplode(parents).alias("far", "above"))
    near = cut_lineage(up.join(given, "above").groupBy("dir").agg(F.min_by(F.struct("given", "above"), "far").alias("near")))
    out = found.join(small(near), "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
                      F.coalesce("license", "near.given").alias("license"),
                      F.when(F.col("license").isNull(), F.col("near.above")).alias("license_from"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")
