"""Licences of files: TF-IDF cosine to templates, then inheritance by directory, in DataFrame functions only.

1. Blocks are the lines of a file (headers and statements may stand anywhere)
   and the file as a whole. Terms are weighted by inverse frequency over all
   lines of all files.
2. A prefix filter spares the cosine for nearly all lines: the most frequent
   terms of a template, as long as they alone cannot reach the threshold, are
   weak; a line without any other (strong) term of some template cannot match.
3. A file whose lines match has a licence of its own. A file that matches as a
   whole is a licence file of its directory.
4. Files without a licence take that of the nearest ancestor directory that has
   a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storylake.llm.common import lower_ascii, written
from storylake.llm.decontamination import if_small

THRESHOLD = 0.6
#: Strong terms up to which they are a part of the plan; beyond, every line with terms is scored. Changes the way, not the result.
MAX_TERMS = 5_000

# Common licence statements, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """``template_no, licence, text`` of the given templates."""
    listed = F.array(*(F.struct(F.lit(i).alias("template_no"), F.lit(k).alias("licence"), F.lit(t).alias("text")) for i, (k, t) in enumerate(rows)))
    return spark.range(1).select(F.explode(listed).alias("t")).select("t.*")


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits after lower-casing A-Z."""
    return F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def term_weights(files: DataFrame, template_rows: DataFrame) -> DataFrame:
    """Written table ``template_no, licence, term, idf, weight, norm, rest``: the templates as weighted vectors.

    ``rest`` is the part of the squared norm that this term and all more
    frequent ones make up.
    """
    own = template_rows.select("template_no", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template_no", "licence", "term").agg(F.count("*").alias("tf"))
    own = written(own, "templates")
    vocabulary = own.select("term").distinct()
    each_line = files.select(F.explode(lines(F.col("text"))).alias("line")).select(F.array_distinct(terms(F.col("line"))).alias("terms")).where("size(terms) > 0")
    # The empty term stands for the number of lines, so that one pass over the texts gives both counts.
    counted = each_line.select(F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    known = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit("").alias("term")))
    found = written(counted.join(if_small(known), "term").groupBy("term").agg(F.count("*").alias("df")), "frequency")
    n_lines = found.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    weighted = own.join(if_small(found), "term", "left")
    idf = F.log(F.lit(1 + n_lines) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighted = weighted.select("template_no", "licence", "term", idf.alias("idf"), (F.col("tf") * idf).alias("weight"))
    one = Window.partitionBy("template_no")
    frequent_first = one.orderBy(F.col("idf"), F.col("term")).rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("weight") * F.col("weight")
    vectors = weighted.select("*", F.sqrt(F.sum(square).over(one)).alias("norm"), F.sum(square).over(frequent_first).alias("rest"))
    return written(vectors, "vectors")


def strong_terms(vectors: DataFrame, threshold: float) -> list[str] | None:
    """Terms without which no block reaches the threshold (see the prefix filter above); None if they are too many for a plan."""
    strong = vectors.where(F.col("rest") >= F.lit(threshold**2 * (1 - 1e-9)) * F.col("norm") * F.col("norm")).select("term").distinct()
    found = [r["term"] for r in strong.limit(MAX_TERMS + 1).collect()]
    return sorted(found) if len(found) <= MAX_TERMS else None


def _scored(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rid, block, template_no, licence, score`` for the blocks ``rid, block, terms``; scores rounded to six digits.

    A term that no template has weighs as much as the rarest term of any.
    """
    of_term = vectors.select("term", "idf").distinct()
    top = F.lit(vectors.agg(F.max("idf").alias("top")).first()["top"]).cast("double")
    counted = blocks.select("rid", "block", F.explode("terms").alias("term")).groupBy("rid", "block", "term").agg(F.count("*").alias("tf"))
    known = counted.join(if_small(of_term), "term", "left")
    # Every occurrence of a term that no template has counts as a term of its own.
    known = known.withColumn("w", F.col("tf") * F.col("idf")).withColumn("square", F.when(F.col("idf").isNull(), F.col("tf") * top * top).otherwise(F.col("w") * F.col("w")))
    norms = known.groupBy("rid", "block").agg(F.sqrt(F.sum("square")).alias("length"))
    dots = known.join(if_small(vectors.select("template_no", "licence", "term", "weight", "norm")), "term").groupBy("rid", "block", "template_no", "licence", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norms, ["rid", "block"]).select("rid", "block", "template_no", "licence", F.round(F.col("dot") / (F.col("length") * F.col("norm")), 6).alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path, without the last slash; empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, down to the empty one."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def scan(files: DataFrame, template_rows: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "file_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The licence of every file.

    Returns one row per input row: ``file_id, path, licence, origin, score,
    line, source_dir``. ``origin`` is ``header`` (its best line matches; ``line``
    counts from 1, and is 0 otherwise), ``file`` (no line does, but the whole file), ``inherited``
    (from the licence file of ``source_dir``) or ``none``. Of equal scores the
    earlier template, then the earlier line wins; of several licence files in a
    directory the best score, then the earlier template. Null or empty texts
    have no licence of their own; a null path has no directory and inherits
    nothing. Repeated rows are judged one by one; an empty table gives an empty
    result; other columns are ignored.
    """
    template_rows = templates(files.sparkSession) if template_rows is None else template_rows
    files = files.select(F.col(id_col).alias("file_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    vectors = term_weights(files, template_rows)
    strong = strong_terms(vectors, threshold)
    listed_terms = F.array(*map(F.lit, strong or [])).cast("array<string>")
    may_match = lambda b: F.size(b["terms"]) > 0 if strong is None else F.arrays_overlap(b["terms"], listed_terms)
    numbered = F.transform(lines(F.col("text")), lambda line, i: F.struct((i + 1).alias("block"), terms(line).alias("terms")))
    listed = files.withColumn("rid", F.monotonically_increasing_id()).select("rid", "file_id", "path", "text", F.filter(numbered, may_match).alias("some"))
    whole = F.array(F.struct(F.lit(0).alias("block"), terms(F.col("text")).alias("terms")))
    read = written(listed.select("rid", "file_id", "path", F.when(F.size("some") > 0, F.concat(whole, "some")).alias("blocks")), "scanned")
    blocks = read.where("blocks IS NOT NULL").select("rid", F.explode("blocks").alias("b")).select("rid", "b.block", "b.terms")
    matched = written(_scored(blocks, vectors).where(F.col("score") >= threshold), "matches")
    best = lambda: F.max(F.struct("score", (-F.col("template_no")).alias("t"), (-F.col("block")).alias("b"), "licence")).alias("best")
    headers = matched.where("block > 0").groupBy("rid").agg(best())
    wholes = matched.where("block = 0").groupBy("rid").agg(best())
    own = headers.select("rid", F.lit("header").alias("origin"), "best").unionByName(wholes.join(headers.select("rid"), "rid", "left_anti").select("rid", F.lit("file").alias("origin"), "best"))
    named = read.drop("blocks").withColumn("dir", directory(F.col("path")))
    of_dir = named.join(wholes, "rid").where("dir IS NOT NULL").groupBy("dir").agg(F.max("best").alias("dir_best"))
    judged = named.join(own, "rid", "left")
    unlicensed = judged.where("origin IS NULL AND dir IS NOT NULL").select("dir").distinct()
    # The path join runs over distinct directories, so a directory with a third of all files counts once.
    near = unlicensed.select("dir", F.explode(ancestors(F.col("dir"))).alias("above")).join(if_small(written(of_dir, "dirs").withColumnRenamed("dir", "above")), "above")
    near = near.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "dir_best")).alias("near"))
    found = judged.join(if_small(written(near, "inherited")), "dir", "left")
    return found.select(
        "file_id",
        "path",
        F.when(F.col("origin").isNotNull(), F.col("best.licence")).otherwise(F.col("near.dir_best.licence")).alias("licence"),
        F.coalesce("origin", F.when(F.col("near").isNotNull(), F.lit("inherited")), F.lit("none")).alias("origin"),
        F.when(F.col("origin").isNotNull(), F.col("best.score")).otherwise(F.col("near.dir_best.score")).alias("score"),
        F.coalesce(F.when(F.col("origin") == "header", -F.col("best.b")), F.lit(0)).cast("long").alias("line"),
        F.when(F.col("origin").isNull(), F.col("near.above")).alias("source_dir"),
    )
