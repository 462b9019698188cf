"""Licence scan: TF-IDF cosine to templates, inheritance by directory.

DataFrame functions only. Every text is cut into statements: its lines, and
from the start of every line on as many terms as each template has, over
line breaks and comment marks, so that a wrapped header is compared as a
whole; a whole licence file is also one statement. Of a run of overlapping
statements ``n_statements`` counts the lines, or one if none is a line. Terms are
lower-case words of ASCII letters and digits. A term's weight is its count in the statement times its
inverse document frequency over all documents of the corpus; templates are
weighted alike, and the cosine of each statement with each template that
shares a term is summed up from the shared terms only. A document's licence
is that of its best statement at or above ``threshold``.

Documents whose file name is a licence file's (LICENSE, COPYING, NOTICE, ...)
speak for their directory. Where paths hold no file names (``by_text``), a
licence file is a document with a licence whose text as a whole, as one
statement, reaches the threshold too. A document without licence of its own
takes that of the licence file in its nearest ancestor directory: its path is
expanded into its ancestors, joined with the licence files' directories, and
the deepest match wins.

Defined cases: null and empty texts have no statement; a null path has no
ancestors; of equal cosines the template with the smaller name wins, of
several licence files in one directory the better cosine, then the smaller
name; repeated rows each get their row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Notices and headers by which public licences are applied.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
}
LICENSE_FILE = r"(?i)^(li[cz]en[cs]e|copying|notice|unlicense)([._-].*)?$"
THRESHOLD = 0.75
WHOLE = -1  # place of the whole text among the statements


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _weights(templates: list[tuple[str, str, list[str]]], df: dict[str, int], total: int) -> dict[str, float]:
    return {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for _, _, ts in templates for t in ts}


def _heavy(vector: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a statement must hold one to reach the threshold: the
    lightest terms that together stay below it are left out (a statement that
    shares only those has a cosine of at most their part of the norm)."""
    norm, light, left = sum(w * w for w in vector.values()), 0.0, set(vector)
    for t, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
        light += w * w
        if light >= threshold * threshold * norm:
            break
        left.discard(t)
    return left


def _windows(lines: Column, sizes: dict[int, set[str]]) -> Column:
    """(terms, first line, last line, line) of the windows: for each length and
    each line, so many terms from the line's start on, if a heavy term of a
    template of that length is among them. Lines without terms are left out."""
    longest = max(sizes)
    heavy = F.array(*(F.lit(t) for t in sorted(set().union(*sizes.values()))))
    full = F.filter(F.transform(lines, lambda ts, k: F.struct(F.slice(ts, 1, longest).alias("ts"), k.alias("line"), F.size(ts).alias("n"),
                                                              F.arrays_overlap(ts, heavy).alias("heavy"))), lambda x: x["n"] > 0)
    # a line's window is at most `longest` lines long, as each has a term
    ahead = F.transform(full, lambda x, k: F.when(F.exists(F.slice(full, k + 1, longest), lambda y: y["heavy"]), F.slice(full, k + 1, longest)))

    def cut(look: Column, size: int, own: set[str]) -> Column:
        end = F.aggregate(look, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("line")),
                          lambda acc, y: F.when(acc["n"] >= size, acc).otherwise(F.struct((acc["n"] + y["n"]).alias("n"), y["line"].alias("line"))))
        ts = F.slice(F.flatten(F.transform(look, lambda y: y["ts"])), 1, size)
        first = look[0]
        mine = F.array(*(F.lit(t) for t in sorted(own)))
        # a window that is just its first line is a statement already
        return F.when(((end["line"] > first["line"]) | (first["n"] > size)) & F.arrays_overlap(ts, mine),
                      F.struct(ts.alias("ts"), first["line"].alias("lo"), end["line"].alias("hi"), F.lit(False).alias("line")))
    every = F.transform(F.filter(ahead, lambda look: look.isNotNull()), lambda look: F.array(*(cut(look, n, own) for n, own in sorted(sizes.items()))))
    return F.filter(F.flatten(every), lambda w: w.isNotNull())


def _separate(at: Column, hits: Column) -> Column:
    """Statements ``hits`` by runs of overlapping ones: the lines of each run,
    or one for a run without lines."""
    places = F.array_sort(F.transform(hits, lambda k: F.struct(at[k]["lo"].alias("lo"), at[k]["hi"].alias("hi"), at[k]["line"].alias("line"))))

    def add(acc: Column, x: Column) -> Column:
        new = x["lo"] > acc["end"]
        return F.struct((acc["n"] + F.when(new | (x["line"] & (acc["lines"] > 0)), 1).otherwise(0)).cast("bigint").alias("n"),
                        (F.when(new, 0).otherwise(acc["lines"]) + x["line"].cast("int")).alias("lines"), F.greatest(acc["end"], x["hi"]).alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("lines"), F.lit(-1).alias("end"))
    return F.coalesce(F.aggregate(places, start, add)["n"], F.lit(0).cast("bigint"))


def _may_be_whole(lines: Column, text: Column, vocabulary: Column, leading: set[str], threshold: float) -> Column:
    """False only if a text as a whole is below the threshold. The terms that are not
    ``leading`` are at most half the threshold of every template's norm, so the leading
    ones must be half the threshold of the text's norm at least; they weigh at most
    what a term of no template does, and each such term of the text once at least."""
    mine = F.array(*(F.lit(t) for t in sorted(leading)))
    own = F.aggregate(F.filter(lines, lambda ts: F.arrays_overlap(ts, mine)), F.lit(0),
                      lambda n, ts: n + F.size(F.filter(ts, lambda t: F.array_contains(mine, t))))
    return own >= threshold / 2 * F.sqrt(F.size(F.array_except(text, vocabulary)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
         templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """``(id_col, license, cosine, n_statements, inherited, effective)``: own
    licence and cosine (null without one), statements at or above the
    threshold, the licence inherited by directory, and the one in effect.
    ``by_text``: licence files are told by their text, not by their names only."""
    spark = docs.sparkSession
    forms = [(f"{name}#{k}", name, re.findall(r"[a-z0-9]+", t.lower()))
             for name, ts in (templates or TEMPLATES).items() for k, t in enumerate(ts)]
    vocabulary = F.array(*(F.lit(t) for t in sorted({t for _, _, ts in forms for t in ts})))
    path = F.col(path_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), path.alias("path"),
                      F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE), F.lit(False)).alias("file"))

    # document frequencies of the templates' terms, over all documents
    total = src.count()
    df = (src.select(F.explode(F.array_intersect(_terms(F.col("text")), vocabulary)).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())  # at most as many rows as the templates have terms
    weight = _weights(forms, {r["term"]: r["df"] for r in df}, total)
    unseen = math.log(1 + total) + 1  # weight of a term of no template
    vectors = {(key, name): {t: ts.count(t) * weight[t] for t in ts} for key, name, ts in forms}
    heavy = F.array(*(F.lit(t) for t in sorted(set().union(*(_heavy(v, threshold) for v in vectors.values())))))

    by_size: dict[int, set[str]] = {}  # heavy terms of the templates of each length
    for key, name, ts in forms:
        by_size.setdefault(len(ts), set()).update(_heavy(vectors[key, name], threshold))
    src = src.withColumn("lines", F.transform(F.split("text", "[\r\n]+"), _terms))
    whole = F.array(F.struct(F.flatten("lines").alias("ts"), F.lit(0).alias("lo"), (F.size("lines") - 1).alias("hi"), F.lit(False).alias("line")))
    single = F.transform("lines", lambda ts, k: F.struct(ts.alias("ts"), k.alias("lo"), k.alias("hi"), F.lit(True).alias("line")))
    single = F.filter(F.concat(single, F.when(F.col("file"), whole).otherwise(F.slice(whole, 1, 0))), lambda x: F.arrays_overlap(x["ts"], heavy))
    # no window reaches the threshold in a text without heavy terms
    found = F.when(F.exists("lines", lambda ts: F.arrays_overlap(ts, heavy)), F.concat(single, _windows(F.col("lines"), by_size))).otherwise(F.slice(single, 1, 0))
    flat = F.when(F.lit(by_text) & ~F.col("file") & (F.size("found") > 0), F.flatten("lines"))
    leading = set().union(*(_heavy(v, threshold / 2) for v in vectors.values()))
    flat = F.when(_may_be_whole(F.col("lines"), flat, vocabulary, leading, threshold), flat) if by_text else flat
    rows = materialize(src.withColumn("found", found).select("id", "path", "file", "found", flat.alias("flat"), F.monotonically_increasing_id().alias("row")), "statements")

    terms = spark.createDataFrame([(k, n, t, w) for (k, n), v in vectors.items() for t, w in v.items()],
                                  "template string, name string, term string, w double")
    norms = spark.createDataFrame([(k, math.sqrt(sum(w * w for w in v.values()))) for (k, _), v in vectors.items()],
                                  "template string, norm double")
    idf = spark.createDataFrame(list(weight.items()), "term string, idf double")
    statements = rows.where(F.size("found") > 0).select("row", F.posexplode("found").alias("line", "s")).select("row", "line", "s.ts")
    if by_text:  # the whole text, which is no statement of its own
        statements = statements.unionByName(rows.where("flat is not null").select("row", F.lit(WHOLE).alias("line"), F.col("flat").alias("ts")))
    counted = (statements.select("row", "line", F.explode("ts").alias("term")).groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
               .join(F.broadcast(idf), "term", "left")
               .select("row", "line", "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("x")))
    own_norm = counted.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("own"))
    cosine = (counted.join(F.broadcast(terms), "term").groupBy("row", "line", "template", "name").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
              .join(F.broadcast(norms), "template").join(own_norm, ["row", "line"])
              .select("row", "line", "name", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 9).alias("cosine"))
              .where(F.col("cosine") >= threshold))
    one = F.col("line") != WHOLE
    best = cosine.groupBy("row").agg(F.min(F.when(one, F.struct((-F.col("cosine")).alias("c"), F.col("name")))).alias("b"),
                                     F.array_sort(F.collect_set(F.when(one, F.col("line")))).alias("hits"), F.max(~one).alias("whole"))
    file = F.col("file") | F.coalesce("whole", F.lit(False))
    got = materialize(rows.select("id", "path", "file", "row", F.transform("found", lambda x: x.dropFields("ts")).alias("at")).join(best, "row", "left")
                      .select("row", "id", "path", file.alias("file"), F.col("b.name").alias("license"), (-F.col("b.c")).alias("cosine"),
                              _separate(F.col("at"), F.col("hits")).alias("n_statements")), "licensed")

    # inheritance: ancestors of the paths joined with the licence files' directories
    parts = F.split("path", "/")
    files = (got.where("file and license is not null")
             .select(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), "license", "cosine")
             .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
             .select("dir", F.col("b.license").alias("inherited")))
    if files.isEmpty():
        got = got.withColumn("inherited", F.lit(None).cast("string"))
    else:
        depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1))
        near = (got.where("license is null and path is not null").select("row", parts.alias("parts"), depth.alias("depth"))
                .select("row", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
                .join(files, "dir").groupBy("row").agg(F.max_by("inherited", "depth").alias("inherited")))
        got = got.join(near, "row", "left")
    return got.select(F.col("id").alias(id_col), "license", F.round("cosine", 6).alias("cosine"), "n_statements", "inherited",
                      F.coalesce("license", "inherited").alias("effective"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no file names: the path is source/lang/id (null if source or
    lang is), and a document that is a licence as a whole speaks for its directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return scan(docs.withColumn("path", path), by_text=True)
