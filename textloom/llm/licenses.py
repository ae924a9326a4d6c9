"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

A file is a path with a text. Every line of it is a possible header, and the whole text a
possible licence file. Both become sparse vectors: words of the templates weigh term frequency times inverse
document frequency, counted over all files; a word that no template has weighs as much as the rarest word, which keeps
lines that only mention a licence away from the templates. A line takes the template with the highest cosine,
a file its best line; ties go to the template that comes first.

Only lines with a mark of licences (a few stems) are compared, so the cost follows the number of such
lines. The template vectors are a literal of a few hundred numbers.

Inheritance: a directory has the licence of its licence files (LICENSE, COPYING, NOTICE and the like, the
directory's own page, or a file that is one template as a whole). A file without a header takes that of the
nearest ancestor directory. Every file lists its ancestors and meets the licensed directories in
an equi-join on the path, one row per directory, so a directory with very many files is a plain lookup.

Everything is a built-in expression: no Python on rows.

Defined results: null or empty text has no header. A null path has no directory and inherits
nothing. Repeated paths are judged row by row, their texts together decide for their directory. Empty
tables give empty results. Other columns take no part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST = 0.6
STEMS = r"(?i)licen[sc]|copyright|spdx|permission is hereby|public domain|creative commons|redistribution"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|notice|unlicense|index)?(?:\.(?:txt|md|html?))?$"

# Names and notices of public licences, as files and headers carry them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _template_words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


VOCABULARY = sorted({w for _, t in TEMPLATES for w in _template_words(t)})


def line_words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))


def plain_lines(html: Column) -> Column:
    """Lines of a page: block ends and line breaks part them, other tags go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    broken = F.regexp_replace(bare, r"(?i)<br\s*/?>|</?(?:p|div|li|h[1-6]|tr|article|section|footer|header|title)\b[^>]*>", "\n")
    return F.split(F.regexp_replace(broken, r"<[^>]*>", " "), "\n")


def url_path(url: Column) -> Column:
    """host/dir/file without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")


def inverse_frequencies(files: DataFrame) -> tuple[dict[str, float], float]:
    """Of template words, over all files (columns _id, lines); and that of a word no file has. One row per word of the templates."""
    n = files.count()
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    words = F.array_intersect(F.array_distinct(F.flatten(F.transform(F.col("lines"), line_words))), vocabulary)
    counts = {r["w"]: r["n"] for r in files.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = lambda df: math.log((n + 1) / (df + 1)) + 1
    return {w: idf(counts.get(w, 0)) for w in VOCABULARY}, idf(0)


def sparse_vector(words: Column, idf: dict[str, float], rarest: float) -> Column:
    """Distinct words with their weights."""
    weights = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))])

    def weigh(w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w)) * F.coalesce(F.element_at(weights, w), F.lit(rarest))

    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), weigh(w).alias("v")))


def best_template(vector: Column, idf: dict[str, float]) -> Column:
    """(cosine, place, name) of the most similar template."""

    def dot(values: dict[str, float]) -> Column:
        unit = F.create_map(*[x for w, v in values.items() for x in (F.lit(w), F.lit(v))])
        return F.aggregate(vector, F.lit(0.0), lambda a, t: a + t["v"] * F.coalesce(F.element_at(unit, t["w"]), F.lit(0.0)))

    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, t: a + t["v"] * t["v"]))
    scored = []
    for place, (name, text) in enumerate(TEMPLATES):
        own = _template_words(text)
        values = {w: own.count(w) * idf[w] for w in own}
        length = math.sqrt(sum(v * v for v in values.values()))
        cosine = dot({w: v / length for w, v in values.items()}) / norm
        scored.append(F.struct(cosine.alias("cosine"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    return F.when(F.size(vector) > 0, F.greatest(*scored))


def scan(files: DataFrame, key: str, path: Column, lines: Column, least: float = LEAST) -> DataFrame:
    """key, path, license, similarity, found ('header', 'directory', 'none'), from_directory, for every file."""
    base = files.select(F.col(key).alias("_id"), path.alias("path"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    idf, rarest = inverse_frequencies(base)
    marked = F.filter("lines", lambda line: line.rlike(STEMS))
    some = base.select("_id", "path", marked.alias("marked"), F.size(F.filter("lines", lambda line: line.rlike(r"\w"))).alias("n_lines"))
    vectors = some.select("_id", "path", "n_lines", F.transform("marked", lambda line: sparse_vector(line_words(line), idf, rarest)).alias("v"))
    scored = vectors.select("_id", "path", "n_lines", F.when(F.size("v") > 0, F.transform("v", lambda v: best_template(v, idf))).alias("s"))
    judged = scored.select("_id", "path", "n_lines", F.array_max("s").alias("b"))
    hit = F.coalesce(F.col("b.cosine") >= least, F.lit(False))
    parts = F.split("path", "/")
    depth = F.size(parts)
    own = judged.select(
        "_id", "path", F.when(hit, F.col("b.name")).alias("header"), F.when(hit, F.col("b.cosine")).alias("cosine"),
        F.when(depth > 1, F.array_join(F.slice(parts, 1, depth - 1), "/")).alias("dir"),
        (F.element_at(parts, -1).rlike(LICENSE_FILE) | (F.col("n_lines") == 1)).alias("is_license_file"),
    )
    licensed = own.where(F.col("is_license_file") & F.col("header").isNotNull() & F.col("dir").isNotNull())
    by_dir = licensed.groupBy(F.col("dir").alias("_dir")).agg(F.max(F.struct("cosine", "header")).alias("_b")).select("_dir", F.col("_b.header").alias("_license"))
    split = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.array_join(F.slice(split, F.lit(1), i), "/"))
    # Each directory once: a directory of many files is looked up once.
    up = own.where(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.posexplode(ancestors).alias("_depth", "_up"))
    nearest = up.join(by_dir, up["_up"] == by_dir["_dir"]).groupBy(F.col("dir").alias("_d")).agg(F.max(F.struct("_depth", "_up", "_license")).alias("_n"))
    out = own.join(nearest, own["dir"] == nearest["_d"], "left")
    inherited = F.col("header").isNull() & F.col("_n").isNotNull()
    return out.select(
        F.col("_id").alias(key), "path", F.coalesce("header", F.col("_n._license")).alias("license"), F.col("cosine").alias("similarity"),
        F.when(F.col("header").isNotNull(), "header").when(inherited, "directory").otherwise("none").alias("found"),
        F.when(inherited, F.col("_n._up")).alias("from_directory"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every page, from its own text or its directory."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return scan(pages, "page_id", url_path(F.col("url")), plain_lines(F.col("html")))
