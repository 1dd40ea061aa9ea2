"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch

# The wording by which public licences are declared.
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
_ENDORSEMENT = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.")
_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0, dedicated to the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _CONDITIONS),
    ("BSD-3-Clause", _CONDITIONS + _ENDORSEMENT),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER),
    ("BSD-3-Clause", _CONDITIONS + _ENDORSEMENT + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
CUE = r"(?i)licen[cs]|copying|permission|redistribut|spdx|creative commons|public domain|\bcc0?[ -](?:by|1)"
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$"


@dataclass(frozen=True)
class Vectors:
    """Unit vectors of the templates; a term counts once in a text, by its inverse template frequency."""

    names: tuple[str, ...]
    idf: dict[str, float]
    unseen: float
    weights: tuple[dict[str, float], ...]

    @classmethod
    def of(cls, templates: list[tuple[str, str]]) -> Vectors:
        terms = [set(re.findall(TERM, text.lower())) for _, text in templates]
        df, n = Counter(t for s in terms for t in s), len(templates)
        idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
        norms = [math.sqrt(sum(idf[t] ** 2 for t in s)) for s in terms]
        return cls(tuple(name for name, _ in templates), idf, math.log(1 + n) + 1,
                   tuple({t: idf[t] / norm for t in sorted(s)} for s, norm in zip(terms, norms, strict=True)))


def _literal(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])


def best_match(passages: Column, vectors: Vectors) -> Column:
    """The best (score, template) over an array of passages; ties go to the earlier template."""
    zero = F.lit(0.0)
    idf = _literal(vectors.idf)

    def product(terms: Column, weights: dict[str, float]) -> Column:
        return F.aggregate(terms, zero, lambda s, t: s + F.coalesce(t["idf"] * F.element_at(_literal(weights), t["term"]), zero))

    def read(terms: Column) -> Column:
        norm = F.sqrt(F.aggregate(terms, zero, lambda s, t: s + F.pow(F.coalesce(t["idf"], F.lit(vectors.unseen)), F.lit(2.0))))
        return F.struct(norm.alias("norm"), F.filter(terms, lambda t: t["idf"].isNotNull()).alias("known"))

    def best(passage: Column) -> Column:
        scores = [F.struct(F.round(product(passage["known"], w) / passage["norm"], 9).alias("score"), F.lit(-i).alias("minus"))
                  for i, w in enumerate(vectors.weights)]
        return F.array_max(F.array(*scores))

    # Each step is a list of its own: terms are cut and looked up once, not once a template.
    terms = F.transform(passages, lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p), F.lit(TERM), F.lit(0))))
    looked_up = F.transform(terms, lambda ts: F.transform(ts, lambda t: F.struct(t.alias("term"), F.element_at(idf, t).alias("idf"))))
    return F.array_max(F.transform(F.transform(looked_up, read), best))


def own_licences(files: DataFrame, vectors: Vectors, threshold: float) -> DataFrame:
    """``files`` (key, path, text) with the licence that the text itself declares, if any.

    Lines, blocks between empty lines, and for licence files the whole text, are each
    compared if a cue word occurs in them.
    """
    cued = lambda parts: F.filter(parts, lambda p: p.rlike(CUE))
    text = F.coalesce("text", F.lit(""))
    passages = F.when(text.rlike(CUE), F.array_distinct(F.concat(
        cued(F.split(text, r"\r?\n")), cued(F.split(text, r"\r?\n\s*\n")), F.when(F.col("path").rlike(LICENCE_FILE), cued(F.array(text))).otherwise(F.array().cast("array<string>")))))
    rows = files.select("key", "path", passages.alias("_passages"))
    rows = rows.select("key", "path", F.when(F.size("_passages") > 0, best_match(F.col("_passages"), vectors)).alias("_best"))
    names = F.array(*[F.lit(n) for n in vectors.names])
    good = F.coalesce(F.col("_best.score") >= threshold, F.lit(False))
    return rows.select(
        "key", "path", F.when(good, F.get(names, -F.col("_best.minus"))).alias("own"), F.when(good, F.col("_best.score")).alias("score"))


def directory(path: str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """key, path, licence, score, origin, from_dir of every row of ``files`` (key, path, text).

    ``origin`` is ``file`` for licence files, ``header`` for other files that declare a
    licence, ``inherited`` if the nearest directory above with a licence file gives it,
    else ``none``. Several licence files of one directory: the highest score, then the
    smallest name speaks. Null paths lie in no directory; null and empty texts declare
    nothing. Repeated rows are judged alike. Other columns are not read.
    """
    scratch = Scratch(files.sparkSession)
    vectors = Vectors.of(TEMPLATES)
    found = scratch.keep(own_licences(files, vectors, threshold).withColumn("dir", directory("path")), "licences")
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    given = found.filter(is_file & F.col("own").isNotNull()).groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("path").alias("p"), "own")).alias("m")).select(
        F.col("dir").alias("above"), F.col("m.own").alias("given"), (-F.col("m.minus")).alias("given_score"))
    # Directories, not files, are joined with their ancestors: one row a level.
    dirs = found.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    levels = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("_parts"))
    levels = levels.filter("depth > 0 OR dir <> ''").select("dir", "depth", F.array_join(F.slice("_parts", 1, F.col("depth")), "/").alias("above"))
    near = levels.unionByName(dirs.filter("dir = ''").select("dir", F.lit(0).alias("depth"), F.lit("").alias("above")))
    near = near.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given", "given_score")).alias("m"))
    near = near.select("dir", F.col("m.above").alias("from_dir"), F.col("m.given").alias("given"), F.col("m.given_score").alias("given_score"))
    rows = found.join(near, "dir", "left")
    own, took = F.col("own").isNotNull(), F.col("given").isNotNull()
    origin = F.when(own & is_file, "file").when(own, "header").when(took, "inherited").otherwise("none")
    return rows.select("key", "path", F.coalesce("own", "given").alias("licence"), F.when(own, F.col("score")).otherwise(F.col("given_score")).alias("score"),
                       origin.alias("origin"), F.when(~own, F.col("from_dir")).alias("from_dir"))


def corpus_files(docs: DataFrame) -> DataFrame:
    """A file tree from ``docs`` (doc_id, text, source): a source is a top directory, hundreds of ids nest below it.

    A document whose first line is a licence statement is its directory's licence file.
    A null id has a null path; repeated ids are files of one path; null texts stay null.
    """
    number = F.col("doc_id").cast("long")
    name = F.when(F.regexp_extract("text", r"^[^\n]*", 0).rlike(CUE), F.concat(F.lit("LICENSE."), number.cast("string"))).otherwise(
        F.concat(number.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.concat(F.lit("k"), F.expr("doc_id div 10000")), F.concat(F.lit("c"), F.expr("doc_id div 100")), name)
    return docs.select(number.alias("key"), F.when(number.isNotNull(), path).alias("path"), "text")
