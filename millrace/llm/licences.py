"""Licence scans: sparse TF-IDF cosine of header blocks, lines and whole files to templates, then inheritance from the nearest ancestor folder.

DataFrame functions only. Templates are whole licence texts, standard headers
and one-line notices. Equal blocks are scored once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import cache, reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.common import stored

#: Notices by which files state their licence (fixed values).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Standard headers of source files (fixed values).
HEADERS = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work "
        "for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); "
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "MIT": ("Licensed under the MIT license. See LICENSE file in the project root for full license information.",),
}
#: The licences of the GNU family share one header: {name}, {version}.
GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
    "Public License for more details. You should have received a copy of the GNU {name} Public License along with this {what}. If not, see "
    "https://www.gnu.org/licenses/.",
)
GNU_NAMES = {
    "GPL-2.0": ("program", "General", "2"), "GPL-3.0": ("program", "General", "3"), "AGPL-3.0": ("program", "Affero General", "3"),
    "LGPL-2.1": ("library", "Lesser General", "2 1"), "LGPL-3.0": ("library", "Lesser General", "3"),
}
TEXTS = Path(__file__).parent / "licence_texts"  # whole licence texts, one file each
NEAR = 0.8  # least cosine
FILE_SHARE = 0.5  # of a file's words in licence blocks of one kind, from which it is a licence file
COMMON = 0.2  # share of the files from which a term does not tell a template
SPDX = "(?i)spdx-license-identifier:[ \\t]*\\(?([a-z0-9.+-]*[a-z0-9+])"
COMMENT = "[ \\t]*(?:[#*/;%!<>|-]+|rem|dnl)"  # what begins a comment line


def _words(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


@cache
def templates() -> list[tuple[str, Counter]]:
    """Licence and term counts of every template; lines that name a holder are left out."""
    found = [(name, text) for name, text in TEMPLATES.items()]
    found += [(name, text) for name, texts in HEADERS.items() for text in texts]
    found += [(name, text.format(what=what, name=kind, version=version)) for name, (what, kind, version) in GNU_NAMES.items() for text in GNU]
    for file in sorted(TEXTS.glob("*.txt")):
        lines = file.read_text(encoding="utf-8").split("\n")
        found.append((file.stem, "\n".join(x for x in lines if not re.match(r"\s*copyright\b", x, re.I))))
    return [(name, Counter(_words(text))) for name, text in found]


class Model:
    """Template vectors for given document frequencies, and what a text must have to be near one."""

    def __init__(self, df: dict[str, int], n: int) -> None:
        self.rest = math.log(1 + n) + 1  # of a term that no template has: as if no file had it
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, counts in templates() for t in counts}
        self.vectors = []
        for name, counts in templates():
            raw = {t: c * self.idf[t] for t, c in counts.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            self.vectors.append((name, {t: w / norm for t, w in raw.items()}))
        common = {t for t in self.idf if df.get(t, 0) > COMMON * n}
        # A text without the terms M is at most sqrt(1 - sum of squared weights of M) near. So it has at least so many rare terms.
        self.needs = set()
        for _, vector in self.vectors:
            rare = sorted((t for t in vector if t not in common), key=lambda t: -vector[t])
            have, k = 1 - sum(vector[t] ** 2 for t in rare), 0
            while have < NEAR**2 - 1e-9:
                have += vector[rare[k]] ** 2
                k += 1
            self.needs.add((k, tuple(sorted(rare))))
        self.rare = sorted(set().union(*(r for _, r in self.needs)))

    def may_match(self, terms: Column) -> Column:
        """Whether different ``terms`` suffice for any template; no text that is near one is missed."""
        # Filters look terms up; an intersection would put all of the vocabulary into a set for each text.
        least = min(k for k, _ in self.needs)
        enough = lambda hits: reduce(or_, (F.size(_among(hits, rare)) >= k for k, rare in sorted(self.needs)))
        found = F.transform(F.array(F.array_distinct(_among(terms, self.rare))), lambda hits: F.when(F.size(hits) >= least, enough(hits)).otherwise(False))
        found = F.element_at(found, 1)
        return F.coalesce(found, F.lit(False))


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _among(terms: Column, names: Sequence[str]) -> Column:
    """Those of the terms that are among the names."""
    return F.filter(terms, lambda t: t.isin(*names)) if names else F.array().cast("array<string>")


def model_of(texts: DataFrame) -> Model:
    """The model for the document frequencies of the templates' terms in a column ``raw``: a few thousand counts reach the driver."""
    vocabulary = sorted({t for _, counts in templates() for t in counts})
    hits = texts.select(F.explode(F.array_distinct(_among(_terms(F.col("raw")), vocabulary))).alias("term"))
    return Model({r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}, texts.count())


def match_blocks(spark: SparkSession, blocks: DataFrame, model: Model) -> DataFrame:
    """block, licence, cosine for the distinct ``block, text`` that are near a template; ties go to the licence that sorts first.

    A block that is one line with an SPDX identifier is what the line says.
    """
    pieces = spark.createDataFrame([(t, w) for t, w in model.idf.items()], "term string, idf double")
    weights = spark.createDataFrame([(k, name, t, w) for k, (name, vector) in enumerate(model.vectors) for t, w in vector.items()], "template int, licence string, term string, v double")
    counts = blocks.select("block", F.explode(_terms(F.col("text"))).alias("term")).groupBy("block", "term").agg(F.count("*").alias("tf"))
    # Both are bounded by the templates.
    raw = stored(counts.join(F.broadcast(pieces), "term", "left").select("block", "term", (F.col("tf") * F.coalesce("idf", F.lit(model.rest))).alias("w")), "weights")
    norm = raw.groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = raw.join(F.broadcast(weights), "term").groupBy("block", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norm, "block").select("block", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= NEAR)
    best = cosine.groupBy("block").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("x"))
    said = blocks.where(~F.contains(F.trim("text"), F.lit("\n"))).select("block", F.regexp_extract("text", SPDX, 1).alias("id")).where("id != ''")
    known = sorted({name for name, _ in templates()})
    named = F.coalesce(*(F.when(F.regexp_replace(F.lower("id"), "-(only|or-later)$|\\+$", "") == n.lower(), n) for n in known), F.col("id"))
    both = best.join(said.select("block", named.alias("named")), "block", "full")
    return both.select("block", F.coalesce("named", "x.licence").alias("licence"), F.when(F.col("named").isNotNull(), 1.0).otherwise(-F.col("x.far")).alias("cosine"))


def _ancestors(folder: Column) -> Column:
    """The folder itself and all above it; the last is the root, the empty text."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, path: Column, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns ``keep``, path, licence, cosine, via and origin.

    A file's blocks are its whole text, its leading comment, its paragraphs
    (lines up to an empty one, comment marks aside) and its lines; the first of
    these kinds with a block near a template gives the file's own licence
    (``via`` header), by its nearest block. If at least ``FILE_SHARE`` of its
    words are in such blocks of one kind, it is a licence file (``via`` file),
    and speaks for its folder and those below. Other files inherit from the
    nearest ancestor folder with a licence file; of several in a folder the
    nearest to its template speaks, then the one with the smallest path.
    Document frequencies count the files; a term that no template has weighs as
    one that no file has. Null text: no blocks. Null path: no folder, nothing to
    inherit, nothing to speak for. Equal paths: each row by itself. Clashing
    names: only ``keep``, ``text`` and what ``path`` names are read. An empty
    table gives no rows.
    """
    spark = files.sparkSession
    model = model_of(files.select(F.coalesce(F.col(text), F.lit("")).alias("raw")))
    raw = F.coalesce(F.col(text), F.lit(""))
    may = model.may_match(_terms(raw)) | F.contains(F.lower(raw), F.lit("spdx-license-identifier"))
    rows = files.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), path.alias("path"), F.when(may, raw).alias("raw"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")  # only texts that may state a licence

    told = rows.where("raw IS NOT NULL")
    bare = F.regexp_replace("raw", f"(?m)^{COMMENT}+", "")
    lines = F.split("raw", "\n")
    code = F.transform(lines, lambda x, i: F.when(~F.regexp_like(x, F.lit(f"^(?:{COMMENT}.*|[ \\t\\r]*)$")), i))
    lead = F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.array_min(code), F.size(lines))), "\n")
    kinds = F.array(F.array("raw"), F.array(lead), F.array_distinct(F.split(bare, "\\n[ \\t\\r]*\\n")), F.array_distinct(lines))
    units = told.select("row", "path", F.size(_terms(F.col("raw"))).alias("n_words"), F.posexplode(kinds).alias("kind", "texts")).select("row", "path", "n_words", "kind", F.explode("texts").alias("text"))
    spdx = F.regexp_like("text", F.lit(SPDX))  # speaks as a line; a larger block with one is scored like others
    units = units.where(F.when(spdx & (F.col("kind") == 3), True).otherwise((F.size(_terms(F.col("text"))) > 0) & model.may_match(_terms(F.col("text")))))
    units = stored(units.select("row", "path", "n_words", "kind", F.size(_terms(F.col("text"))).alias("size"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("block"), "text"), "blocks")
    found = stored(match_blocks(spark, units.select("block", "text").dropDuplicates(["block"]), model), "matches")
    hits = units.drop("text").join(found, "block")
    near = F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("best")
    by_kind = hits.groupBy("row", "kind").agg(near, F.sum("size").alias("said"), F.first("n_words").alias("n_words"), F.first("path").alias("path"))
    own = by_kind.groupBy("row").agg(F.min_by("best", "kind").alias("best"), F.max("said").alias("said"), F.first("n_words").alias("n_words"), F.first("path").alias("path"))
    own = stored(own.select("row", "path", "best.licence", (-F.col("best.far")).alias("cosine"), (F.col("said") >= FILE_SHARE * F.col("n_words")).alias("whole")), "own")

    folder = F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    first = F.min(F.struct((-F.col("cosine")).alias("far"), "path", "licence")).alias("s")
    speaking = own.where("whole").select(folder.alias("above"), "path", "licence", "cosine").where("above IS NOT NULL").groupBy("above").agg(first)
    folders = rows.select(folder.alias("folder")).where("folder IS NOT NULL").distinct()
    lines = folders.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("up", "above"))
    nearest = lines.join(stored(speaking, "speaking"), "above").groupBy("folder").agg(F.min(F.struct("up", "s")).alias("x"))
    nearest = stored(nearest.select("folder", F.col("x.s.licence").alias("from_licence"), F.col("x.s.path").alias("origin"), (-F.col("x.s.far")).alias("from_cosine")), "nearest")

    joined = rows.drop("raw").join(own.drop("path"), "row", "left").withColumn("folder", folder).join(nearest, "folder", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)),
        "path",
        F.coalesce("licence", "from_licence").alias("licence"),
        F.when(mine, F.col("cosine")).otherwise(F.col("from_cosine")).alias("cosine"),
        F.when(F.col("whole"), "file").when(mine, "header").when(F.col("origin").isNotNull(), "inherited").alias("via"),
        F.when(mine, F.col("path")).otherwise(F.col("origin")).alias("origin"),
    )
