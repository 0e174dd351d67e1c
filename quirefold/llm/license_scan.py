"""Licence scan by sparse TF-IDF cosine to templates, with inheritance from the nearest directory.

Templates are short notices, headers of files, and whole licence texts. What is compared with them are windows of
consecutive lines, which find headers wherever they stand, and whole texts of any length, which find licence files. The
weight of a term is (1 + ln of its count) times its inverse document frequency, counted over all texts; the words that
notices are worded with ("this project is licensed under the terms of") have none, so a short notice is as good as another. A file without a
licence of its own gets that of the licence file in its nearest ancestor directory. DataFrame operations only.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import saved

#: Licences by SPDX identifier, and how notices call them.
NAMES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "Redistribution and use in source and binary forms under the BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "Redistribution and use in source and binary forms under the BSD 3-Clause License"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
)
#: The first sentences of licences that are often quoted without the rest (that of BSD names no variant), and
#: headers of files.
HEADERS: tuple[tuple[str, str], ...] = (
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Words of notices that tell no licence from another: they count in no text.
FORM = tuple("a an and are available be by distributed in is it library licensed made of package program project provided published released repository software terms the these this to under work you your".split())
#: A file's name that makes it the licence file of its directory.
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
#: How many lines the windows have that start at a line with one of the needed terms.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Possessive, so that Java matches a long run in a loop instead of by recursion.
_TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"


def default_templates() -> tuple[tuple[str, str], ...]:
    """Names, headers, tags with each identifier, and the whole texts in the folder of licences, by the name of their files."""
    texts = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    tags = tuple((n, f"SPDX-License-Identifier: {n}") for n in sorted({n for n, _ in NAMES}))
    return NAMES + HEADERS + tags + tuple((x.stem, x.read_text(encoding="utf-8")) for x in texts)


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda t: ~t.isin(*FORM))


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(_TERM, text.lower()) if t not in FORM]


@dataclass
class Weights:
    """The templates' names, their terms' weights in vectors of length one, and inverse document frequencies."""

    names: list[str]
    vectors: list[dict[str, float]]
    idf: dict[str, float]
    other: float

    def needed(self, threshold: float) -> list[str]:
        """Terms of which a text has one at least if its cosine to some template reaches the threshold."""
        keys: set[str] = set()
        for vector in self.vectors:
            rest, left = sorted(vector, key=lambda t: (vector[t], t)), 1.0
            while rest and math.sqrt(max(left, 0.0)) >= threshold:
                left -= vector[rest[-1]] ** 2
                keys.add(rest.pop())
        return sorted(keys)


def weigh(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> Weights:
    """Counts, over every text, in how many documents each term of the templates occurs. Only these counts come back."""
    ordered = sorted(templates)
    counts = [Counter(terms_of(text)) for _, text in ordered]
    vocabulary = docs.sparkSession.createDataFrame([(t,) for t in sorted({"", *(t for c in counts for t in c)})], "term string")
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct(_terms(F.col("text").cast("string"))), F.array().cast("array<string>")))).alias("term"))
    df = {r["term"]: r["count"] for r in held.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count().collect()}
    total = df.pop("", 0)
    idf = lambda t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1
    raw = [{t: (1 + math.log(n)) * idf(t) for t, n in c.items()} for c in counts]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in raw]
    return Weights([name for name, _ in ordered], [{t: w / n for t, w in v.items()} for v, n in zip(raw, norms, strict=True)], {t: idf(t) for v in raw for t in v}, math.log(total + 1) + 1)


def _units(texts: DataFrame, hint: str) -> DataFrame:
    """key, unit and terms: the whole of each text (unit 0), and the windows that start at a line with a needed term."""
    lines = texts.select("k1", "k2", "text", F.split("text", "\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(hint), i)), lambda i: i.isNotNull())
    windows = lines.select("k1", "k2", "lines", F.explode(at).alias("at")).select("k1", "k2", "lines", "at", F.explode(F.array(*map(F.lit, WINDOWS))).alias("n"))
    windows = windows.where("n = 1 or at + n <= size(lines)")
    own = windows.select("k1", "k2", (F.col("at") * 64 + F.col("n")).cast("long").alias("unit"), F.array_join(F.slice("lines", F.col("at") + 1, F.col("n")), "\n").alias("part"))
    return texts.select("k1", "k2", F.lit(0).cast("long").alias("unit"), F.col("text").alias("part")).unionByName(own)


def _matches(texts: DataFrame, weights: Weights, threshold: float, file_threshold: float) -> DataFrame:
    """k1, k2, license, score and file (does the whole text match) of the distinct texts that match a template."""
    needed = weights.needed(min(threshold, file_threshold))
    hint = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed)) + ")(?![a-z0-9])"
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    distinct = saved(texts.where(F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, needed)))).select(*key, "text").dropDuplicates(["k1", "k2"]), "hinted")
    counted = _units(distinct, hint).select("k1", "k2", "unit", F.explode(_terms(F.col("part"))).alias("term")).groupBy("k1", "k2", "unit", "term").agg(F.count("*").alias("tf"))
    told = [(t, weights.idf[t], [v.get(t, 0.0) for v in weights.vectors]) for t in sorted(weights.idf)]
    known = F.broadcast(texts.sparkSession.createDataFrame(told, "term string, idf double, of array<double>"))
    weighed = counted.join(known, "term", "left").select("k1", "k2", "unit", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(weights.other))).alias("w"), "of")
    dots = [F.coalesce(F.sum(F.col("w") * F.col("of")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(len(weights.names))]
    cosines = weighed.groupBy("k1", "k2", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    # of equal scores the name that sorts first: names are in order, and the number counts down
    each = [F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 12).alias("score"), F.lit(-i).alias("i")) for i in range(len(weights.names))]
    cosines = cosines.select("k1", "k2", "unit", F.greatest(*each).alias("best") if len(each) > 1 else each[0].alias("best"))
    best = cosines.groupBy("k1", "k2").agg(F.max("best").alias("best"), F.max(F.when(F.col("unit") == 0, F.col("best.score"))).alias("whole"))
    license_ = F.element_at(F.array(*map(F.lit, weights.names)), 1 - F.col("best.i"))
    return best.where(F.col("best.score") >= threshold).select("k1", "k2", license_.alias("license"), F.col("best.score").alias("score"), (F.coalesce("whole", F.lit(0.0)) >= file_threshold).alias("file"))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.75, file_threshold: float = 0.9) -> DataFrame:
    """docs with license, score (of its own notice), is_license_file, inherited (licence of the nearest ancestor) and
    effective (the own licence, else the inherited one).

    docs: path ('/' between directories), text; all columns are kept, except that those named like a result are replaced.
    templates: (licence, text), by default those of default_templates(). The own licence is the template of the highest
    cosine, at least `threshold`, over all windows and the whole text; equal scores go to the name that sorts first. A
    licence file is one with such a name, or whose whole text has a cosine of `file_threshold` or more to a template; if
    a directory has several, the one of the highest score, then of the smallest name, counts. Null or empty texts have no
    licence; a null path is in no directory and inherits nothing. Repeated rows are files of their own; equal texts, told
    by 128 bits of hash, are compared once.
    """
    rest = [c for c in docs.columns if c not in ("license", "score", "is_license_file", "inherited", "effective")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    matches = saved(_matches(docs.select(text.alias("text")), weigh(docs, templates or default_templates()), threshold, file_threshold), "matches")
    name, directory = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/?[^/]*$", "")
    is_file = F.coalesce(name.rlike(LICENSE_NAME) | F.col("file"), F.lit(False)) & F.col("license").isNotNull()
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    placed = docs.where("path is not null").select("path", keys["k1"].alias("k1"), keys["k2"].alias("k2")).join(matches, ["k1", "k2"])
    files = placed.where(is_file).select(directory.alias("up"), F.struct((-F.col("score")).alias("s"), name.alias("name"), "license").alias("s"))
    files = saved(files.groupBy("up").agg(F.min("s").alias("s")).select("up", F.col("s.license").alias("from_up")), "files")
    # by directory, not by file: each distinct directory looks at all its ancestors and takes the nearest
    dirs = docs.where("path is not null").select(directory.alias("dir")).distinct()
    ups = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(F.split("dir", "/"))))).alias("depth"))
    ups = ups.withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = saved(ups.join(files, "up").groupBy("dir").agg(F.max_by("from_up", "depth").alias("from_up")), "nearest")
    own = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(rest)), F.col("path").alias("path"), directory.alias("dir"), keys["k1"].alias("k1"), keys["k2"].alias("k2"))
    out = own.join(matches, ["k1", "k2"], "left").join(nearest, "dir", "left")
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(rest)]
    return out.select(*back, "license", "score", is_file.alias("is_license_file"), F.col("from_up").alias("inherited"), F.coalesce("license", "from_up").alias("effective"))
