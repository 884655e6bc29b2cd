"""License scan: TF-IDF cosine of file headers and licence files to templates, and inheritance along directories.

Words are weighted by how rare they are in the whole corpus: by the share of all files that hold them, for every word, not
only those of templates. A word in under one of ``FLOOR`` files weighs as if it were in one, so weights and verdicts depend
on shares and not on the number of files, and the table of frequencies has at most ``FLOOR`` times a file's mean number of
different words. A passage is a line, or any run of words of the whole text that is as long as a template, wherever lines
end; it takes the licence of the template with the highest cosine if that is at least ``COSINE``. Words that tell licences
of one family apart (``DECIDING``) must be in the passage or, where the template ends, just behind it; and a passage that says that a file is *not* so
licensed doesn't count. A file that is little more than such a passage (``BESIDE`` more words of any script in the whole
text), or that is named as a licence file, licenses its directory; files without a licence of their own take that of the
nearest ancestor directory, by joins on paths.

Only words near anchors are looked at: words of a template such that no passage without one can reach the cosine, as the
weights of all its other words stay below it. That is a bound, not a heuristic, so no passage is lost.

Defined cases: a null or empty text has no licence of its own but inherits; texts of any length are scanned whole; a null
path stands in the root directory; of several licence files in one directory the one with the highest cosine counts, then
the licence that sorts first; of passages with one cosine the first template's counts; repeated rows are returned each;
an empty table gives no rows; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import filled, slices
from .common import cut, fits_broadcast, join_groups, named

COSINE = 0.7
#: Most words beside the passage in a file that counts as a licence file.
BESIDE = 12
#: Words in under one of so many files have the same weight.
FLOOR = 1000
#: Different words that a task counts before it hands them on.
HELD = 1 << 18

#: Usual names, notices, headers, titles and bodies of well-known licences.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
)
NOTICES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.")
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
FREEDOMS = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
CLAUSES = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
GNU_HEADER = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {} as published by the Free Software Foundation."
GNU_TITLE = "GNU {}GENERAL PUBLIC LICENSE Version {} Copyright (C) {} Free Software Foundation, Inc."
TEMPLATES = (
    *((licence, notice.format(name)) for licence, name in NAMES for notice in NOTICES),
    ("MIT", GRANT),
    ("MIT", GRANT + FREEDOMS + DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", GNU_HEADER.format("program", ";", "", ";", "2")),
    ("GPL-3.0", GNU_HEADER.format("program", ":", "", ",", "3")),
    ("LGPL-2.1", GNU_HEADER.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", GNU_HEADER.format("library", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0", GNU_HEADER.format("program", ":", "Affero ", ",", "3")),
    ("GPL-2.0", GNU_ONLY.format("2")),
    ("GPL-3.0", GNU_ONLY.format("3")),
    ("GPL-2.0", GNU_TITLE.format("", "2, June 1991", "1989, 1991")),
    ("GPL-3.0", GNU_TITLE.format("", "3, 29 June 2007", "2007")),
    ("LGPL-2.1", GNU_TITLE.format("LESSER ", "2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", GNU_TITLE.format("LESSER ", "3, 29 June 2007", "2007")),
    ("AGPL-3.0", GNU_TITLE.format("AFFERO ", "3, 19 November 2007", "2007")),
    ("BSD-2-Clause", REDISTRIBUTION + CLAUSES + BSD_DISCLAIMER),
    ("BSD-3-Clause", REDISTRIBUTION),
    ("BSD-3-Clause", REDISTRIBUTION + CLAUSES + NO_ENDORSEMENT + BSD_DISCLAIMER),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: By licence, the words of which a passage must have one of each set, and those that it must not have.
DECIDING = {
    "Apache-2.0": (({"2.0", "2"},), set()),
    "GPL-2.0": (({"2", "2.0"},), {"lesser", "library", "affero"}),
    "GPL-3.0": (({"3", "3.0"},), {"lesser", "library", "affero"}),
    "LGPL-2.1": (({"lesser"}, {"2.1"}), set()),
    "LGPL-3.0": (({"lesser"}, {"3", "3.0"}), set()),
    "AGPL-3.0": (({"affero"}, {"3", "3.0"}), set()),
    "BSD-2-Clause": ((), {"3", "neither", "endorse"}),
    "MPL-2.0": (({"2.0", "2"},), set()),
    "CC-BY-4.0": (({"4.0"},), {"sa", "nc", "nd"}),
    "CC-BY-SA-4.0": (({"4.0"}, {"sa"}), {"nc", "nd"}),
    "CC-BY-NC-4.0": (({"4.0"}, {"nc"}), {"sa", "nd"}),
}
#: Words behind a passage that may still decide.
BEHIND = 2
#: What denies a licence, in words as they come: not, and up to two words later a word of permission.
_DENIED = re.compile(r"\b(?:not|never|isn t|no longer)(?: (?!only )[a-z]+){0,2}? (?:licensed|released|covered|distributed under|available under)\b")
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
#: Words of any script, cut as those above are.
_ANY_WORD = re.compile(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """The templates as unit vectors, with weights from document frequencies."""

    def __init__(self, df: dict[str, int], files: int, templates: tuple = TEMPLATES, cosine: float = COSINE) -> None:
        self.cosine, self.files = cosine, files
        self.rare = math.log(FLOOR) + 1
        self.idf = {w: math.log(files / n) + 1 for w, n in df.items() if n * FLOOR > files}
        counts = [(name, Counter(words(t))) for name, t in templates]
        self.vectors = [(name, self._unit(c)) for name, c in counts]
        self.sizes = [c.total() for _, c in counts]
        # anchors: of each template the heaviest words, until the rest can't reach the cosine
        self.anchors: list[frozenset[str]] = []
        for _, v in self.vectors:
            left, own = sorted(v.items(), key=lambda x: (x[1], x[0])), set()
            while math.sqrt(sum(x * x for _, x in left)) >= cosine:
                own.add(left.pop()[0])
            self.anchors.append(frozenset(own))
        every = sorted(frozenset().union(*self.anchors), key=lambda w: (-len(w), w))
        self.find = re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, every)) + r")(?![a-z])").search
        self.known = {w: [k for k, own in enumerate(self.anchors) if w in own] for w in every}

    def _unit(self, counts: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def cosine_of(self, k: int, passage: list[str]) -> float:
        own = self._unit(Counter(passage))
        return sum(x * own[w] for w, x in self.vectors[k][1].items() if w in own)

    def allowed(self, k: int, text: list[str], a: int, b: int) -> bool:
        """Whether the words that decide between licences, and nothing that denies, are in a passage and around it."""
        needs, never = DECIDING.get(self.vectors[k][0], ((), frozenset()))
        inside = set(text[a : b + BEHIND])
        if not all(need & inside for need in needs) or never & set(text[a:b]):
            return False
        return not _DENIED.search(" ".join(text[max(a - 4, 0) : b]))

    def windows(self, k: int, text: list[str], a: int, b: int) -> Iterator[tuple[float, int]]:
        """Cosine and start of all runs of words of template k's length in text[a:b] that reach the cosine."""
        v, size = self.vectors[k][1], self.sizes[k]
        held: Counter = Counter()
        dot = square = 0.0
        for i in range(a, b):
            w = text[i]
            x = self.idf.get(w, self.rare)
            dot += x * v.get(w, 0.0)
            square += x * x * (2 * held[w] + 1)
            held[w] += 1
            if i >= a + size:
                w = text[i - size]
                x = self.idf.get(w, self.rare)
                dot -= x * v.get(w, 0.0)
                held[w] -= 1
                square -= x * x * (2 * held[w] + 1)
            if i >= a + size - 1 and dot > 0 and dot * dot > (self.cosine**2 - 1e-6) * square:
                yield self.cosine_of(k, text[i - size + 1 : i + 1]), i - size + 1

    def passages(self, k: int, text: list[str], at: list[int], ends: list[int]) -> Iterator[tuple[float, int, int]]:
        """Cosine, start and end of all passages of template k, from the places of its anchors and the lines' ends."""
        v, size = self.vectors[k][1], self.sizes[k]
        seen = -1
        for i in at:
            if i >= seen:  # the anchor's line
                line = bisect_right(ends, i)
                a, b = ends[line - 1] if line else 0, ends[line]
                seen = b
                yield self.cosine_of(k, text[a:b]), a, b
        # stretches around anchors, joined where they meet
        stretch: list[list[int]] = []
        for i in at:
            a, b = max(i - size + 1, 0), min(i + size, len(text))
            if stretch and a <= stretch[-1][1]:
                stretch[-1][1] = b
            else:
                stretch.append([a, b])
        for a, b in stretch:
            # a bound: no part has more of the template than the stretch
            if b - a >= size and math.sqrt(sum(v[w] ** 2 for w in v.keys() & set(text[a:b]))) >= self.cosine - 1e-9:
                for score, start in self.windows(k, text, a, b):
                    yield score, start, start + size

    def scan(self, text: str) -> tuple[str | None, float, int]:
        """Licence of a text, its cosine and the number of words of its passage."""
        if not self.find(text.lower()):
            return None, 0.0, 0
        whole: list[str] = []
        ends: list[int] = []
        for line in text.split("\n"):
            whole += words(line)
            ends.append(len(whole))
        at: dict[int, list[int]] = {}
        for i, w in enumerate(whole):
            for k in self.known.get(w, ()):
                at.setdefault(k, []).append(i)
        best, found = (0.0, 0.0, 0), None
        for k in sorted(at):
            for score, a, b in self.passages(k, whole, at[k], ends):
                # of passages with one cosine the longer template's counts, then the first one's
                rank = (round(score, 9), min(self.sizes[k], b - a), b - a)
                if score >= self.cosine - 1e-12 and rank > best and self.allowed(k, whole, a, b):
                    best, found = rank, k
        return (self.vectors[found][0], best[0], best[2]) if found is not None else (None, 0.0, 0)


def frequencies(files: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """In how many of all files each word occurs that is in at least one of ``FLOOR``, and the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["word", "n"])

        for batch in batches:
            texts = filled(batch.column(0))
            for a, b in slices(texts):
                for t in texts.slice(a, b - a).to_pylist():
                    seen.update({"", *words(t)})
                    if len(seen) > HELD:
                        yield counted()
                        seen.clear()
        yield counted()

    # the empty word stands for the file itself
    got = cut(files.select(named(text).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n = (got.where("word = ''").first() or {"n": 0})["n"]
    return {r["word"]: r["n"] for r in got.where((F.col("word") != "") & (F.col("n") * FLOOR > n)).collect()}, n


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, text: str = "text", path: str = "path", file_id: str = "doc_id", templates: tuple = TEMPLATES) -> DataFrame:
    """file id, path, license, how (own, inherited or null), cosine, license_dir (of the licence file it is inherited from)."""
    df, n = frequencies(files, text)
    shared = files.sparkSession.sparkContext.broadcast(Matcher(df, n, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(2))
            for a, b in slices(texts):
                found = []
                for t in texts.slice(a, b - a).to_pylist():
                    name, score, size = shared.value.scan(t)
                    found.append((name, score, name is not None and len(_ANY_WORD.findall(t)) - size <= BESIDE))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["id", "path", "license", "cosine", "alone"])

    found = files.select(named(file_id).cast("long").alias("id"), F.coalesce(named(path), F.lit("")).alias("path"), named(text).cast("string").alias("text")).mapInArrow(run, "id long, path string, license string, cosine double, alone boolean")
    found = cut(found.withColumn("dir", directory(F.col("path"))))
    licence_file = F.col("license").isNotNull() & (F.col("alone") | F.regexp_like(_name(F.col("path")), F.lit(LICENCE_FILE)))
    licensed = cut(found.where(licence_file).groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("dir_license")).select(F.col("dir").alias("above"), "dir_license"))
    dirs = found.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    # each directory with each of its ancestors, the nearest first
    parts = F.split("dir", "/")
    above = dirs.select("dir", "n", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit(""))))).alias("above"))
    if fits_broadcast(licensed.count(), 512):
        below = above.join(F.broadcast(licensed), "above")
    else:
        # every directory is below the root, and others are below many: hot directories are sent, the rest shuffles
        many = above.groupBy("above").agg(F.count(F.lit(1)).alias("below"))
        below = join_groups(above, licensed.join(many, "above"), "above", "below", above.count()).where("dir_license is not null")
    near = below.groupBy("dir").agg(F.first("n").alias("n"), F.max_by(F.struct("dir_license", "above"), F.length("above")).alias("from"))
    met = join_groups(found, near, "dir", "n", found.count())
    own = F.col("license").isNotNull()
    return met.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce("license", "from.dir_license").alias("license"),
        F.when(own, "own").when(F.col("from").isNotNull(), "inherited").alias("how"),
        "cosine",
        F.when(~own, F.col("from.above")).alias("license_dir"),
    )
