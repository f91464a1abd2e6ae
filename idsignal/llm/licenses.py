"""License scans with DataFrame functions only.

1. Templates are bags of tokens `[a-z0-9]+` of lower-cased text: short statements, the headers put
   into source files, and whole licence texts. Weights are tf-idf; document frequencies of the
   templates' tokens are counted over all files.
2. A file is a list of sentences (cut at line breaks and after `. ; : ! ?`). Units are its blocks of 1 to
   64 sentences (`BLOCKS`: size and step), so a statement inside a longer line, a header wrapped over
   lines and a whole text each meet a block of about their size; and the whole of a licence file (by its
   name). A unit whose cosine to a template of at least a quarter of its words (`TIMES`) reaches `SIMILAR` has
   that licence; the best one is the file's own. Tokens outside all templates weigh as tokens no file has.
3. Filter, exact: by Cauchy and Schwarz a unit's cosine is at most the share of a template's norm that
   its tokens make up. So it needs one of the template's heaviest tokens, without which the others are
   too little to reach `SIMILAR`, and at least as many tokens as the heaviest ones need for it. Files
   that hold too few are passed over, then chunks of sentences, then blocks; the rest is scored inside
   its row (`likest`), so only a file's licence is shuffled, never its tokens.
4. A licence file declares its own licence for its directory; that of the root is the empty name. A file
   without one of its own takes that of the nearest ancestor directory that declares one: directories,
   each once, are joined by their path prefixes, and files by their directory.

Files are numbered when they are written, so equal paths, texts or hashes cannot be mixed up.
Templates and their tokens are bounded values of the plan (at most `TEMPLATE_TOKENS` tokens, checked).
Defined cases: null or empty text has no units; null path no directory, hence nothing to inherit; a path
without `/` lies in the root; equal paths are separate files that may declare together (the best cosine
wins, ties to the first name).
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from idsignal.llm.common import packed
from idsignal.workspace import stage

SIMILAR = 0.6
TEMPLATE_TOKENS = 100_000
#: A unit of more than so many times the words of a template is not held against it.
TIMES = 4
SENTENCE_END = r"\n|(?<=[.;:!?])[ \t]+"
#: Sentences of a block and of the way from one block to the next.
BLOCKS = ((1, 1), (2, 1), (4, 1), (8, 2), (16, 4), (32, 8), (64, 16))
#: Sentences of a chunk, a multiple of every step.
CHUNK = 64
LICENCE_FILE = r"^(?i:licen[cs]e|copying|notice)([.-].*)?$"
#: The statements looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright and related rights are waived under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Headers of source files and whole licence texts.
TEXTS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ "
                   "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""),
    ("GPL-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def template_tokens(templates: list[tuple[str, str]]) -> dict[tuple[str, int], Counter]:
    """(licence, number of the template) to its bag of tokens."""
    bags = {(name, i): Counter(re.findall("[a-z0-9]+", text.lower())) for i, (name, text) in enumerate(templates)}
    if sum(map(len, bags.values())) > TEMPLATE_TOKENS:
        raise ValueError(f"templates hold more than {TEMPLATE_TOKENS} tokens")
    return {key: bag for key, bag in bags.items() if bag}


def weights(files: DataFrame, bags: dict[tuple[str, int], Counter]) -> tuple[dict[str, float], float]:
    """idf of every template token over all files, and that of a token no file has."""
    vocabulary = sorted(set().union(*bags.values()))
    known = F.array(*[F.lit(t) for t in vocabulary])
    found = files.select(F.explode(F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), known)).alias("token"))
    counts = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    total = files.where("text is not null").count()
    return {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(total + 1) + 1


def may_reach(text: Column, bags: dict[tuple[str, int], Counter], idf: dict[str, float], unit: bool = False, similar: float = SIMILAR) -> Column:
    """Whether `text` holds tokens enough of some template: one of its heaviest, without which the others
    stay below `similar`, and as many as its heaviest ones need to reach it; a `unit` has no more than `TIMES` its words."""
    array = lambda found: F.array(*[F.lit(t) for t in sorted(found)])
    tests = []
    for bag in bags.values():
        parts = sorted(((n * idf[t]) ** 2, t) for t, n in bag.items())
        bar = (similar - 1e-6) ** 2 * sum(part for part, _ in parts)
        light = list(accumulate(part for part, _ in parts))
        heavy = list(accumulate(part for part, _ in reversed(parts)))
        tests.append(([t for (_, t), rest in zip(parts, light) if rest >= bar], list(bag), 1 + sum(held < bar for held in heavy), sum(bag.values())))
    words = F.split(F.lower(text), "[^a-z0-9]+")
    held = F.struct(F.array_intersect(words, array(idf)).alias("known"), F.size(words).alias("n"))
    return F.exists(F.array(held), lambda h: reduce(operator.or_, [
        ((h["n"] <= TIMES * total + 2) if unit else F.lit(True)) & F.arrays_overlap(h["known"], array(needed))
        & (F.size(F.array_intersect(h["known"], array(whole))) >= count) for needed, whole, count, total in tests]))


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body)[0]


def marks(lines: Column, idf: dict[str, float]) -> Column:
    """(norm, others) of every sentence: the norm of its template tokens, and how many others it has."""
    vocabulary = F.array(*[F.lit(t) for t in sorted(idf)])
    idfs = F.map_from_arrays(vocabulary, F.array(*[F.lit(idf[t]) for t in sorted(idf)]))

    def mark(words: Column) -> Column:
        n = lambda t: F.size(words) - F.size(F.array_remove(words, t))
        start = F.struct(F.lit(0.0).alias("norm"), F.lit(0).alias("held"))
        added = lambda held, t: F.struct((held["norm"] + F.pow(n(t) * F.try_element_at(idfs, t), F.lit(2.0))).alias("norm"), (held["held"] + n(t)).alias("held"))
        return F.aggregate(F.array_intersect(words, vocabulary), start, added,
                           lambda held: F.struct(F.sqrt(held["norm"]).alias("norm"), (F.size(words) - held["held"]).alias("others")))

    return F.transform(lines, lambda line: let(tokens(line), mark))


def may_be_near(block: Column, unseen: float, similar: float = SIMILAR) -> Column:
    """Whether the sentences with these `marks` may make up a unit that passes the bound of `likest`: the
    norm of its template tokens is at most the sum of theirs."""
    bar = (similar - 1e-6) ** 2
    start = F.struct(F.lit(0.0).alias("norm"), F.lit(0).alias("others"))
    return F.aggregate(block, start, lambda held, m: F.struct((held["norm"] + m["norm"]).alias("norm"), (held["others"] + m["others"]).alias("others")),
                       lambda held: (held["norm"] > 0) & (held["norm"] * held["norm"] * (1 - bar) >= held["others"] * F.lit(bar * unseen ** 2)))


def units(files: DataFrame, reach, idf: dict[str, float], unseen: float) -> DataFrame:
    """(number, size, block, line): the blocks of sentences that may reach a template, and whole licence files.

    A file's sentences are cut into chunks of `CHUNK`, each with as many of the next as its blocks reach into.
    """
    longest = max(size for size, _ in BLOCKS)
    chunk = lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CHUNK).cast("int")),
                                      lambda n: F.struct(n.alias("part"), F.slice(lines, n * CHUNK + 1, CHUNK + longest - 1).alias("lines")))
    chunks = (files.select("number", F.explode(F.flatten(F.transform(F.array(F.split("text", SENTENCE_END)), chunk))).alias("c"))
              .select("number", "c.part", "c.lines").where(reach(F.array_join("lines", "\n"))))

    def blocks(size: int, step: int, marked: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.lit(CHUNK // step - 1)), lambda n: may_be_near(F.slice(marked, n * step + 1, size), unseen))
        return F.transform(near, lambda n: F.struct(
            F.lit(size).alias("size"), (F.col("part") * (CHUNK // step) + n).alias("block"),
            F.array_join(F.slice("lines", n * step + 1, size), "\n").alias("line")))

    made = chunks.select("number", F.explode(let(marks(F.col("lines"), idf), lambda marked: F.concat(*[blocks(*b, marked) for b in BLOCKS]))).alias("b")).select("number", "b.*").where(reach(F.col("line"), True))
    whole = files.where("is_licence").select("number", F.lit(0).alias("size"), F.lit(0).alias("block"), F.col("text").alias("line"))
    return made.unionByName(whole)


def likest(line: Column, bags: dict[tuple[str, int], Counter], idf: dict[str, float], unseen: float, similar: float = SIMILAR) -> Column:
    """(minus, licence) of the template nearest to a unit, null if none reaches `similar`; counted inside the row.

    By Cauchy and Schwarz a cosine is at most the share of the unit's norm that template tokens make up, and
    n tokens add n squared weights to it at least; a unit with too many others is passed over before it is scored.
    """
    norms = {key: math.sqrt(sum((n * idf[t]) ** 2 for t, n in b.items())) for key, b in bags.items()}
    array = lambda found: F.array(*[F.lit(x) for x in found])
    templates = F.array(*[F.struct(
        F.lit(key[0]).alias("licence"), F.lit(TIMES * sum(b.values())).alias("longest"),
        F.map_from_arrays(array(sorted(b)), array(n * idf[t] / norms[key] for t, n in sorted(b.items()))).alias("shares")) for key, b in sorted(bags.items())])
    vocabulary = array(sorted(idf))
    idfs = F.map_from_arrays(vocabulary, array(idf[t] for t in sorted(idf)))
    bar = (similar - 1e-6) ** 2

    def squares(words: Column) -> Column:
        """Sum of the squared counts of all tokens, counted up along the sorted ones."""
        start = F.struct(F.lit("").alias("token"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"))
        same = lambda held, w: F.when(held["token"] == w, held["n"]).otherwise(0)
        return F.aggregate(F.sort_array(words), start, lambda held, w: F.struct(
            w.alias("token"), (same(held, w) + 1).alias("n"), (held["sum"] + 2 * same(held, w) + 1).alias("sum")))["sum"]

    def total(known: Column, part, zero: Column) -> Column:
        return F.aggregate(known, zero, lambda held, k: held + part(k))

    def best(words: Column, known: Column, norm: Column) -> Column:
        rest = squares(words) - total(known, lambda k: k["n"] * k["n"], F.lit(0).cast("long"))
        cosine = lambda h, length: F.round(total(known, lambda k: k["w"] * F.coalesce(F.try_element_at(h["shares"], k["token"]), F.lit(0.0)), F.lit(0.0)) / length, 6)
        return let(F.sqrt(norm + rest * F.lit(unseen ** 2)), lambda length: F.array_min(F.filter(
            F.transform(F.filter(templates, lambda h: F.size(words) <= h["longest"]), lambda h: F.struct((-cosine(h, length)).alias("minus"), h["licence"].alias("licence"))),
            lambda found: found["minus"] <= -similar)))

    def judged(words: Column, known: Column) -> Column:
        sums = F.struct(total(known, lambda k: k["w"] * k["w"], F.lit(0.0)).alias("norm"),
                        (F.size(words) - total(known, lambda k: k["n"], F.lit(0).cast("long"))).alias("others"))
        return let(sums, lambda held: F.when((held["norm"] > 0) & (held["norm"] >= bar * (held["norm"] + held["others"] * F.lit(unseen ** 2))),
                                             best(words, known, held["norm"])))

    def weighed(words: Column, t: Column) -> Column:
        n = F.size(words) - F.size(F.array_remove(words, t))
        return F.struct(t.alias("token"), n.cast("long").alias("n"), (n * F.try_element_at(idfs, t)).alias("w"))

    return let(tokens(line), lambda words: let(F.transform(F.array_intersect(words, vocabulary), lambda t: weighed(words, t)), lambda known: judged(words, known)))


def own_licences(files: DataFrame, bags: dict[tuple[str, int], Counter], idf: dict[str, float], unseen: float) -> DataFrame:
    """(number, licence, cosine) of the files that state a licence; only files that may reach a template have text here."""
    made = units(files, lambda text, unit=False: may_reach(text, bags, idf, unit), idf, unseen)
    reached = made.select("number", likest(F.col("line"), bags, idf, unseen).alias("found")).where("found is not null")
    best = reached.groupBy("number").agg(F.min("found").alias("best"))
    return best.select("number", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("cosine"))


def scan(files: DataFrame, carry: list[str], path: str = "path", text: str = "text", templates: dict[str, str] | None = None,
         name: str = "licenses") -> DataFrame:
    """(doc, path, own, cosine, licence, declared_in) per file; `declared_in` is the directory inherited from."""
    bags = template_tokens([*TEMPLATES.items(), *TEXTS] if templates is None else list(templates.items()))
    location = F.col(f"`{path}`").cast("string")
    listed = files.select(packed(files.select(*[f"`{c}`" for c in carry])).alias("doc"), location.alias("path"),
                          F.col(f"`{text}`").cast("string").alias("text"))
    listed = listed.withColumn("is_licence", F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False)))
    idf, unseen = weights(listed, bags)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    # texts travel on only if they may state a licence; numbers hold as they are written
    marked = stage(listed.select(F.monotonically_increasing_id().alias("number"), "doc", "path", "is_licence", folder.alias("folder"),
                                 F.when(may_reach(F.col("text"), bags, idf), F.col("text")).alias("text")), f"{name}-marked")
    own = stage(own_licences(marked.where("text is not null"), bags, idf, unseen), f"{name}-own")
    known = stage(marked.drop("text").join(own, "number", "left"), f"{name}-known")
    declared = (known.where("is_licence and licence is not null and folder is not null").groupBy("folder")
                .agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("best"))
                .select(F.col("folder").alias("above"), F.col("best.licence").alias("given")))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts))),
                        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    folders = stage(known.where("folder is not null and licence is null").select("folder").distinct(), f"{name}-folders")
    nearest = (folders.select("folder", F.explode(above).alias("a")).select("folder", "a.depth", "a.above").join(stage(declared, f"{name}-declared"), "above")
               .groupBy("folder").agg(F.max(F.struct("depth", "given", "above")).alias("near")))
    met = known.join(stage(nearest, f"{name}-nearest"), "folder", "left")
    inherits = F.col("licence").isNull()
    return met.select("doc", "path", F.col("licence").alias("own"), "cosine", F.coalesce("licence", "near.given").alias("licence"),
                      F.when(inherits, F.col("near.above")).alias("declared_in"))
