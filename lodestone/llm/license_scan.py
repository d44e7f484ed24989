"""License scans: passages compared to license templates by the Dice coefficient. DataFrame functions only.

A text is normalised (lower case, everything but letters and digits to one space); its passages are its lines, its blocks
between blank lines, itself, and windows: as many words as a template has, laid so that one of its anchors meets the same word of the text,
so a notice or license is found inside a longer line or paragraph or across line ends. Passages and templates are compared as sets of word
bigrams. A Dice coefficient of t needs set sizes within a factor of (2 - t) / t, which prunes templates; a set of n bigrams needs n + 1
words, a match of a short template holds one of its anchors, and a match of a long one holds many of its words: that prunes texts and
passages before any bigram is made. It is a map over rows; only matches are shuffled. Templates are a parameter, a literal in the plan (``MAX_TEMPLATES`` and
``MAX_TEMPLATE_WORDS`` at most). A template of more than ``LONG`` words is laid by three words only that stand in it once, and where a
text's words stand for one another in both, its windows may be missed; passages never are.

Result: a row for each document and license that it matches: doc_id, license, dice (the best), n_passages (distinct ones; of a license
that only windows match, the distinct windows with the best coefficient).
Defined cases: null, empty and blank texts match nothing, nor do passages of one word; equal best passages count as one; rows
that share a doc_id share their result row, those without doc_id as well; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

THRESHOLD = 0.8
MAX_TEMPLATES = 200
MAX_TEMPLATE_WORDS = 100_000
#: Words from which a template is laid by a few words only.
LONG = 64

_WARRANTY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: Notices, first paragraphs and texts of licenses; long texts are in the folder ``licenses``.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": _ISC_GRANT,
    "MIT": _MIT_GRANT,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": _MIT_GRANT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": _ISC_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _BSD + _AS_IS + _WARRANTY,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS + _WARRANTY,
} | {f.stem: f.read_text(encoding="utf-8") for f in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}


def normalised_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Words that make poor anchors, being everywhere.
COMMON = "a an and any are as at be by can for from in is it its not of on or that the this to under was will with you use work".split()


def anchors(words: list[str], threshold: float) -> list[str]:
    """Words of which a passage must hold one to reach the threshold: it shares at least need of the template's bigrams, and fewer
    than that hold none of these words."""
    left = set(bigrams(words))
    need = threshold / 2 * (len(left) * threshold / (2 - threshold) + len(left))
    out = []
    while len(left) >= need:
        best = max(sorted({w for b in left for w in b.split()}), key=lambda w: (w not in COMMON, len(w) >= 3, sum(w in b.split() for b in left) * len(w)))
        out.append(best)
        left = {b for b in left if best not in b.split()}
    return out


def vocabulary(words: list[str], threshold: float) -> tuple[list[str], int]:
    """The template's words but common ones, and how many of them a matching text holds at least. A match shares all but a part of the bigrams;
    a missing word costs all that it stands in, of which each may be counted for two words."""
    left = bigrams(words)
    weight: dict[str, int] = {}
    for b in left:
        for w in set(b.split()) - set(COMMON):
            weight[w] = weight.get(w, 0) + 1
    open_ = sum(weight.values()) - 2 * (len(left) - len(left) * threshold / (2 - threshold))
    count = 0
    for x in sorted(weight.values(), reverse=True):
        if open_ <= 0:
            break
        open_, count = open_ - x, count + 1
    return sorted(weight), count


def alignments(words: list[str], threshold: float) -> list[tuple[str, int]]:
    """(word, index) by which a template is laid on a text: its anchors wherever they stand, of a long one three words that stand in it once,
    the longest of each third."""
    if len(words) <= LONG:
        own = anchors(words, threshold)
        return [(x, i) for i, x in enumerate(words) if x in own]
    third = -(-len(words) // 3)
    once = [(x, i) for i, x in enumerate(words) if words.count(x) == 1 and x not in COMMON]
    return [max(own, key=lambda o: (len(o[0]), o)) for k in range(3) if (own := [o for o in once if o[1] // third == k])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    templates = TEMPLATES if templates is None else templates
    parsed = {k: normalised_words(t) for k, t in templates.items()}
    if len(templates) > MAX_TEMPLATES or sum(map(len, parsed.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the plan holds {MAX_TEMPLATES} templates and {MAX_TEMPLATE_WORDS} of their words at most")
    if any(len(w) < 2 for w in parsed.values()):
        raise ValueError("a template needs two words")
    if not parsed:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, dice double, n_passages long")
    ratio = (2 - threshold) / threshold
    sets = {k: bigrams(w) for k, w in parsed.items()}
    least = min(len(b) for b in sets.values()) / ratio  # bigrams that a passage needs to match any template

    # what matches a short template holds an anchor of it, as a plain substring; what matches a long one holds many of its words: most
    # texts go no further
    needed = sorted({a for w in parsed.values() if len(w) <= LONG for a in anchors(w, threshold)})
    long = [k for k, w in parsed.items() if len(w) > LONG]
    least_long = min((len(sets[k]) / ratio for k in long), default=float("inf"))

    def anchored(c: Column) -> Column:
        out = F.lit(False)
        for a in needed:
            out = out | c.contains(a)
        return out

    def like(k: str, held: Column) -> Column:
        own, count = vocabulary(parsed[k], threshold)
        shared = F.size(F.array_intersect(held, F.split(F.lit("\n".join(own)), "\n")))
        return F.when(F.size(held) >= count, shared >= count).otherwise(F.lit(False))

    def judged(lower: Column) -> Column:
        """The text with one blank between words and line ends left in, its words, whether it holds an anchor, and which long templates it is like."""
        text = F.when(anchored(lower) | (F.length(lower) >= 2 * least_long), F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " "))
        flags = lambda w: F.array(*(like(k, w) for k in long)) if long else F.array().cast("array<boolean>")
        made = lambda t, w: F.struct(t.alias("text"), w.alias("words"), flags(w).alias("like"), anchored(lower).alias("anchored"))
        return once(text, lambda t: once(F.split(F.trim(F.regexp_replace(t, r"[ \n]+", " ")), " "), lambda w: made(t, w)))

    # each text is judged once: an array of one row or none, not a filter that would judge it again
    worth = F.filter(F.array(once(F.lower(F.col("text").cast("string")), judged)), lambda r: r["text"].isNotNull() & (r["anchored"] | F.array_contains(r["like"], True)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(worth).alias("__r"))
    rows = rows.select("doc_id", F.col("__r.text").alias("__text"), F.col("__r.words").alias("__words"), F.col("__r.like").alias("__like"))
    blocks = F.when(F.col("__text").rlike(r"\n *\n"), F.split("__text", r"\n *\n")).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.translate("__text", "\n", " "))
    passages = F.concat(F.split("__text", r"\n"), F.transform(blocks, lambda b: F.translate(b, "\n", " ")), whole)
    starts = sorted({(a, i, len(w)) for w in parsed.values() for a, i in alignments(w, threshold)})
    fits = F.array(*(F.struct(F.lit(a).alias("word"), F.lit(i).alias("at"), F.lit(n).alias("n")) for a, i, n in starts))
    words = F.when(F.col("__text").rlike(r"(?:^|[ \n])(?:" + "|".join(sorted({a for a, _, _ in starts})) + r")(?:$|[ \n])"), F.col("__words")).otherwise(F.array().cast("array<string>"))
    held = F.filter(F.transform("__words", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(sorted({a for a, _, _ in starts})))
    laid = lambda h: F.transform(F.filter(fits, lambda f: f["word"] == h["x"]), lambda f: F.concat_ws(" ", F.slice("__words", F.greatest(h["i"] - f["at"], F.lit(0)) + 1, f["n"])))
    windows = F.array_distinct(F.flatten(F.transform(held, laid)))
    marked = lambda c, inside: F.transform(c, lambda p: F.struct(p.alias("p"), F.lit(inside).alias("inside")))
    rows = rows.withColumn("__words", words).select("doc_id", "__like", F.explode(F.concat(marked(F.array_distinct(passages), False), marked(windows, True))).alias("__q"))
    rows = rows.select("doc_id", "__like", F.col("__q.p").alias("__p"), F.col("__q.inside").alias("__inside"))
    # n words have n - 1 blanks between them at least
    blanks = F.length("__p") - F.length(F.translate("__p", " ", ""))
    rows = rows.where((blanks >= max(1, int(least))) & (anchored(F.col("__p")) | (F.array_contains("__like", True) & (blanks >= least_long))))
    rows = rows.select("doc_id", "__like", "__inside", F.trim(F.regexp_replace("__p", " +", " ")).alias("__p"))
    rows = rows.withColumn("__w", F.split("__p", " ")).withColumn("__n", F.size("__w")).where((F.col("__n") >= 2) & (F.col("__n") > least))
    rows = rows.withColumn("__b", F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("__n") - 2), lambda i: F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1)))))
    size, scores = F.size("__b"), []
    for name, own in sets.items():
        near = size.between(len(own) / ratio, len(own) * ratio)
        near = near & F.get("__like", F.lit(long.index(name))) if name in long else near
        shared = F.size(F.array_intersect(F.col("__b"), F.split(F.lit("\n".join(own)), "\n")))
        scores.append(F.when(near, F.struct(F.lit(name).alias("license"), (F.lit(2.0) * shared / (size + len(own))).alias("dice"))))
    # only matches are shuffled, with a digest of the passage that tells equal ones
    found = rows.select("doc_id", "__inside", F.md5(F.col("__p").cast("binary")).alias("__key"), F.explode(F.filter(F.array(*scores), lambda s: s.isNotNull() & (s["dice"] >= threshold))).alias("s")).distinct()
    counted = found.groupBy("doc_id", F.col("s.license").alias("license"), "__inside", F.col("s.dice").alias("dice")).agg(F.count("*").alias("n"))
    outside = F.sum(F.when(~F.col("__inside"), F.col("n")))
    best = F.max(F.struct("dice", "n"))
    return counted.groupBy("doc_id", "license").agg(best["dice"].alias("dice"), F.coalesce(outside, best["n"]).alias("n_passages"))
