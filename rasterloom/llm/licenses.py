"""Licences of files: TF-IDF cosine to templates, then inheritance down the tree.

Statements are windows of consecutive lines of a text, headers of files and licence
files alike: every window of up to :data:`WINDOW` lines, and each whole block of
lines without a blank one, that begins and ends with a line holding a word of a
template; of a file named as a licence also its whole text. Function words do not
count. Windows that hold none of :func:`key_words`, or too many other words beside a
template's, cannot reach the least cosine whatever the rest of their vector; both
bounds lose nothing. Equal windows are one statement, known by a digest, so a notice on
a third of all files is classified once. Statements and templates are sparse TF-IDF
vectors over the lines of the whole corpus that hold a template's word; a statement
takes the template of the largest cosine, if it is large enough, and a file the
statement whose part along its template is longest, so that a whole licence outweighs
a sentence that it shares with another. A line with an SPDX identifier is that
licence. Templates are titles, notices and short licences as a
whole; long licences are known by their titles and notices.

A licence file is one named as such, or one that is mostly statements. Its
directory takes its licence, the commonest where there are several. A file with
no licence of its own inherits from the nearest licensed directory above it: each
distinct directory is joined with its ancestors once, and files with their
directory. DataFrame operations only.

Defined results: a null text has no statements; a very long text is read whole, and so
is a line of any length; a null path has no directory and
inherits nothing; rows that repeat are reported each; ties go to the first licence by name;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.words import word_count
from rasterloom.session import local_table, stored

# Public licence texts, notices and titles.
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES = (
    ("MIT", f"MIT License {_MIT} {_WARRANTY}"),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD} {_BSD_3} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("ISC", f"ISC License {_ISC} {_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License. Simplified BSD License."),
    ("BSD-3-Clause", "BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Public domain."),
    ("GPL-2.0", "GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "ISC License."),
    ("ISC", _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Words of the templates that carry no licence.
FUNCTION_WORDS = frozenset("a above all an and any are as at be but by do either except following for has how if in including is it its may met no nor not of on or other out own so such that the this to under use way we whom with without you your".split())
WORDS = sorted({t for _, text in TEMPLATES for t in re.split(r"[^a-z0-9]+", text.lower())} - FUNCTION_WORDS - {""})


def any_of(words: list[str]) -> str:
    """A pattern for any of the words as a whole, in lower case, which tries each first letter once, and so on."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        found = [re.escape(c) + pattern(rest) for c, rest in sorted(node.items()) if c]
        if not found:
            return ""
        return (found[0] if len(found) == 1 and "" not in node else "(?:" + "|".join(found) + ")") + ("?" if "" in node else "")

    return r"(?<![\p{L}\p{N}])" + pattern(tree) + r"(?![\p{L}\p{N}])"


#: A line, in lower case, that holds a template's word.
CUE = any_of([*WORDS, "spdx"])
LINE_END = r"\r\n|[\n\r]"
SPDX = r"SPDX-License-Identifier:\s*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?:\s+(?:OR|AND|WITH)\s+\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)"
#: Lines of a window at most; a block without blank lines is one too, however long.
WINDOW = 8
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|copyright)([.-].*)?$"
#: Least cosine of a match; least share of a text's words in statements to make it a licence file.
LEAST_COSINE, FILE_SHARE = 0.6, 0.3
#: Licensed folders are broadcast up to this many (some 100 bytes each).
BROADCAST_FOLDERS = 200_000
#: Weight of an identifier: above that of any text.
NAMED = 1e9


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(*sorted(FUNCTION_WORDS)))


def frequencies(spark: SparkSession, files: DataFrame, text_col: str) -> DataFrame:
    """token, df over the lines that hold a template's word; their number is that of the empty token. A stored table."""
    lines = files.select(F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), LINE_END)).alias("line")).where(F.lower("line").rlike(CUE))
    tokens = lines.select(F.explode(F.concat(F.array_distinct(tokens_of(F.col("line"))), F.array(F.lit("")))).alias("token"))
    return stored(spark, tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "license-tokens")


def key_words(idf: dict[str, float]) -> list[str]:
    """Words of which every window with the least cosine to a template holds one.

    The words a window shares with a template carry at least LEAST_COSINE of the
    template's length (Cauchy-Schwarz), so its lightest words may go while they
    together carry less.
    """
    keys = {"spdx"}
    for _, text in TEMPLATES:
        tf = Counter(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t and t not in FUNCTION_WORDS)
        square = {t: (n * idf[t]) ** 2 for t, n in tf.items()}
        room = (LEAST_COSINE**2 - 1e-6) * sum(square.values())
        for t in sorted(square, key=lambda t: (square[t], t)):
            room -= square[t]
            if room <= 0:
                keys.add(t)
    return sorted(keys)


def windows_of(lines: Column, hits: Column, cuts: Column, keys: Column, whole: Column) -> Column:
    """(first, last) of each window that begins and ends with a hit and holds a key; lines count from 1, cuts are the blank ones."""
    held = lambda a, b: F.exists(keys, lambda k: (k >= a) & (k <= b))
    window = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    cut = lambda a: F.coalesce(F.try_element_at(F.filter(cuts, lambda x: x > a), F.lit(1)), F.size(lines) + 1)
    # hits near a key, with the first cut after each, so that a window never crosses a blank line
    some = F.filter(hits, lambda a: F.exists(keys, lambda k: (k > a - WINDOW) & (k < a + WINDOW)))
    near = F.transform(some, lambda a: F.struct(a.alias("a"), cut(a).alias("cut")))
    short = F.flatten(F.transform(near, lambda h: F.transform(F.filter(some, lambda b: held(h["a"], b) & (b >= h["a"]) & (b < h["a"] + WINDOW) & (b < h["cut"])), lambda b: window(h["a"], b))))
    ends = F.array_distinct(F.transform(keys, cut))
    before = lambda c: F.coalesce(F.array_max(F.filter(cuts, lambda x: x < c)), F.lit(0))
    block = F.transform(ends, lambda c: F.struct(F.array_min(F.filter(hits, lambda a: (a > before(c)) & (a < c))).alias("a"), F.array_max(F.filter(hits, lambda b: b < c)).alias("b")))
    long = F.transform(F.filter(block, lambda x: x["b"] - x["a"] >= WINDOW), lambda x: window(x["a"], x["b"]))
    all_ = F.when(whole & (F.size(keys) > 0), F.array(window(F.lit(1), F.size(lines)))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    return F.array_distinct(F.concat(short, long, all_))


def may_match(tokens: Column, idf: dict[str, float]) -> Column:
    """Whether a window of these tokens can have the least cosine with any vector over the templates' words.

    What lies in those words must carry the least cosine's share of the window's
    length, and each other word weighs 1 at least.
    """
    weight = F.create_map(*[F.lit(x) for w in WORDS for x in (w, float(idf[w]))])
    known = F.array_distinct(F.filter(tokens, lambda t: t.isin(WORDS)))
    others = F.size(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(WORDS))))
    square = F.aggregate(known, F.lit(0.0), lambda acc, t: acc + F.pow(F.element_at(weight, t) * F.size(F.filter(tokens, lambda x: x == t)), F.lit(2.0)))
    least = LEAST_COSINE**2 - 1e-6
    return square * (1 - least) >= least * others


def statements(spark: SparkSession, files: DataFrame, path: Column, text_col: str, keys: list[str], key: str, idf: dict[str, float]) -> DataFrame:
    """row, the keys, path, directory, n_words, windows (first, last), lines (from line base on) and their words: a stored table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    rows = files.select(*keys, path.alias("path"), word_count(F.col(text_col)).alias("n_words"), F.when(F.lower(text).rlike(key), F.transform(F.split(text, LINE_END), lambda x: F.trim(x))).otherwise(none).alias("all"))
    places = F.sequence(F.lit(1), F.size("all"))
    where = lambda ok: F.when(F.size("all") > 0, F.filter(F.zip_with("all", places, lambda x, k: F.when(ok(x), k)), lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns({"hits": where(lambda x: F.lower(x).rlike(CUE)), "cuts": where(lambda x: x == ""), "held": where(lambda x: F.lower(x).rlike(key)), "tokens": F.transform("all", tokens_of)})
    spdx = lambda w: F.exists(F.slice("all", w["first"], w["last"] - w["first"] + 1), lambda x: x.contains("SPDX"))
    fits = lambda w: spdx(w) | may_match(F.flatten(F.slice("tokens", w["first"], w["last"] - w["first"] + 1)), idf)
    rows = rows.withColumn("windows", F.filter(windows_of(F.col("all"), F.col("hits"), F.col("cuts"), F.col("held"), _named("path")), fits))
    # only the lines that a window may need are kept
    rows = rows.withColumn("base", F.coalesce(F.array_min(F.transform("windows", lambda w: w["first"])), F.lit(1))).withColumn("end", F.coalesce(F.array_max(F.transform("windows", lambda w: w["last"])), F.lit(0)))
    rows = rows.withColumn("lines", F.when(F.size("windows") > 0, F.slice("all", F.col("base"), F.col("end") - F.col("base") + 1)).otherwise(none))
    rows = rows.withColumn("words", F.transform("lines", word_count)).drop("all", "hits", "cuts", "held", "tokens", "end")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("directory", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return stored(spark, rows, "statements")


def _named(path: str) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(FILE_NAME), F.lit(False))


def classified(spark: SparkSession, counted: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """key, license, cosine, weight (length along the template) for each distinct statement (key, line) that matches a template."""
    templates = local_table(spark, [(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, line string")
    by_token = counted.select("key", F.explode(tokens_of(F.col("line"))).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = by_token.join(frequency, "token", "left").select("key", "token", (F.col("tf") * idf).alias("w"))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    words = templates.select("template", "license", F.explode(tokens_of(F.col("line"))).alias("token")).groupBy("template", "license", "token").agg(F.count(F.lit(1)).alias("tf"))
    known = F.broadcast(frequency.join(F.broadcast(words.select("token").distinct()), "token", "left_semi"))
    tw = words.join(known, "token", "left").select("template", "license", "token", (F.col("tf") * idf).alias("tw"))
    tn = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    vectors = F.broadcast(tw.join(tn, "template"))  # the templates' tokens: a fixed table
    dots = weighed.join(vectors, "token").groupBy("key", "template", "license", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9)
    along = F.round(F.col("dot") / F.col("tnorm"), 6)
    scored = dots.join(norm, "key").select("key", "license", cosine.alias("cosine"), along.alias("weight")).where(F.col("cosine") >= LEAST_COSINE)
    # an identifier names its licence whatever the templates say
    named = counted.select("key", F.regexp_extract("line", SPDX, 1).alias("license"), F.lit(1.0).alias("cosine"), F.lit(NAMED).alias("weight")).where("license <> ''")
    scored = scored.join(named.select("key"), "key", "left_anti").unionAll(named)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "weight")).alias("best"))
    return best.select("key", "best.license", (-F.col("best.c")).alias("cosine"), "best.weight")


def scan(spark: SparkSession, files: DataFrame, *, path: Column, text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, path, own_license, cosine, license_file, license, source (own, inherited, none), inherited_from."""
    frequency = frequencies(spark, files, text_col)
    df = {r.token: r.df for r in frequency.where(F.col("token").isin("", *WORDS)).collect()}
    total = df.get("", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in WORDS}
    rows = statements(spark, files, path, text_col, list(keys), any_of(key_words(idf)), idf)
    at = lambda w, c: F.slice(c, w["first"] - F.col("base") + 1, w["last"] - w["first"] + 1)
    lines = rows.where(F.size("windows") > 0).select("row", "base", "lines", "words", F.explode("windows").alias("w"))
    lines = lines.select("row", "w.first", at(F.col("w"), "words").alias("words"), F.array_join(at(F.col("w"), "lines"), "\n").alias("line")).withColumn("key", F.unhex(F.md5("line")))
    found = classified(spark, stored(spark, lines.groupBy("key").agg(F.min("line").alias("line")), "license-lines"), frequency, total)
    hit = lines.select("row", "first", "words", "key").join(found, "key")
    own = hit.groupBy("row").agg(F.min(F.struct((-F.col("weight")).alias("w"), "license", (-F.col("cosine")).alias("c"))).alias("best"))
    # windows overlap: each line of a match counts once
    covered = hit.select("row", "first", F.posexplode("words").alias("k", "n")).select("row", (F.col("first") + F.col("k")).alias("place"), "n").distinct()
    own = own.join(covered.groupBy("row").agg(F.sum("n").alias("words")), "row").select("row", F.col("best.license").alias("own_license"), (-F.col("best.c")).alias("cosine"), "words")
    is_file = F.col("own_license").isNotNull() & (_named("path") | (F.col("words") >= FILE_SHARE * F.col("n_words")))
    rows = stored(spark, rows.drop("words").join(own, "row", "left").select("row", *keys, "path", "directory", "own_license", "cosine", is_file.alias("license_file")), "own-licenses")

    per_dir = rows.where("license_file and directory is not null").groupBy("directory", "own_license").agg(F.count(F.lit(1)).alias("n"))
    licensed = per_dir.groupBy(F.col("directory").alias("ancestor")).agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("best")).select("ancestor", F.col("best.own_license").alias("dir_license"))
    steps = F.split("directory", "/")
    above = rows.where("directory is not null").select("directory").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(steps))))
    above = above.withColumn("ancestor", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    # a top folder is the ancestor of all: its side is one row, and is broadcast where the table of them is small
    licensed = F.broadcast(licensed) if licensed.count() <= BROADCAST_FOLDERS else licensed
    nearest = above.join(licensed, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("up"))
    out = rows.join(nearest, "directory", "left")
    inherits = F.col("own_license").isNull()
    source = F.when(~inherits, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return out.select(
        *keys, "path", "own_license", "cosine", "license_file",
        F.coalesce("own_license", "up.dir_license").alias("license"), source.alias("license_source"), F.when(inherits, F.col("up.ancestor")).alias("inherited_from"),
    )
