"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A line is compared with each template as a vector of its words' counts times their inverse frequency among the templates;
words that no template has weigh most. Lines that could reach the threshold are found first: for each template, its
anchor words are so many that the others alone stay below the threshold, so a line without any anchor can't reach it.

Headers are found in windows as well: neighbouring lines and sentences of any text that names a licence, compared with the usual
variants and SPDX ids of each licence; and texts as a whole are compared with licence texts. There words that no template has,
such as names and years, weigh little, and repeated words count by their logarithm. Windows are up to ``LINES`` lines, as many
sentences as the longest header has, so that each header is in one window however it is wrapped, and what stands between blank lines.
A window has to name a licence (``NAMING``): the bare word "ISC" is no notice. What says that something is not licensed gives nothing.
A choice of licences is one licence, such as "Apache-2.0 OR MIT".

A file that is a licence text has its licence; else the best template of its lines and windows decides, equal ones by name. A file without one inherits what the licence file of the nearest
directory above it says. Only DataFrame functions are used.

Null texts count as empty. Ties go to the smaller licence name. A null path has no directory and inherits nothing. Rows with
equal keys are one file, with the notices of all of them. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.llm import licence_notices
from lensfold.llm.common import text_or_empty, written

THRESHOLD = 0.8

# Usual wordings of licence notices.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("All-rights-reserved", "All rights reserved."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that stand in all kinds of text, also in other languages: last choice as anchors.
COMMON = {"a", "all", "and", "by", "for", "form", "free", "general", "in", "into", "is", "mit", "of", "source", "sa", "subject", "terms", "the", "this", "to", "under", "use", "v", "version", "work", "0", "1", "2", "3", "4"}
WORD_ENDS = r"[^\p{L}\p{N}]+"

#: Weight of unseen words beside a header or in a licence text, as a part of the rarest word's.
DAMP = 0.2
#: Neighbouring lines of a window. Headers over more lines are found by their sentences: ``sentences_of_headers``.
LINES, SENTENCE_ENDS = 6, r"(?<=[.;:!?])\s+"
#: A line or window that says this gives no licence.
DENIED = r"\b(?:not|never|no\W+longer)\W+(?:\w+\W+){0,2}?licen[sc]ed\b"
#: Words that headers and licence texts are compared without.
STOP = {"a", "an", "and", "as", "at", "be", "by", "can", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "v", "version", "with", "you", "your"}
#: Spellings made alike, in lower case; written so that Python and Java read them alike.
NORMAL = (
    (r"licence", "license"),
    (r"gplv([0-9])", "gpl $1"),
    (r"\bv([0-9])", "$1"),
    (r"\bmit(\W+licens)", "mitlicense$1"),
    (r"\b(under|the|an|licensed?|identifier)(\W{1,4})mit\b", "$1$2mitlicense"),
)
#: What a header or a licence text holds somewhere; and what one of its lines or sentences holds.
NAMING = r"licen[sc]|copyright|spdx|gpl|cc0|cc[ -]by|rights\W+reserved|public\W+domain|permission\W+is|neither\W+the\W+name|creative\W+commons|attribution\W|redistribut|under\W+(?:the\W+)?(?:mit|isc|apache|bsd|mpl|zlib)\b"
NEAR = r"licen[sc]|copyright|spdx|gpl|cc0|cc[ -]by|reserved|domain|permission|neither|commons|attribution|redistribut|\b(?:mit|isc|apache|bsd|mpl|zlib)\b"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


class Templates:
    """Weights of the templates' words; ``unseen`` is that of any other word."""

    def __init__(self, templates=TEMPLATES):
        counts = [Counter(words_of(text)) for _, text in templates]
        seen = Counter(w for c in counts for w in c)
        rarity = lambda df: math.log((1 + len(templates)) / (1 + df)) + 1
        self.unseen = rarity(0)
        self.idf = {w: rarity(df) for w, df in sorted(seen.items())}
        self.vectors = []  # (template, licence, word, weight / norm)
        for i, ((licence, _), count) in enumerate(zip(templates, counts)):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in count.items()))
            self.vectors += [(i, licence, w, n * self.idf[w] / norm) for w, n in sorted(count.items())]

    def anchors(self, threshold: float) -> list[str]:
        """Words of which a line must hold one to reach the threshold with any template."""
        chosen = set()
        for i in {v[0] for v in self.vectors}:
            rest = 1.0
            for _, _, word, weight in sorted((v for v in self.vectors if v[0] == i), key=lambda v: (v[2] in COMMON, -v[3], v[2])):
                if rest < threshold**2 - 1e-9:
                    break
                chosen.add(word)
                rest -= weight**2
        return sorted(chosen)


def line_notices(rows: DataFrame, anchor: str, templates: Templates, threshold: float) -> DataFrame:
    """(file, licence, score): the best licence of the single lines of each of ``rows`` (file, low). Equal lines are scored once."""
    spark = rows.sparkSession
    lines = rows.where(F.col("low").rlike(anchor))
    lines = lines.select("file", F.explode(F.array_distinct(F.split("low", "\n"))).alias("line")).where(F.col("line").rlike(anchor) & ~F.col("line").rlike(DENIED))
    lines = written(lines, "licence-lines")

    # Both tables have a row for each word of the templates, however many files there are.
    idf = F.broadcast(spark.createDataFrame(list(templates.idf.items()), "word string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(templates.vectors, "template int, licence string, word string, weight double"))
    words = lines.select("line").distinct().select("line", F.explode(F.split("line", WORD_ENDS)).alias("word")).where("word <> ''")
    counts = words.groupBy("line", "word").agg(F.count(F.lit(1)).alias("n")).join(idf, "word", "left")
    weighed = written(counts.select("line", "word", (F.col("n") * F.coalesce("idf", F.lit(templates.unseen))).alias("w")), "licence-words")
    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "word").groupBy("line", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "line").select("line", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    by_line = scores.groupBy("line").agg(best).select("line", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"))
    return lines.join(by_line, "line").groupBy("file").agg(best).select(
        "file", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score")
    )


class Damped(Templates):
    """Templates of words as ``normal`` gives them: repeated words count by their logarithm, words in ``STOP`` not at all,
    and words that no template has, such as names and years, little. Where ``names`` is given, other words than these weigh no
    more than unseen ones."""

    def __init__(self, templates, damp: float, names: set[str] | None = None):
        counts = [{w: 1 + math.log(n) for w, n in Counter(words_of(normal_text(text))).items() if w not in STOP} for _, text in templates]
        # Variants that come to the same words are one.
        templates = sorted({(licence, tuple(sorted(c.items()))) for (licence, _), c in zip(templates, counts)})
        seen = Counter(w for _, c in templates for w, _ in c)
        rarity = lambda df: math.log((1 + len(templates)) / (1 + df)) + 1
        self.unseen = damp * rarity(0)
        most = lambda w: math.inf if names is None or w in names else self.unseen
        self.idf = {w: min(rarity(df), most(w)) for w, df in sorted(seen.items())}
        self.vectors = []
        for i, (licence, c) in enumerate(templates):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c))
            self.vectors += [(i, licence, w, n * self.idf[w] / norm) for w, n in c]

    def anchored(self, threshold: float) -> list[tuple[int, str]]:
        """(template, word): a text must hold one of a template's words here to reach the threshold with it."""
        out = []
        for i in {v[0] for v in self.vectors}:
            rest = 1.0
            for _, _, word, weight in sorted((v for v in self.vectors if v[0] == i), key=lambda v: (-self.idf[v[2]], v[2])):
                if rest < threshold**2 - 1e-9:
                    break
                out.append((i, word))
                rest -= weight**2
        return out


@lru_cache(maxsize=1)
def headers() -> Damped:
    return Damped(licence_notices.HEADERS, DAMP, set(words_of(normal_text(licence_notices.NAMING_WORDS))))


@lru_cache(maxsize=1)
def whole_texts() -> Damped:
    return Damped(licence_notices.texts(), DAMP)


def normal_text(text: str) -> str:
    """Lower case; one spelling; MIT is a word of its own where it can't be the German one."""
    text = text.lower()
    for pattern, to in NORMAL:
        text = re.sub(pattern, to.replace("$", "\\"), text)
    return text


def normal(text: Column) -> Column:
    """``normal_text`` of a text in lower case."""
    for pattern, to in NORMAL:
        text = F.regexp_replace(text, pattern, to)
    return text


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression inside a lambda would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(parts: Column, longest: int) -> Column:
    """All runs of up to so many neighbours that name a licence, joined. ``parts`` must be bound."""
    cut = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts) - i)), lambda n: F.array_join(F.slice(parts, i + 1, n), " "))
    # A long text has few starts with a naming part in reach; the others are not cut.
    naming = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(NEAR), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(naming, lambda i: F.sequence(F.greatest(F.lit(0), i - longest + 1), i))))
    return F.filter(F.flatten(F.transform(starts, cut)), lambda w: w.rlike(NAMING) & ~w.rlike(DENIED))


def windows(low: Column) -> Column:
    """Where a notice may stand: neighbouring lines, neighbouring sentences across line ends, pieces between blank lines."""
    lines = F.filter(F.split(low, r"\R"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    flat = F.regexp_replace(low, r"\R[^\p{L}\p{N}\n]*", " ")
    sentences = F.filter(F.split(flat, SENTENCE_ENDS), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    blocks = F.filter(F.split(low, r"\R[^\p{L}\p{N}\n]*\R"), lambda x: x.rlike(NAMING) & ~x.rlike(DENIED))
    return F.array_distinct(F.concat(bound(lines, lambda p: runs(p, LINES)), bound(sentences, lambda p: runs(p, sentences_of_headers())), blocks))


@lru_cache(maxsize=1)
def sentences_of_headers() -> int:
    """The most sentences of any header: windows of so many hold every header whole, over however many lines it is wrapped."""
    return max(len(re.split(SENTENCE_ENDS, text)) for _, text in licence_notices.HEADERS)


def damped_scores(pieces: DataFrame, templates: Damped, threshold: float) -> DataFrame:
    """(piece, score, licence) of those ``pieces`` (unique piece, low) that reach the threshold; the best template's licence."""
    spark = pieces.sparkSession
    # These tables have a row for each word of the templates, however many files there are.
    idf = F.broadcast(spark.createDataFrame(list(templates.idf.items()), "word string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(templates.vectors, "template int, licence string, word string, weight double"))
    anchored = templates.anchored(threshold)
    anchors = F.broadcast(spark.createDataFrame(anchored, "template int, word string"))
    vocabulary, stop, needed = (F.array(*map(F.lit, sorted(x))) for x in (templates.idf, STOP | {""}, {w for _, w in anchored}))

    unknown = lambda words: F.size(F.array_except(F.array_except(words, vocabulary), stop))
    tagged = lambda words: bound(unknown(words), lambda n: F.transform(words, lambda w: F.struct(w.alias("word"), n.alias("others"))))
    # One expression for all that is asked of a text's words: they are cut once.
    words = bound(F.split(normal(F.col("low")), WORD_ENDS), lambda words: F.when(F.arrays_overlap(words, needed), tagged(words)))
    rows = pieces.select("piece", F.explode(words).alias("w")).select("piece", "w.word", "w.others").join(idf, "word")
    rows = rows.groupBy("piece", "word").agg(((F.log(F.count(F.lit(1)).cast("double")) + 1) * F.first("idf")).alias("w"), F.first("others").alias("others"))
    rows = written(rows, "licence-words")
    norms = rows.groupBy("piece").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first("others") * templates.unseen**2).alias("norm"))
    could = rows.join(anchors, "word").select("piece", "template").distinct()
    dots = rows.join(could, "piece").join(vectors, ["template", "word"]).groupBy("piece", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "piece").select("piece", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    return scores.groupBy("piece").agg(best).select("piece", (-F.col("best.minus")).alias("score"), F.col("best.licence").alias("licence"))


def notices(files: DataFrame, key: str, text: str, templates: Templates, threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, score): the licence of each file that has a notice. What is a licence text as a whole has that licence;
    else the best line or window decides. Equal lines, windows and texts are scored once."""
    anchor = r"(?<![\p{L}\p{N}])(?:" + "|".join(templates.anchors(threshold)) + r")(?![\p{L}\p{N}])"
    low = F.lower(text_or_empty(text))
    rows = files.select(F.col(key).alias("file"), low.alias("low"))
    lines = line_notices(rows, anchor, templates, threshold).select("file", F.lit(1).alias("rank"), "licence", "score")

    named = written(rows.where(F.col("low").rlike(NAMING)), "licence-named")
    digest = F.unhex(F.md5("low"))
    found = [lines]
    for rank, pieces, compared in (
        (0, named, whole_texts()),
        (1, named.select("file", F.explode(windows(F.col("low"))).alias("low")), headers()),
    ):
        pieces = written(pieces.withColumn("piece", digest), "licence-windows")
        scores = damped_scores(pieces.dropDuplicates(["piece"]), compared, threshold)
        found.append(pieces.select("file", "piece").join(scores, "piece").select("file", F.lit(rank).alias("rank"), "licence", "score"))
    best = F.min(F.struct("rank", (-F.col("score")).alias("minus"), "licence")).alias("best")
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("file").agg(best).select(F.col("file").alias(key), F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, nearest first, without the root."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def inherited(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """(directory, licence, inherited_from) by the nearest of a directory and its ancestors that ``declared`` (unique
    directory, licence) has."""
    above = directories.where("directory is not null").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("far", "ancestor"))
    said = declared.select(F.col("directory").alias("ancestor"), "licence")
    near = above.join(said, "ancestor").groupBy("directory").agg(F.min(F.struct("far", "ancestor", "licence")).alias("near"))
    return near.select("directory", F.col("near.licence").alias("licence"), F.col("near.ancestor").alias("inherited_from"))
