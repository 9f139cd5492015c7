"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is what blank lines set apart, with its lines joined and the signs of comments taken off. In a paragraph the
runs of words that hold a template's word pairs are looked up, those of other words between them too; a multinomial logistic regression over word
bigrams and trigrams says of which family a run is, or that it is none. A run counts if the family is the template's own
and its probability reaches a threshold. Probabilities are calibrated by a temperature on examples held out, and the
threshold on families held out: models that were not trained on a family must call its notices unknown.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, texts_of

#: Names and versions of licences of which notices follow one pattern, by SPDX identifier.
NAMED = {
    "apache-2.0": ["Apache License, Version 2.0"],
    "gpl-2.0": ["GNU General Public License, version 2"],
    "gpl-3.0": ["GNU General Public License, version 3"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3"],
    "agpl-3.0": ["GNU Affero General Public License, version 3"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
    "bsl-1.0": ["Boost Software License, Version 1.0"],
    "mit": ["MIT License"],
    "isc": ["ISC License"],
    "zlib": ["zlib License"],
    "bsd-2-clause": ["BSD 2-Clause License"],
    "bsd-3-clause": ["BSD 3-Clause License"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
#: How such notices are put.
PATTERNS = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "This project is licensed under the {}", "This work is licensed under a {}", "This work is licensed under the {}", "subject to the terms of the {}"]
_FREE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Passages of the licences' own texts and notices.
OWN = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "gpl-2.0": [_FREE.format(what="program", name="GNU General Public License", version="2")],
    "gpl-3.0": [_FREE.format(what="program", name="GNU General Public License", version="3")],
    "lgpl-2.1": [_FREE.format(what="library", name="GNU Lesser General Public License", version="2.1")],
    "lgpl-3.0": [_FREE.format(what="library", name="GNU Lesser General Public License", version="3")],
    "agpl-3.0": [_FREE.format(what="program", name="GNU Affero General Public License", version="3")],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "bsd-2-clause": [f"{_REDISTRIBUTE} {_CLAUSES}", _REDISTRIBUTE],
    "bsd-3-clause": [f"{_REDISTRIBUTE} {_CLAUSES} {_ENDORSE}", "Use of this source code is governed by a BSD-style license"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced", "Unauthorized copying of this file is strictly prohibited"],
}
FAMILIES = sorted({*NAMED, *OWN})
TEMPLATES = {f: [*OWN.get(f, []), *(p.format(name) for name in NAMED.get(f, []) for p in PATTERNS)] for f in FAMILIES}
NONE = len(FAMILIES)
#: Paragraphs of the corpus to train against (a bounded sample, each of at most LONGEST characters), their n-grams in the vocabulary, variants of each
#: notice, folds of families held out, the share of their notices that may pass the threshold, and the share of a template's bigrams that a run must hold.
SAMPLE, LONGEST, CORPUS_GRAMS, VARIANTS, FOLDS, PASS, CONFIRM = 2000, 5000, 500, 6, 2, 0.05, 0.75
#: Added to the threshold.
_HAIR = 1e-6
_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")  # hyphens part words, as lines may be wrapped there
_SIGNS = re.compile(r"^[ \t]*(?:#+|/{2,}|/\*+|\*+/?|--+|;+|%+|>+|\|)[ \t]*|[ \t]*\*/[ \t]*$", re.M)
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def grams(words: list[str]) -> set[str]:
    """Bigrams and trigrams of the words."""
    pairs = pairs_of(words)
    return {*pairs, *(f"{a} {b}" for a, b in zip(pairs, words[2:], strict=False))}


def paragraphs(text: str) -> list[str]:
    """What blank lines set apart, without the signs of comments at the lines' ends."""
    return [p for p in _BLANK.split(_SIGNS.sub("", text.replace("\r\n", "\n"))) if p.strip()]


class Template:
    def __init__(self, family: int, text: str):
        self.family, self.words = family, words_of(text)
        self.pairs = frozenset(pairs_of(self.words))
        #: Pairs that tell versions apart: those with a number must be held.
        self.marks = frozenset(p for p in self.pairs if any(c.isdigit() for c in p))
        self.need = math.ceil(CONFIRM * len(self.pairs))


ALL = [Template(k, t) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
_BY_PAIR: dict[str, list[int]] = defaultdict(list)
for _k, _t in enumerate(ALL):
    for _p in _t.pairs:
        _BY_PAIR[_p].append(_k)


def anchors() -> list[str]:
    """Words of which every run that holds enough of a template has at least one: for each template the longest ones, until too few of its pairs are without."""
    out: set[str] = set()
    for t in ALL:
        free = {p for p in t.pairs if not out & set(p.split())}
        for word in sorted(set(t.words), key=lambda w: (-len(w), w)):
            if len(free) < t.need:
                break
            if any(word in p.split() for p in free):
                out.add(word)
                free = {p for p in free if word not in p.split()}
    return sorted(out)


def places(words: list[str]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """A template and where its pairs stand, for each of which enough distinct ones and all of those with numbers are among the words."""
    out: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for j, pair in enumerate(pairs_of(words)):
        for k in _BY_PAIR.get(pair, ()):
            out[k].append((j, pair))
    for k, found in out.items():
        t = ALL[k]
        if len(found) >= t.need and len(held := {pair for _, pair in found}) >= t.need and t.marks <= held:
            yield k, found


def apart(candidates: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (pairs held, start, end), by end, those that don't overlap and whose numbers of pairs have the greatest sum of squares: two of which each holds
    enough before one that is made of parts of both, and a full one before parts of it."""
    ends, sums, chains = [0], [0], [None]
    for run in candidates:
        k = bisect_right(ends, run[1]) - 1
        if (total := sums[k] + run[0] ** 2) > sums[-1]:
            if ends[-1] == run[2]:
                sums[-1], chains[-1] = total, (run, chains[k])
            else:
                ends.append(run[2])
                sums.append(total)
                chains.append((run, chains[k]))
    out, chain = [], chains[-1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def near(t: Template, found: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """Runs of at most about twice the template's words, by end: the fullest at each end, and what is left of it without its first pairs while that is enough."""
    held: Counter[str] = Counter()
    first = 0
    for at, (j, pair) in enumerate(found):
        held[pair] += 1
        while held and (held[found[first][1]] > 1 or j - found[first][0] > 2 * len(t.words)):  # a pair that comes again later, or lies too far back
            held[found[first][1]] -= 1
            if not held[found[first][1]]:
                del held[found[first][1]]
            first += 1
        if len(held) >= t.need and t.marks <= held.keys():
            left, n = Counter(held), len(held)
            for start, gone in found[first : at + 1]:
                if left[gone] == 1:
                    yield n, start, j + 2
                    n -= 1
                    if n < t.need or gone in t.marks:
                        break
                left[gone] -= 1


def far(t: Template, found: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """The shortest run at each end that holds enough, whatever its length, by end; those of near() are left out."""
    last: dict[str, int] = {}  # where a pair stands last, the latest at the end
    for j, pair in found:
        last.pop(pair, None)
        last[pair] = j
        if len(last) >= t.need and t.marks <= last.keys():
            start = min(next(islice(reversed(last.values()), t.need - 1, None)), *(last[p] for p in t.marks), j)
            if j - start > 2 * len(t.words):
                yield sum(1 for _ in takewhile(lambda at: at >= start, reversed(last.values()))), start, j + 2


def runs(words: list[str]) -> list[tuple[int, int, int, int]]:
    """(pairs held, start, end, template) of the runs of words that hold enough of a template's pairs and all of those with numbers, within twice its
    length. Those of one template don't overlap."""
    return [(*run, k) for k, found in places(words) for run in apart(near(ALL[k], found))]


def scattered(words: list[str]) -> list[tuple[int, int, int, int]]:
    """As runs(), for runs that are longer, as other words stand between theirs."""
    return [(*run, k) for k, found in places(words) for run in apart(far(ALL[k], found))]


class Model:
    """Weights by n-gram (a row of a number for each family and for none), intercepts, temperature and threshold; as large as the vocabulary."""

    def __init__(self, weights: dict[str, np.ndarray], intercepts: np.ndarray, temperature: float = 1.0, threshold: float = 0.5):
        self.weights, self.intercepts, self.temperature, self.threshold = weights, intercepts, temperature, threshold

    def logits(self, words: list[str]) -> np.ndarray:
        return self.intercepts + sum((self.weights[g] for g in sorted(grams(words)) if g in self.weights), np.zeros(NONE + 1))

    def classify(self, words: list[str]) -> tuple[int, float]:
        """The best class and its calibrated probability."""
        z = self.logits(words)
        p = np.exp((z - z.max()) / self.temperature)
        return int(p.argmax()), float(p.max() / p.sum())

    def notices(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """Family and probability of every run that is confirmed, and the number of runs that hold a template and are not. Of runs that overlap the one
        that holds most of its template counts, shorter ones before scattered ones. A run's words are taken out, and the others looked through again, as
        words of one notice may stand on both sides of another."""
        good, rest = [], 0
        for paragraph in paragraphs(text):
            words = words_of(paragraph)
            while found := runs(words) or scattered(words):
                taken: list[tuple[int, int]] = []
                for _, start, end, k in sorted(found, key=lambda r: (-r[0], r[1], r[2], r[3])):
                    if any(start < b and a < end for a, b in taken):
                        continue
                    taken.append((start, end))
                    best, p = self.classify(words[start:end])
                    if best == ALL[k].family and p >= self.threshold:
                        good.append((best, p))
                    else:
                        rest += 1
                for start, end in sorted(taken, reverse=True):
                    words[start:end] = [""]  # in no pair of a template
        return good, rest


def examples(corpus: list[str], families: list[int], seed: int = 7) -> list[tuple[list[str], int]]:
    """Varied notices of the families as words, and paragraphs of the corpus that hold no template, parts of notices among them."""
    rng = random.Random(seed)
    plain = [w for p in corpus if not runs(w := words_of(p))]
    filler = [w for words in plain[:200] for w in words[:50]] or ["text"]
    out = [(words, NONE) for words in plain]
    for t in ALL:
        if t.family not in families:
            continue
        for v in range(VARIANTS):
            kept = [w for w in t.words if not v or len(t.words) < 8 or any(c.isdigit() for c in w) or rng.random() > 0.06]
            around = [[rng.choice(filler) for _ in range(rng.randrange(4))] if v % 2 else [] for _ in range(2)]
            out.append(([*around[0], *kept, *around[1]], t.family))
        for _ in range(VARIANTS // 3):
            a = rng.randrange(len(t.words))
            out.append(([*rng.choices(filler, k=8), *t.words[a : a + 2], *rng.choices(filler, k=8)], NONE))
    rng.shuffle(out)
    return out


def fit(spark: SparkSession, data: list[tuple[list[str], int]], vocabulary: list[str]) -> Model:
    rows = spark.createDataFrame([(sorted(grams(w)), float(k)) for w, k in data], "grams array<string>, label double").coalesce(1)  # bounded by SAMPLE and the templates
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(rows).persist()
    found = LogisticRegression(family="multinomial", regParam=1e-5, maxIter=50).fit(vectors)
    vectors.unpersist()
    full = found.coefficientMatrix.toArray()
    intercepts = np.full(NONE + 1, -30.0)
    intercepts[: full.shape[0]] = found.interceptVector.toArray()
    return Model({g: np.pad(full[:, k], (0, NONE + 1 - full.shape[0])) for k, g in enumerate(vocabulary)}, intercepts)


def train(spark: SparkSession, corpus: list[str]) -> Model:
    """Fits on four fifths of the examples, sets the temperature on the rest, and the threshold on families that other fits have not seen."""
    common = Counter(g for p in corpus for g in grams(words_of(p)))
    vocabulary = sorted({g for t in ALL for g in grams(t.words)} | {g for g, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:CORPUS_GRAMS]})
    everyone = [*range(NONE)]
    data = examples(corpus, everyone)
    cut = len(data) // 5
    model = fit(spark, data[cut:], vocabulary)
    held = [(model.logits(w), k) for w, k in data[:cut]]

    def loss(temperature: float) -> float:
        return sum(math.log(np.exp((z - z.max()) / temperature).sum()) - (z[k] - z.max()) / temperature for z, k in held)

    model.temperature = min((2 ** (k / 4) for k in range(-8, 17)), key=loss)
    wrong = []
    for fold in range(FOLDS):
        unseen = [k for k in everyone if k % FOLDS == fold]
        other = fit(spark, examples(corpus, [k for k in everyone if k not in unseen]), vocabulary)
        other.temperature = model.temperature
        for t in (t for t in ALL if t.family in unseen):  # taken for another family, and by a template of that one too
            best, p = other.classify(t.words)
            wrong.append(p if best in {ALL[k].family for *_, k in runs(t.words)} - {t.family} else 0.0)
    wrong.sort()
    # what passes must be better than all but a share of the notices of unseen families, as far as notices of seen ones allow
    right = sorted(p for w, k in data[:cut] if k != NONE for best, p in [model.classify(w)] if best == k)
    model.threshold = max(0.5, min(wrong[int((1 - PASS) * (len(wrong) - 1))] + _HAIR, right[int(PASS / 10 * (len(right) - 1))] if right else 1.0))
    return model


def sample_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> list[str]:
    """At most ``size`` paragraphs to train against, one of each of the rows whose hash is below a bound that the number of rows sets, so that tasks send
    about ``size`` rows in all. A paragraph is picked by the hash too; those of more than LONGEST characters are left out."""
    bound = min((1 << 63) - 1, 3 * size * (1 << 63) // max(1, docs.count()) - (1 << 63))  # hashes are even from -2**63 on: 1.5 * size of all rows lie below it
    h = F.xxhash64(F.col(id_col).cast("string"), text_col)
    drawn = docs.select(h.alias("h"), F.col(text_col).alias("text")).where(F.col("h") <= F.lit(bound))
    blocks = F.filter(F.split("text", r"\n[ \t\r\f\v]*\n"), lambda x: (F.length(x) > 20) & (F.length(x) <= LONGEST))
    drawn = drawn.select("h", blocks.alias("b")).where(F.size("b") > 0)
    picked = drawn.select("h", F.get("b", F.pmod("h", F.size("b")).cast("int")).alias("p")).limit(2 * size).collect()
    return [r["p"] for r in sorted(picked, key=lambda r: (r["h"], r["p"]))[:size]]


def may_hold(text: Column) -> Column:
    """Whether a text has one of the anchors()."""
    low = F.lower(text)
    out = F.lit(False)
    for word in anchors():
        out = out | F.contains(low, F.lit(word))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id, ``families`` (sorted, comma-joined), ``n_paragraphs`` (runs confirmed), ``n_unknown`` (runs that hold a
    template but that the classifier gives to another family, to none, or with too little probability) and ``probability``, the highest of a confirmed one
    (null if none).

    Whole texts are read; one that has none of the anchors() can't hold a notice and is not taken apart. A null or empty text has none. Repeated rows
    and null ids stay, other columns are left out.
    """
    model = model or train(docs.sparkSession, sample_of(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = shared.value.notices
        for batch in by_bytes(batches, "text"):
            families, sure, unknown, best = [], [], [], []
            for text in texts_of(batch, "text"):
                good, rest = notices(text) if text else ([], 0)
                families.append(",".join(sorted({FAMILIES[x[0]] for x in good})))
                sure.append(len(good))
                unknown.append(rest)
                best.append(max((x[1] for x in good), default=None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(families, pa.string()), pa.array(sure, pa.int64()), pa.array(unknown, pa.int64()), pa.array(best, pa.float64())], ["id", "families", "n_paragraphs", "n_unknown", "probability"])

    source = docs.select(F.col(id_col).alias("id"), F.when(may_hold(F.col(text_col)), F.col(text_col)).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, families string, n_paragraphs long, n_unknown long, probability double").withColumnRenamed("id", id_col)
