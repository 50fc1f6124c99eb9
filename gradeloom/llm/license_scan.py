"""License scans (native): a trained paragraph classifier confirmed by template comparison.

Units are paragraphs: texts cut at blank lines, with single line breaks joined. Every paragraph is classified, in
windows of ``WINDOW`` words every ``STEP`` words, in three steps:

1. A binary linear model over hashed word 1- and 2-grams tells licence text from other text. Its weights are
   whole millionths in one array, so a window's score is a sum over its words, exact and without a row per window.
2. Windows above the threshold go to a softmax over the same grams, which names families.
3. A named family stands if the words around the window hold ``COVER`` of the 1- and 2-grams of one of its templates,
   not right behind a negation. Of two families in a paragraph, one falls if all that was found of it belongs to a template
   of the other that fits better (a licence whose name holds another's).

Both are naive Bayes with tempered sums, trained on the whole corpus: the documents are halved by a hash of their texts. In
one half every gram of every sentence is counted as other text, but for sentences that have words of licences and
resemble a template; look-alikes that name no licence are added. A family's gram is as frequent as in that of its templates
that has it most, mixed with other text, as notices stand among it. On the other half, every window is scored, and thresholds are the
least at which hardly any window of other text passes. What is kept of the corpus are counts by gram and by bin of score.

A paragraph is a notice of each family that stands in it. One without any counts as unknown if it has words of
licences (``ANCHOR``) or a window that is surely licence text.

Training and scoring run in the JVM (DataFrame functions), without Python on executors.

Defined results: null and empty texts have no units and no family; ties between families go to the one
that sorts first; repeated rows of a doc_id are counted together, once per row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from functools import cached_property
from typing import NamedTuple

import numpy as np
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, text_of

UNKNOWN = "unknown"
FEATURES = 1 << 18
#: Slots that are looked up together; a power of two.
BLOCK = 32
WINDOW = 12
STEP = 6
#: Share of a notice's grams that are its template's, not those of the text it stands among.
MIX = 0.5
#: Share of the look-alikes in other text.
ALIKE = 0.01
#: A gram's count is raised by this.
SMOOTH = 0.1
#: A word counts in up to three grams, so sums of their logarithms are divided by three.
TEMPER = 3
#: Share of windows that are licence text, before their words are looked at.
PRIOR = 0.01
LEAST_P = 0.1
#: Share of held-out windows of other text that may pass a threshold.
PASSING = 0.005
#: Bins of probability in which held-out windows are counted.
BINS = 1000
#: Probability from which a window is licence text even if no family stands.
SURE = 0.9
COVER = 0.8
#: Words before a template in which a negation denies it.
DENIAL = 3
MILLION = 1_000_000
ANCHOR = r"(?i)licen[sc]|copyright|warrant|redistribut|permission (is|to)|public domain|spdx|all rights reserved|creative commons"
#: Words that deny what follows.
NEGATIONS = ["not", "never", "neither", "nor"]

#: Sentences by which licence notices are known.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license.",
        "License: Apache 2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "License: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "Distributed under the GPLv3.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "zlib": ["This software is provided as-is, without any express or implied warranty; altered source versions must be plainly marked.", "SPDX-License-Identifier: Zlib"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "cc0": ["This work has been dedicated to the public domain under CC0 1.0 Universal license."],
}
#: Sentences with the same words that name no licence.
LOOKALIKES = [
    "All rights reserved.",
    "Copyright notice applies to this page.",
    "The driver must show a valid license at the counter.",
    "This product comes with a limited warranty of two years.",
    "No part of this publication may be redistributed without written permission of the publisher.",
    "Permission is required to enter the building.",
    "The license fee is due every month.",
    "A version of the work is in the public domain in some countries.",
    "Software and documentation are available to any person on request under copyright law.",
]


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.array_distinct(F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))))


def _slot(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(FEATURES))


def _slots(words: Column, first: Column, length: Column | int = WINDOW) -> Column:
    """Features of a window: slots of its words, and of the pairs that end in it."""
    at = F.slice(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i - 1).alias("before"))), first + 1, F.lit(length))
    pairs = F.filter(at, lambda x: x["before"].isNotNull())
    return F.concat(F.transform(at, lambda x: _slot(x["w"])), F.transform(pairs, lambda x: _slot(x["before"], x["w"]))).cast("array<int>")


def _word_slots(words: Column) -> tuple[Column, Column]:
    """By place, the slot of the word and that of the pair that ends there, null at the first."""
    return F.transform(words, lambda w: _slot(w)), F.transform(words, lambda w, i: F.when(i > 0, _slot(F.get(words, i - 1), w)))


def _starts(words: Column) -> Column:
    """First places of the windows: every word lies in one, and runs of up to WINDOW - STEP + 1 words lie whole in one."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - STEP, F.lit(0)), F.lit(STEP))


def _cut(docs: DataFrame, at: str) -> DataFrame:
    parts = F.filter(F.split(text_of(), at), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return docs.select("doc_id", F.explode(parts).alias("unit"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, unit): a row per line or sentence with a word, none for texts without."""
    return _cut(docs, r"\n|(?<=[.!?])\s+")


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit): a row per paragraph with a word, its lines joined; none for texts without."""
    return _cut(docs, r"\r?\n[^\S\n]*\n\s*").withColumn("unit", F.regexp_replace("unit", r"\s+", " "))


def template_words(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


#: Words of the longest template: how far from a window its template can reach.
REACH = max(len(template_words(t)) for some in TEMPLATES.values() for t in some)


def _templates(spark: SparkSession) -> DataFrame:
    """(family, own, head, length, words): a row per template; own are its grams, head its first two words."""
    rows = []
    for family, some in TEMPLATES.items():
        for t in some:
            w = template_words(t)
            own = list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:], strict=False))]))
            rows.append({"family": family, "own": own, "head": " ".join(w[:2]), "length": len(w), "words": w})
    kind = "array<struct<family:string,own:array<string>,head:string,length:int,words:array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _integers(values: Iterable[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _number(slot: Column, numbers: dict[int, int]) -> Column:
    """The number of a slot, 0 if it has none: blocks of BLOCK slots with a number lie one after another behind an empty one."""
    blocks = sorted({k // BLOCK for k in numbers})
    starts = {b: (i + 1) * BLOCK for i, b in enumerate(blocks)}
    first = _integers(starts.get(b, 0) for b in range(FEATURES // BLOCK))
    rows = _integers([*[0] * BLOCK, *(numbers.get(b * BLOCK + i, 0) for b in blocks for i in range(BLOCK))])
    return F.get(rows, F.get(first, F.shiftright(slot, BLOCK.bit_length() - 1).cast("int")) + slot.bitwiseAND(BLOCK - 1).cast("int"))


def _resembles(words: Column) -> Column:
    """Whether the words hold over half of what confirms some template."""
    own = [list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:], strict=False))])) for some in TEMPLATES.values() for w in map(template_words, some)]
    table = F.array(*[F.split(F.lit("|".join(x)), "[|]") for x in own])
    return let(_grams(words), lambda held: F.exists(table, lambda t: F.size(F.array_intersect(t, held)) >= COVER / 2 * F.size(t)))


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("license"), text_of()), F.lit(2)) == 0


def gram_counts(docs: DataFrame, slots: Iterable[int]) -> DataFrame:
    """(slot, n): how often grams of each of ``slots`` occur in all sentences of ``docs`` that are other text, and, for slot -1, grams of any."""
    slots = sorted({*slots})
    row = lambda x: _number(x, {k: i + 1 for i, k in enumerate(slots)})
    one = lambda at, n: F.struct(at.alias("row"), n.cast("long").alias("n"))

    def found(words: Column) -> Column:
        places = F.concat(*[F.filter(F.transform(x, row), lambda i: i > 0) for x in _word_slots(words)])
        # with less than two grams of templates nothing resembles one
        alike = lambda rows: F.when((F.size(rows) > 1) & F.col("unit").rlike(ANCHOR), _resembles(words)).otherwise(F.lit(False))
        every = F.array(one(F.lit(0), 2 * F.size(words) - 1))
        return let(places, lambda rows: F.when(~alike(rows), F.concat(every, F.transform(rows, lambda i: one(i, F.lit(1))))))

    rows = sentences(docs).select(F.inline(let(_words(F.col("unit")), found))).groupBy("row").agg(F.sum("n").alias("n"))
    return rows.select(F.get(_integers([-1, *slots]), F.col("row")).alias("slot"), "n")


def _fixed_slots(spark: SparkSession) -> list[tuple[str, list[int]]]:
    """(family, slots) of every template and, as unknown, look-alike."""
    rows = [(f, template_words(t)) for f, some in [*TEMPLATES.items(), (UNKNOWN, LOOKALIKES)] for t in some]
    kind = "array<struct<family:string,words:array<string>>>"
    table = F.from_json(F.lit(json.dumps([{"family": f, "words": w} for f, w in rows])), kind)
    rows = spark.range(1).select(F.inline(table)).select("family", _slots(F.col("words"), F.lit(0), F.size("words")).alias("slots"))
    return [(r.family, r.slots) for r in rows.collect()]


class Linear(NamedTuple):
    coefficientMatrix: DenseMatrix
    interceptVector: DenseVector


class Fitted:
    """Both models, of fixed size: ``rows`` has the weights of every family in millionths for each slot of a template, the first
    one those of all other slots, and ``place`` the row of each such slot. Of the first model, ``weights`` (the most of a slot's row; the
    bias last) and ``notice_cut``, the probability that lets a window on; of the second, ``families``, ``model`` (rows and bias as
    matrices) and the threshold of each family in ``cuts``."""

    def __init__(self, docs: DataFrame):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        known = self.families[:-1]
        fixed = _fixed_slots(docs.sparkSession)
        alike = [x for f, slots in fixed if f == UNKNOWN for x in slots]
        share: dict[int, dict[str, float]] = {}
        for family, slots in fixed:
            for k in slots if family != UNKNOWN else ():
                own = share.setdefault(k, {})
                own[family] = max(own.get(family, 0.0), slots.count(k) / len(slots))
        counts = {r.slot: r.n for r in gram_counts(docs.where(~_held_out()), share).collect()}
        total = counts.get(-1, 0) + SMOOTH * FEATURES
        other = {k: (1 - ALIKE) * (counts.get(k, 0) + SMOOTH) / total + ALIKE * alike.count(k) / len(alike) for k in share}

        def weight(k: int, family: str) -> int:
            return round(math.log(1 - MIX + MIX * share[k].get(family, 0.0) / other[k]) / TEMPER * MILLION)

        absent = round(math.log(1 - MIX) / TEMPER * MILLION)
        self.place = {k: i + 1 for i, k in enumerate(sorted(share))}
        self.rows = [[absent] * len(known), *([weight(k, f) for f in known] for k in self.place)]
        self.bias = _logit(PRIOR)
        self.weights = [max(self.rows[self.place.get(k, 0)]) for k in range(FEATURES)] + [self.bias]
        self.notice_cut, self.cuts = LEAST_P, [LEAST_P] * len(known)
        self.notice_cut, *self.cuts = self._thresholds(docs.where(_held_out()))

    @cached_property
    def model(self) -> Linear:
        values = np.array([[*row, 0] for row in self.rows])[[self.place.get(k, 0) for k in range(FEATURES)]].T / MILLION
        return Linear(DenseMatrix(*values.shape, values.ravel(), isTransposed=True), DenseVector([self.bias / MILLION] * len(self.cuts) + [0.0]))

    def _thresholds(self, docs: DataFrame) -> list[float]:
        """The least bins, from LEAST_P to SURE, that at most PASSING of all windows of ``docs`` reach, leaving out those
        around which a template is resembled: of the first model, then of each family."""
        low, high = round(LEAST_P * BINS), round(SURE * BINS)
        rows = units(docs).select(_words(F.col("unit")).alias("words"))
        rows = rows.select(F.size(_starts(F.col("words"))).alias("n"), _hits(F.col("words"), self).alias("hits"))
        rows = rows.select("n", F.posexplode_outer("hits").alias("k", "x")).select("n", "k", "x.*")
        rows = rows.withColumn("slots", _slots(F.col("near"), F.col("at")))
        one = lambda model, at, n: F.struct(model.alias("model"), at.cast("int").alias("bin"), n.cast("long").alias("n"))
        # model -1 counts the windows, once a paragraph
        all_windows = F.array(one(F.lit(-1), F.lit(0), F.when(F.coalesce("k", F.lit(0)) == 0, F.col("n")).otherwise(0)))
        first = 1 / (1 + F.exp(-F.col("score") / MILLION))
        p = F.concat(F.array(first), F.slice(_probabilities(F.col("slots"), self), 1, len(self.cuts)))
        bins = F.transform(p, lambda x, i: one(i, F.least(F.floor(x * BINS), F.lit(high)), F.lit(1)))
        bins = F.when(F.col("k").isNotNull(), F.when(~_resembles(F.col("near")), F.filter(bins, lambda x: x["bin"] >= low)))
        rows = rows.select(F.inline(F.concat(all_windows, F.coalesce(bins, F.slice(all_windows, 1, 0))))).groupBy("model", "bin").agg(F.sum("n").alias("n"))
        found = {(r.model, r.bin): r.n for r in rows.collect()}
        may = math.floor(PASSING * found.get((-1, 0), 0))
        cuts = []
        for model in range(len(self.cuts) + 1):
            cut, over = high, found.get((model, high), 0)
            while cut > low and over + found.get((model, cut - 1), 0) <= may:
                cut -= 1
                over += found.get((model, cut), 0)
            cuts.append(cut / BINS)
        return cuts


def _logit(p: float) -> int:
    return round(math.log(p / (1 - p)) * MILLION)


def _hits(words: Column, fitted: Fitted) -> Column:
    """(s, score, at, near): the windows that pass the first model; ``near`` are the words REACH around, ``at`` the
    window's place in it."""
    bias, least, absent = fitted.weights[-1], _logit(fitted.notice_cut), fitted.rows[0][0]
    beyond = {k: max(fitted.rows[i]) - absent for k, i in fitted.place.items()}

    def weigh(words: Column) -> Column:
        one, pair = _word_slots(words)
        both = lambda x, y: _number(x, beyond) + F.coalesce(_number(y, beyond) + absent, F.lit(0)) + absent
        return F.zip_with(one, pair, lambda x, y: both(x, y).cast("long"))

    def passing(weights: Column) -> Column:
        total = lambda s: F.aggregate(F.slice(weights, s + 1, F.lit(WINDOW)), F.lit(bias).cast("long"), lambda a, x: a + x)
        return F.filter(F.transform(_starts(weights), lambda s: F.struct(s.alias("s"), total(s).alias("score"))), lambda x: x["score"] >= least)

    def around(words: Column) -> Column:
        def cut(x: Column) -> Column:
            first = F.greatest(x["s"] - REACH, F.lit(0))
            return F.struct(x["s"].alias("s"), x["score"].alias("score"), (x["s"] - first).alias("at"), F.slice(words, first + 1, x["s"] - first + WINDOW + REACH).alias("near"))

        return F.transform(let(weigh(words), passing), cut)

    return let(words, around)


def _probabilities(slots: Column, fitted: Fitted) -> Column:
    """The probability of every family and of none, from a window's slots."""
    table = F.array(*map(_integers, fitted.rows))
    start = F.array_repeat(F.lit(fitted.bias).cast("long"), len(fitted.cuts))
    add = lambda a, k: F.zip_with(a, F.get(table, _number(k, fitted.place)), lambda x, y: x + y)
    margins = F.concat(F.aggregate(slots, start, add), F.array(F.lit(0).cast("long")))
    powers = let(margins, lambda m: F.transform(m, lambda x: F.exp((x - F.array_max(m)) / MILLION)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def _affirmed(span: Column, head: Column) -> Column:
    """Whether the template's first words are found without a negation close before them, or not found."""
    places = F.filter(F.transform(span, lambda w, i: F.when(F.concat_ws(" ", w, F.get(span, i + 1)) == head, i)), lambda i: i.isNotNull())
    denied = lambda i: F.arrays_overlap(F.slice(span, F.greatest(i - DENIAL, F.lit(0)) + 1, F.least(i, F.lit(DENIAL))), F.array(*map(F.lit, NEGATIONS)))
    return (F.size(places) == 0) | F.exists(places, lambda i: ~denied(i))


def scan_units(docs: DataFrame, fitted: Fitted | None = None) -> DataFrame:
    """(doc_id, family, p): a row per paragraph and family that stands in it, ``unknown`` where none does but the
    paragraph has words of licences or surely is licence text."""
    fitted = fitted or Fitted(docs)
    families = F.array(*map(F.lit, fitted.families[:-1]))
    rows = units(docs).select("doc_id", F.monotonically_increasing_id().alias("at_unit"), F.col("unit").rlike(ANCHOR).alias("anchored"), _hits(_words(F.col("unit")), fitted).alias("hits"))
    rows = rows.where("anchored or size(hits) > 0").select("doc_id", "at_unit", "anchored", F.explode_outer("hits").alias("x")).select("doc_id", "at_unit", "anchored", "x.*")
    rows = rows.withColumn("slots", _slots(F.col("near"), F.col("at")))
    scored = rows.withColumn("p", _probabilities(F.col("slots"), fitted))
    cuts = F.array(*map(F.lit, fitted.cuts))
    named = F.filter(F.transform(families, lambda f, k: F.struct(f.alias("family"), F.get("p", k).alias("p"), (F.get("p", k) >= F.get(cuts, k)).alias("on"))), lambda x: x["on"])
    named = F.when(F.col("s").isNotNull(), named)
    sure = F.coalesce(F.col("score") >= _logit(SURE), F.lit(False))
    rows = scored.select("doc_id", "at_unit", (F.col("anchored") | sure).alias("like"), "s", "at", "near", F.explode_outer(named).alias("x"))
    rows = rows.select("doc_id", "at_unit", "like", "s", "at", "near", "x.family", "x.p")

    rows = rows.join(F.broadcast(_templates(docs.sparkSession).drop("words")), "family", "left")
    before = F.least("at", "length")
    rows = rows.withColumn("span", F.slice("near", F.col("at") - before + 1, before + WINDOW + F.col("length")))
    rows = rows.withColumn("found", F.array_intersect("own", _grams(F.col("span")))).withColumn("cover", F.size("found") / F.size("own"))
    stands = (F.col("cover") >= COVER) & _affirmed(F.col("span"), F.col("head"))
    # the best fit of each family in a paragraph
    fit = F.when(stands, F.struct("cover", "found", "own"))
    found = rows.groupBy("doc_id", "at_unit", "family").agg(F.max("like").alias("like"), F.max(F.when(stands, F.col("p"))).alias("p"), F.max(fit).alias("fit"))
    fits = F.collect_list(F.when(F.col("fit").isNotNull(), F.struct("family", "p", "fit")))
    per = found.groupBy("doc_id", "at_unit").agg(F.max("like").alias("like"), fits.alias("fits"))
    part_of = lambda x, y: (y["fit"]["cover"] > x["fit"]["cover"]) & (F.size(F.array_except(x["fit"]["found"], y["fit"]["own"])) == 0)
    left = F.filter("fits", lambda x: ~F.exists("fits", lambda y: part_of(x, y)))
    per = per.select("doc_id", "like", F.transform(left, lambda x: F.struct(x["family"].alias("family"), x["p"].alias("p"))).alias("known"))
    none = F.when(F.col("like"), F.array(F.struct(F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("p"))))
    return per.select("doc_id", F.inline(F.when(F.size("known") > 0, F.col("known")).otherwise(none)))


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per doc_id: n_notices, n_unknown, license (most notices), licenses (all, comma-joined), p."""
    found = scan_units(docs).groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    known = F.col("family") != UNKNOWN
    per = found.groupBy("doc_id").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_notices"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_unknown"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "family"))).alias("top"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("licenses"),
        F.max(F.when(known, F.col("p"))).alias("p"),
    )
    ids = docs.select("doc_id").alias("d")
    out = ids.join(per.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left")
    zero = F.lit(0).cast("long")
    return out.select("d.doc_id", F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.col("top.family").alias("license"), F.coalesce("licenses", F.lit("")).alias("licenses"), "p")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}
