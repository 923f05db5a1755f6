"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

Sparse logistic regressions over word n-grams (one for each licence family; words and pairs of neighbouring
words that stand in a template) are trained on the templates below, whole, in parts and among other words,
against passages of a bounded sample of the corpus. Passages are the lines, and the overlapping word windows of the paragraphs between
blank lines, so that a notice that is wrapped over lines stands whole in a window. Those that hold a word without which no score can reach one half are scored,
over the grams that stand in a template, however many other words the passage has; the likeliest family holds if its probability reaches a limit
calibrated on sampled passages that the weights have not seen, else the passage is of unknown licence. A prediction is confirmed if the
passage also holds ``overlap`` of the word pairs of one of the family's templates.

The corpus is read in one narrow pass without a shuffle: passages stay in their row as arrays. Results for odd input:
null and blank texts have no licence; one row is given for each row of documents, repeated and null ids included;
an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import first_by_hash

# Licence families and wordings of their notices.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "All-Rights-Reserved": ["All rights reserved.", "Copyright holder. All rights reserved. No part of this work may be reproduced without written permission.", "This material is proprietary and confidential. All rights reserved."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is released under the Apache 2.0 license."],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License version 2.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under CC BY 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License."],
    "unknown": ["Licensed under the terms of the license.", "This work is licensed under its own license.", "See the license file for the license terms.", "Released under the terms of the following license."],
}
#: The family of notices that name a licence but none of the above; it is never confirmed.
UNKNOWN = "unknown"


_WORD = re.compile(r"[^\W_]+")
_BETWEEN = r"[^\p{L}\p{N}]+"
#: Words from one window to the next: those of the longest template. Windows are twice as long, so each run of that many words stands whole in one.
STEP = max(len(_WORD.findall(t)) for family in TEMPLATES.values() for t in family)


def grams_of(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbouring words, in order."""
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _grams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words))


def _strings(values: list[str]) -> Column:
    """A constant array; one literal, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _passages(text: Column, good: Callable[[Column], Column]) -> Column:
    """Distinct word lists of the lines and of the windows of the paragraphs of a text, if ``good`` holds for their words, joined."""
    words = lambda parts: F.transform(F.filter(parts, good), lambda x: F.filter(F.split(x, _BETWEEN), lambda w: F.length(w) > 0))
    text = F.lower(F.coalesce(text, F.lit("")))
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / STEP).cast("int") - 2, F.lit(0)))
    windows = F.flatten(F.transform(words(F.split(text, r"\n\s*\n")), lambda w: F.transform(starts(w), lambda k: F.slice(w, k * STEP + 1, 2 * STEP))))
    return F.array_distinct(F.concat(words(F.split(text, "\n")), F.filter(windows, lambda w: good(F.array_join(w, " ")))))


def _sampled(docs: DataFrame, documents: int, paragraphs: int) -> list[list[str]]:
    """Words of at most ``paragraphs`` windows of at most ``documents`` documents; none that names a licence."""
    ids = first_by_hash(docs.where("doc_id is not null and text is not null").select("doc_id"), documents)
    every = _passages(F.col("text"), lambda _: F.lit(True))
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.posexplode(every).alias("place", "words")).where(F.size("words").between(1, 2 * STEP))
    rows = rows.where(~F.array_join("words", " ").rlike("licen[sc]|copyright|rights reserved|public domain"))
    return [list(r.words) for r in rows.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(paragraphs).collect()]


class Model:
    """Weights of the template grams by family, bias, limit, and word pairs of the templates.

    Grams that stand in more than a share of ``usual`` of the plain passages say nothing of a licence and are left out.
    """

    def __init__(self, plain: list[list[str]], steps: int = 400, rate: float = 0.5, sparse: float = 2e-4, usual: float = 0.01):
        self.families = sorted(TEMPLATES)
        self.templates = [(k, _WORD.findall(t.lower())) for k, family in enumerate(self.families) for t in TEMPLATES[family]]
        common = Counter(g for words in plain for g in grams_of(words))
        self.vocabulary = sorted({g for _, words in self.templates for g in grams_of(words) if common[g] <= usual * len(plain)})
        fit, held = plain[::2], plain[1::2]
        rows, goal = [], []
        for i, (k, words) in enumerate(self.templates):
            n = len(words)
            near = fit[i % len(fit)] if fit else []
            for some in (words, words, words[: -(-n * 3 // 4)], words[n // 4 :], near[: n // 2] + words + near[n // 2 : n], words + near[:n], (near[:STEP] + words + near[STEP:])[: 2 * STEP]):
                rows.append(some)
                goal.append(k)
        # a notice without the words that only one family's notices have is one of an unknown licence
        of_word: dict[str, set[int]] = {}
        for k, words in self.templates:
            for w in words:
                of_word.setdefault(w, set()).add(k)
        for k, words in self.templates:
            if {"license", "licensed"} & set(words):
                rows.append([w if len(of_word[w]) > 1 else "" for w in words])
                goal.append(self.families.index(UNKNOWN))
        rows += fit
        goal += [-1] * len(fit)
        x, y = self._matrix(rows), np.array(goal)[:, None] == np.arange(len(self.families))
        weight = np.where(y, 6.0, 1.0) / len(rows)
        w, bias, seen, t = np.zeros((x.shape[1], y.shape[1])), np.full(y.shape[1], -2.0), np.zeros((x.shape[1], y.shape[1])), 1.0
        for _ in range(steps):  # accelerated proximal steps: the soft threshold keeps weights sparse
            pull = weight * (y - 1 / (1 + np.exp(-(x @ seen + bias))))
            new = seen + 60 * rate * (x.T @ pull)
            new = np.sign(new) * np.maximum(np.abs(new) - 60 * rate * sparse, 0)
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            seen, w, t = new + (t - 1) / after * (new - w), new, after
        self.weights = np.round(w, 6)
        self.bias = -2.0
        worst = max((float((1 / (1 + np.exp(2.0 - self._matrix(held[k : k + 500]) @ self.weights))).max()) for k in range(0, len(held), 500)), default=0.0)
        self.limit = min(0.9, max(0.5, worst + 0.02))
        positive = [g for g, row in zip(self.vocabulary, self.weights, strict=True) if row.max() > 0]
        #: A passage without any of these words cannot pass one half: see ``reach``.
        self.gate = sorted({w for g in positive for w in g.split()})
        for word in sorted(self.gate, key=lambda w: (-common[w], len(w), w)):  # the commonest go first
            fewer = [w for w in self.gate if w != word]
            if self.reach(fewer) < -self.bias - 1e-6:
                self.gate = fewer

    def reach(self, gate: list[str]) -> float:
        """The highest score of any family that a passage without the words of ``gate`` can get.

        The score is the sum of the weights of the grams that stand in a template over the root of their number, so
        it is highest for some of the grams of largest weight.
        """
        free = [i for i, g in enumerate(self.vocabulary) if not set(g.split()) & set(gate)]
        if not free:
            return 0.0
        best = -np.sort(-self.weights[free], axis=0)
        return float((np.cumsum(best, axis=0) / np.sqrt(np.arange(1, len(free) + 1))[:, None]).max())

    def _matrix(self, rows: list[list[str]]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(at)))
        for i, words in enumerate(rows):
            grams = [g for g in grams_of(words) if g in at]
            for g in grams:
                x[i, at[g]] = 1 / len(grams) ** 0.5
        return x


def scan(docs: DataFrame, overlap: float = 0.6, documents: int = 600, paragraphs: int = 2_000) -> DataFrame:
    """Rows (doc_id, family, probability, confirmed, families, n_scored), one for each row of ``docs`` (doc_id, text).

    ``family`` is that of the likeliest confirmed passage, else "unknown" if a passage reached half the probability but
    not the limit or no template, else "none"; ``families`` are all confirmed ones, joined by commas; ``n_scored`` counts distinct scored passages.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = Model(_sampled(docs, documents, paragraphs))
    count, known = len(model.families), set(model.vocabulary)
    table = F.from_json(F.lit(json.dumps({g: list(row) for g, row in zip(model.vocabulary, model.weights.tolist(), strict=True)})), "map<string,array<double>>")
    zeros = F.array(*[F.lit(0.0)] * count)
    names = _strings(model.families)
    gate = r"(?<![\p{L}\p{N}])(?:" + "|".join(model.gate) + r")(?![\p{L}\p{N}])"
    held = F.when(F.lower("text").rlike(gate), F.col("text"))
    lines = _passages(held, lambda x: x.rlike(gate)) if model.gate else F.array().cast("array<array<string>>")
    step = docs.select("doc_id", lines.alias("x"))
    step = step.select("doc_id", F.transform("x", _grams).alias("x"))
    step = step.select("doc_id", F.transform("x", lambda g: F.struct(F.array_intersect(g, _strings(model.vocabulary)).alias("hits"))).alias("x"))
    total = lambda x: F.aggregate(x["hits"], zeros, lambda a, g: F.zip_with(a, table[g], lambda p, q: p + q))
    step = step.select("doc_id", F.transform("x", lambda x: F.struct(x["hits"].alias("hits"), F.transform(total(x), lambda s: 1 / (1 + F.exp(-(s / F.sqrt(F.greatest(F.size(x["hits"]), F.lit(1))) + model.bias)))).alias("p"))).alias("x"))
    best = lambda x: F.array_max(F.transform(x["p"], lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    step = step.select("doc_id", F.transform("x", lambda x: F.struct(x["hits"].alias("hits"), best(x).alias("best"))).alias("x"))

    def confirmed(x: Column) -> Column:
        share = []
        for k, words in model.templates:
            if model.families[k] == UNKNOWN:
                continue
            pairs = [g for g in grams_of(words) if " " in g and g in known]
            share.append(F.when(-x["best"]["i"] == k, F.size(F.array_intersect(x["hits"], _strings(pairs))) >= overlap * len(pairs)))
        return F.coalesce(F.exists(F.array(*share), lambda s: F.coalesce(s, F.lit(False))), F.lit(False)) & (x["best"]["p"] >= model.limit)

    step = step.select("doc_id", F.transform("x", lambda x: F.struct(confirmed(x).alias("ok"), x["best"]["p"].alias("p"), F.element_at(names, 1 - x["best"]["i"]).alias("family"))).alias("x"))
    step = step.select("doc_id", F.size("x").alias("n_scored"), F.filter("x", lambda x: x["ok"]).alias("good"), F.array_max(F.transform("x", lambda x: x["p"])).alias("top"))
    likeliest = F.array_max(F.transform("good", lambda x: F.struct(x["p"].alias("p"), x["family"].alias("family"))))
    step = step.select("doc_id", "n_scored", "good", "top", likeliest.alias("best"))
    family = F.coalesce(F.col("best.family"), F.when(F.col("top") >= 0.5, "unknown"), F.lit("none"))
    return step.select(
        "doc_id",
        family.alias("family"),
        F.coalesce(F.col("best.p"), F.col("top"), F.lit(0.0)).alias("probability"),
        F.col("best").isNotNull().alias("confirmed"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("good", lambda x: x["family"])))).alias("families"),
        F.col("n_scored").cast("long").alias("n_scored"),
    )
