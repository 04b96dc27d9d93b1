"""Licence scans by a trained paragraph classifier; scoring is built-in functions only.

A paragraph is a line of a text, or a line with its neighbours where a notice is
wrapped. Words and pairs of words are the features of a sparse multinomial
logistic regression over the licence families and the class unknown. It is
fitted on the driver: the templates in many wordings, cut and set among other
words, against decoys and a bounded sample of ordinary lines. A temperature
fitted on held-out ones calibrates the probabilities, the one of unknown too. A
predicted family is confirmed by comparing the paragraph with the family's
templates: ``need`` words of one must be there, and a name of the family where
the template has one, so that the wording that all licences share names none.

Confirmation also tells which lines need not be scored, without loss: of a
template of t words, a confirmed paragraph has at least one of any t - need + 1.
The gate is the rarest so many words of each template.
"""

from __future__ import annotations

import json
import re
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONFIRM = 0.6
#: Templates of fewer words are marks, of which every word must be there.
MARK_WORDS = 5
#: Bounds of the sample of ordinary lines: documents they come from, lines, and characters of a line.
MAX_DOCUMENTS, MAX_ORDINARY, MAX_LINE = 300, 3_000, 5_000

#: Short notices, marks and sentences of the texts by licence family.
TEMPLATES = {
    "MIT": [
        "MIT License", "MIT licensed", "SPDX-License-Identifier: MIT", "Released under the MIT License.", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license", "Distributed under the terms of the MIT license, see the file LICENSE",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "you may not use this file except in compliance with the Apache License",
        "This software is distributed under the terms of the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "GNU General Public License", "GNU GPL", "SPDX-License-Identifier: GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3", "Licensed under the GNU General Public License version 2 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "BSD": [
        "BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": ["Mozilla Public License", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-NC": ["CC BY-NC", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under a CC BY-NC-SA license", "Creative Commons Attribution-NonCommercial-ShareAlike"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under a CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution License"],
    "Public-Domain": ["The Unlicense", "CC0 1.0 Universal", "This is free and unencumbered software released into the public domain", "Licensed under CC0 1.0 Universal", "Dedicated to the public domain under the Unlicense"],
}
#: Words that set a family apart from the others.
NAMES = {
    "MIT": ["mit"], "Apache-2.0": ["apache"], "GPL": ["gnu", "gpl"], "LGPL": ["lesser", "lgpl"], "AGPL": ["affero", "agpl"], "BSD": ["bsd"], "MPL": ["mozilla", "mpl"],
    "CC-BY-NC": ["nc", "noncommercial"], "CC-BY": ["cc", "commons"], "Public-Domain": ["unlicense", "cc0", "domain"],
}
UNKNOWN = "unknown"
#: Notices of families that are not looked for. They are unknown.
OTHERS = [
    "Published under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "Licensed under the Artistic License 2.0", "Released under the Artistic License",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: Zlib", "Released under the zlib License", "Licensed under the European Union Public Licence, version 1.2", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Licensed under the ISC License", "Subject to the terms of the Common Development and Distribution License", "Licensed under the Python Software Foundation License Version 2", "This software is provided 'as-is', without any express or implied warranty", "Licensed under the Open Font License, Version 1.1", "Licensed under the Microsoft Public License",
]
#: Ordinary sentences with words of the templates.
DECOYS = [
    "He needs a driving license to get the job", "The license plate of the car was never found", "Please ask your teacher for permission before you leave", "The company was granted a license to sell alcohol",
    "Her fishing license has expired last year", "Without permission nobody may enter the building", "All rights reserved under the terms of the agreement", "They redistributed the food among the people", "The wealth was redistributed under the new law", "A licensed nurse is on duty at all times",
    "The license fee is due in March", "This offer is subject to the terms of the contract", "The records are in the public domain now", "Licensed premises must close at eleven", "The software is free for a month", "The Apache helicopter landed near the village",
    "A gnu is an antelope of the savanna", "Creative people in the commons met for an attribution of prizes", "Mozilla held a public meeting", "The general public is admitted free of charge", "The conditions are met and the following is permitted", "Er kam mit dem Auto und mit seiner Frau", "Copies of the notice were included in the documentation",
]

_SPLIT = "[^a-z0-9]+"


def tokens_of(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def grams_of(tokens: list[str]) -> set[str]:
    return set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)}


def template_rows() -> list[dict]:
    """A row per template: its family, its distinct words, how many of them a confirmed paragraph has, and the family's names, of which it has one (none: no name is asked for)."""
    words = [(f, sorted(set(tokens_of(t)))) for f, ts in TEMPLATES.items() for t in ts]
    return [{"family": f, "template": w, "need": len(w) if len(w) < MARK_WORDS else ceil(CONFIRM * len(w) - 1e-9), "names": NAMES[f] if set(NAMES[f]) & set(w) else []} for f, w in words]


def gate_words(ordinary: list[str]) -> list[str]:
    """Strings of which every paragraph that a template can confirm holds at least one; rare in the ordinary lines."""
    words = sorted({w for row in template_rows() for w in row["template"]})
    count = {w: sum(w in line for line in ordinary) for w in words}
    rank = sorted(words, key=lambda w: (count[w], -len(w), w))
    place = {w: i for i, w in enumerate(rank)}
    chosen = {w for row in template_rows() for w in sorted(row["template"], key=place.get)[: len(row["template"]) - row["need"] + 1]}
    return sorted(w for w in chosen if not any(x != w and x in w for x in chosen))


class LicenceModel:
    """Sparse multinomial logistic regression with a fitted temperature."""

    def __init__(self, ordinary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        self.gate = gate_words(ordinary)
        filler = [t for line in ordinary[:200] for t in tokens_of(line)] or ["lorem", "ipsum", "dolor"]
        texts, y = [], []
        for c, family in enumerate(TEMPLATES):
            for template in TEMPLATES[family]:
                for i in range(12):
                    words = tokens_of(template)
                    if len(words) >= MARK_WORDS and i:
                        words = [w for w in words if rng.random() > 0.08]
                        if i % 4 == 3 and len(words) > 12:  # a part, as where a text is wrapped
                            start = int(rng.integers(0, len(words) // 4 + 1))
                            words = words[start : start + ceil(0.75 * len(words))]
                    around = [filler[j] for j in rng.integers(0, len(filler), int(rng.integers(0, 12 if i < 9 else 200)) if i else 0)]
                    cut = int(rng.integers(0, len(around) + 1))
                    texts.append(around[:cut] + words + around[cut:])
                    y.append(c)
        for line in [*DECOYS * 8, *OTHERS * 8, *ordinary]:
            texts.append(tokens_of(line))
            y.append(len(self.classes) - 1)
        order = rng.permutation(len(texts))
        held = np.zeros(len(texts), bool)
        held[order[: len(texts) // 5]] = True
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for x in [*(t for f in TEMPLATES.values() for t in f), *DECOYS, *OTHERS] for g in grams_of(tokens_of(x))}))}
        y = np.array(y)
        self.w = self._fit([texts[i] for i in np.flatnonzero(~held)], y[~held])
        z = self._logits([texts[i] for i in np.flatnonzero(held)])
        self.temperature = self._calibrate(z, y[held])
        self.held_out_accuracy = float((z.argmax(1) == y[held]).mean()) if held.any() else 1.0

    def _sparse(self, texts):
        pairs = [(r, self.vocabulary[g]) for r, t in enumerate(texts) for g in grams_of(t) if g in self.vocabulary]
        return np.array(pairs, dtype=np.int64).reshape(-1, 2).T

    def _logits(self, texts) -> np.ndarray:
        row, col = self._sparse(texts)
        z = np.tile(self.w[-1], (len(texts), 1))
        np.add.at(z, row, self.w[col])
        return z

    def _fit(self, texts, y) -> np.ndarray:
        k, v, n = len(self.classes), len(self.vocabulary), len(texts)
        row, col = self._sparse(texts)
        x = np.zeros((n, v + 1), dtype=np.float32)
        x[row, col] = 1
        x[:, v] = 1
        target = np.eye(k, dtype=np.float32)[y]
        w = np.zeros((v + 1, k), dtype=np.float32)
        m, s = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 151):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            g = x.T @ (p / p.sum(1, keepdims=True) - target) / n + 1e-4 * w
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w[np.abs(w) < 0.02] = 0  # sparse
        return w.astype(float)

    @staticmethod
    def _calibrate(z: np.ndarray, y: np.ndarray) -> float:
        def loss(t):
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean()) if len(y) else 0.0

        return float(min(np.geomspace(0.5, 5, 40), key=loss))

    def rows(self) -> list[dict]:
        """A row per n-gram with a weight: its weight for each class, over the temperature."""
        rows = [{"gram": g, "weights": [round(x, 6) for x in (self.w[i] / self.temperature).tolist()]} for g, i in self.vocabulary.items()]
        return [r for r in rows if any(r["weights"])]

    def intercept(self) -> list[float]:
        return [round(x, 6) for x in (self.w[-1] / self.temperature).tolist()]


def _literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small constant table inside the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _gated(text: Column, gate: list[str]) -> Column:
    out = F.lit(False)
    for word in gate:
        out = out | F.contains(text, F.lit(word))
    return out


def licence_paragraphs(docs: DataFrame, gate: list[str]) -> DataFrame:
    """(doc_id, row_key, paragraph, wrapped, line): each line with a word of the gate, alone and (wrapped) with its neighbours, from whole texts."""
    text = F.col("text").cast("string")
    # a generated column: else the optimiser would lower the text once for every word of the gate
    gated = docs.select("doc_id", F.xxhash64(text).alias("row_key"), F.explode(F.array(F.lower(text))).alias("low")).where(_gated(F.col("low"), gate))
    split = gated.select("doc_id", "row_key", F.split("low", "\n").alias("lines")).dropDuplicates(["doc_id", "row_key"])
    placed = F.transform("lines", lambda x, i: F.struct(i.alias("paragraph"), x.alias("line"), F.concat_ws(" ", F.get("lines", i - 1), x, F.get("lines", i + 1)).alias("around")))
    hits = split.select("doc_id", "row_key", F.explode(F.filter(placed, lambda p: _gated(p["line"], gate))).alias("p")).select("doc_id", "row_key", "p.*")
    either = F.array(F.struct(F.lit(False).alias("wrapped"), F.col("line")), F.struct(F.lit(True).alias("wrapped"), F.col("around").alias("line")))
    return hits.select("doc_id", "row_key", "paragraph", F.explode(either).alias("e")).select("doc_id", "row_key", "paragraph", "e.*")


def fit_licences(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_ordinary: int = MAX_ORDINARY) -> LicenceModel:
    """Fitted on the templates and at most ``max_ordinary`` whole lines of MAX_LINE characters or fewer, without any mark's words, of at most ``max_documents`` documents. Both are chosen by hashes, so that the same documents give the same model."""
    low = F.lower(F.col("text").cast("string"))
    chosen = docs.where("text is not null").select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), low.alias("low")).orderBy("h", F.xxhash64("low")).limit(max_documents)
    lines = chosen.select(F.explode(F.split("low", "\n")).alias("line")).where(F.col("line").rlike("[a-z0-9]") & (F.length("line") <= MAX_LINE))
    for word in ["licen", "copyright"]:
        lines = lines.where(~F.contains("line", F.lit(word)))
    return LicenceModel(sorted(r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(max_ordinary).collect()))


def licence_scan(spark: SparkSession, docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """A row per licence paragraph of ``docs`` (doc_id, text): doc_id, paragraph (line number from 0), family, probability, p_unknown, similarity.

    ``family`` is the most probable class other than unknown; rows whose most
    probable class is unknown, or that no template of the family confirms, are
    left out. A notice that only a line with its neighbours shows is given at the
    first such line. Null and empty texts have no paragraphs; rows equal in id
    (null ids are equal) and text count once; other columns are ignored; an empty table gives an
    empty result.
    """
    model = model or fit_licences(docs)
    k = len(model.classes)
    table = F.broadcast(_literal_table(spark, model.rows(), "gram string, weights array<double>"))  # as large as the templates
    key = ["doc_id", "row_key", "paragraph", "wrapped"]
    lines = licence_paragraphs(docs, model.gate)
    words = F.filter(F.split("line", _SPLIT), lambda w: w != "")
    # generated, too: else the words would be split again for every pair of them
    lines = lines.select(*key, F.explode(F.array(words)).alias("words")).where(F.size("words") > 0)
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    lines = lines.select(*key, F.array_distinct("words").alias("distinct"), F.array_distinct(F.concat("words", pairs)).alias("grams"))
    grams = lines.select(*key, F.col("distinct").alias("words"), F.explode("grams").alias("gram"))
    hits = grams.join(table, "gram").groupBy(*key).agg(F.first("words").alias("words"), *[F.sum(F.get("weights", F.lit(i))).alias(f"z{i}") for i in range(k)])
    z = F.array(*[F.round(F.col(f"z{i}") + b, 9) for i, b in enumerate(model.intercept())])
    scored = hits.select(*key, "words", z.alias("z")).withColumn("top", F.array_max("z"))
    norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.withColumn("class", F.array_position("z", F.col("top")) - 1).withColumn("probability", 1 / norm).withColumn("p_unknown", F.exp(F.get("z", F.lit(k - 1)) - F.col("top")) / norm).where(F.col("class") < k - 1)
    family = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("class").cast("int"))
    scored = scored.withColumn("family", family)
    templates = F.broadcast(_literal_table(spark, template_rows(), "family string, template array<string>, need int, names array<string>"))
    common = F.size(F.array_intersect("words", "template"))
    compared = scored.join(templates, "family").where((common >= F.col("need")) & ((F.size("names") == 0) | F.arrays_overlap("words", "names"))).groupBy(*key, "family", "probability", "p_unknown").agg(F.max(common / F.size("template")).alias("similarity"))
    # a line alone before the same line with its neighbours; a wrapped notice once
    best = compared.groupBy("doc_id", "row_key", "paragraph").agg(F.min(F.struct("wrapped", "family", "probability", "p_unknown", "similarity")).alias("b")).select("doc_id", "row_key", "paragraph", "b.*")
    near = Window.partitionBy("doc_id", "row_key").orderBy("paragraph")
    beside = (F.lag("paragraph").over(near) >= F.col("paragraph") - 1) | ((F.lead("paragraph").over(near) <= F.col("paragraph") + 1) & ~F.lead("wrapped").over(near))
    best = best.where("paragraph is not null").withColumn("beside", F.coalesce(beside, F.lit(False))).where(~(F.col("wrapped") & F.col("beside")))
    return best.select("doc_id", "paragraph", "family", *[F.round(c, 6).alias(c) for c in ("probability", "p_unknown", "similarity")])
