"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph is a stretch of lines without a blank one, so that hard-wrapped notices are read whole.
It is looked at in windows of WINDOW words that overlap by half. Each window is a sparse bag of its
words and word pairs, where words after a denial count as other words; a logistic regression for each licence family tells the chance that the
window grants it, so a paragraph can name several. The regressions are trained here on the
templates below and on variants of them (words lost, replaced, or written around them) against
sentences that share words with licences, notices of other licences (OTHER_LICENCES) and denials
("not licensed under"). Their chances are calibrated on held-out variants, in which the unknown
class holds licences that training has not seen (UNSEEN). A family is reported where its calibrated
chance is at least SURE and, after that, one of its templates confirms it: the window holds at
least MATCHED of the template's words and pairs, those that many families share counting less.

Paragraphs whose words can't reach SURE by the sum of their positive weights are passed over. Null
and empty texts have no paragraphs; repeated rows are scanned each; texts and paragraphs of any
length are read whole.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced, whole_text
from ligature.llm.decontaminate import words
from ligature.llm.toxicity import logistic

#: Licence families and usual notices of each.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3", "GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["licensed under the BSD 3-Clause License", "BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["released under CC0 1.0 Universal", "dedicated to the public domain under the Creative Commons CC0 waiver", "SPDX-License-Identifier: CC0-1.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-2.0"],
    "ISC": ["licensed under the ISC License", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 3", "GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "MPL": ["licensed under the Mozilla Public License 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["Copyright. All rights reserved", "This material is confidential and proprietary and may not be reproduced without permission"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
#: Sentences without a licence that use words of licences.
OTHERS = "the public was released from the work under the version of the plan|he was licensed to drive in the city|a license is needed to fish here|the general public may use the park without fee|all rights of the person were reserved by the court|the apache helicopter landed|she studies at MIT in the department of software|the foundation published a free copy of the source|the terms of the version were met|permission to copy the files was granted|creative people work in common rooms|the domain of the function is public|software of any purpose is distributed at no charge|the clause was modified and may be used in any form|Mozilla wrote a browser|version 3 of the software was published|the commons was international|attribution of the work to the person is hereby in question|universal waiver of the fee".split("|")
#: Notices of licences of no family above; those of UNSEEN only calibrate.
OTHER_LICENCES = ["licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v 2.0", "licensed under the zlib License", "Common Development and Distribution License Version 1.0", "Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "released under the Do What The Fuck You Want To Public License"]
UNSEEN = ["licensed under the European Union Public Licence 1.2", "licensed under the Artistic License 2.0", "SPDX-License-Identifier: OFL-1.1", "licensed under the SIL Open Font License, Version 1.1", "licensed under the Python Software Foundation License Version 2"]
DENIALS = "not|never|no longer|not been|neither".split("|")
SURE, MATCHED = 0.5, 0.65
WINDOW, ROWS = 64, 6000


#: Words that deny what the next SCOPE words say.
_DENIED, SCOPE = frozenset(x.encode() for x in ("not", "never", "longer", "neither", "nor")), 7


def marked(found: list[bytes]) -> list[bytes]:
    """Words, those in the scope of a denial marked as other words."""
    out, left = [], 0
    for w in found:
        if w in _DENIED:
            left = SCOPE
            out.append(w)
        elif left:
            left -= 1
            out.append(b"!" + w)
        else:
            out.append(w)
    return out


def read_words(text: str) -> list[bytes]:
    found = words(text)
    return found if _DENIED.isdisjoint(found) else marked(found)


def grams(found: list[bytes]) -> list[bytes]:
    return [*found, *(a + b" " + b for a, b in zip(found, found[1:], strict=False))]


def variants(n: int, seed: int, others: list[str] | None = None) -> Iterator[tuple[str, frozenset[str]]]:
    """(text, its families) for training: one or two templates and other sentences, changed at random."""
    r = random.Random(seed)
    invented = lambda: "".join(r.choice("aeinrstohld") for _ in range(r.randint(2, 8)))
    families = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    bits = sorted({w for _, t in families for w in t.split() if w.isalpha()})
    granted = [(f, t) for f, t in families if t.lower().startswith(("licensed", "released", "this work is licensed"))]
    around = lambda: [invented() for _ in range(r.choice((0, 0, 0, 1, 4, 20)))]

    def part() -> tuple[list[str], str]:
        kind = r.random()
        family, text = r.choice(families)
        if kind < 0.55:
            # a short notice that loses a word may be another's
            w = text.split()
            return [x for x in w if len(w) <= 9 or r.random() > 0.03], family
        if kind < 0.72:
            w = r.choice(granted)[1].split()
            at = next(i for i, x in enumerate(w) if x.lower() in ("licensed", "released"))
            return [*w[:at], r.choice(DENIALS), *w[at:]], ""
        if kind < 0.85:
            return r.choice(others or OTHER_LICENCES).split(), ""
        w = r.choice(OTHERS).split() if r.random() < 0.5 else [r.choice(bits) if r.random() < 0.3 else invented() for _ in range(r.randint(3, 25))]
        r.random() < 0.3 and r.shuffle(w)
        return w, ""

    for _ in range(n):
        parts = [part() for _ in range(1 if r.random() < 0.8 else 2)]
        out = around()
        for w, _ in parts:
            out += [*w, *around()]
        yield " ".join(out), frozenset(f for _, f in parts if f)


class Classifier:
    def __init__(self, families: list[str], vocabulary: dict[bytes, int]):
        self.families, self.vocabulary = families, vocabulary
        self.weights, self.bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
        #: Calibration of the log-odds: scale and shift.
        self.scale, self.shift = 1.0, 0.0
        held = [[frozenset(grams(read_words(t))) for t in TEMPLATES[f]] for f in families]
        shared = Counter(g for ts in held for g in frozenset().union(*ts))
        self.templates = [[{g: 1.0 / shared[g] ** 2 for g in t} for t in ts] for ts in held]

    def places(self, found: list[bytes]) -> tuple[list[int], list[int]]:
        """Known words and pairs of known words, and where they begin."""
        look, at, ids, before = self.vocabulary.get, [], [], None
        for i, w in enumerate(found):
            if (k := look(w)) is None:
                before = None
                continue
            if before is not None and (pair := look(before + b" " + w)) is not None:
                at.append(i - 1)
                ids.append(pair)
            at.append(i)
            ids.append(k)
            before = w
        return at, ids

    def chances(self, ids: np.ndarray) -> np.ndarray:
        x = self.scale * (self.weights[ids].sum(0) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def confirmed(self, family: int, held: set[bytes]) -> bool:
        return any(sum(v for g, v in t.items() if g in held) >= MATCHED * sum(t.values()) for t in self.templates[family])

    def of_paragraph(self, found: list[bytes]) -> dict[str, float]:
        """Families of a paragraph's words with their highest chance."""
        at, ids = self.places(found)
        least = (np.log(SURE / (1 - SURE)) - self.shift) / self.scale
        if not ids or (np.maximum(self.weights[np.unique(ids)], 0).sum(0) + self.bias < least).all():
            return {}
        out: dict[str, float] = {}
        starts, ids = np.array(at), np.array(ids)
        order = np.argsort(starts, kind="stable")
        starts, ids = starts[order], ids[order]
        for a in range(0, max(1, len(found) - WINDOW // 2), WINDOW // 2):
            inside = ids[np.searchsorted(starts, a) : np.searchsorted(starts, a + WINDOW)]
            if not len(inside):
                continue
            p = self.chances(np.unique(inside))
            if (p >= SURE).any():
                held = set(grams(found[a : a + WINDOW]))
                for k in np.flatnonzero(p >= SURE).tolist():
                    if p[k] > out.get(self.families[k], 0.0) and self.confirmed(k, held):
                        out[self.families[k]] = float(p[k])
        return out

    def families_in(self, text: str) -> list[tuple[int, str, float]]:
        """(paragraph, family, chance) of the confirmed families of a text's paragraphs."""
        return [(i, f, p) for i, part in enumerate(paragraphs(text)) for f, p in sorted(self.of_paragraph(read_words(part)).items())]


_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")


def paragraphs(text: str) -> list[str]:
    return [x for x in _BLANK.split(text) if x.strip()]


@lru_cache(1)
def trained(n: int = ROWS, rounds: int = 300) -> Classifier:
    families, rows = sorted(TEMPLATES), list(variants(n, 1))
    counts = Counter(g for text, _ in rows for g in set(grams(read_words(text))))
    often = {g for g, c in counts.items() if c >= 10}
    vocabulary = {g: i for i, g in enumerate(sorted(g for g in often if all(w in often for w in g.split())))}
    model = Classifier(families, vocabulary)

    def matrix(rows: list[tuple[str, frozenset[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (text, _) in enumerate(rows):
            x[i, model.places(read_words(text))[1]] = 1
        return x, np.array([[f in held for f in families] for _, held in rows], np.float32)

    x, y = matrix(rows)
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.full(len(families), -3, np.float32)
    # gradient descent with momentum
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(x)
        vw = np.float32(0.9) * vw - np.float32(2.0) * (x.T @ g + np.float32(1e-5) * w)
        vb = np.float32(0.9) * vb - np.float32(2.0) * g.sum(0)
        w, b = w + vw, b + vb
    model.weights, model.bias = w.astype(float), b.astype(float)
    x, y = matrix(list(variants(n // 3, 2, [*OTHER_LICENCES, *UNSEEN])))
    model.scale, model.shift = logistic((x @ w + b).reshape(-1, 1).astype(float), y.reshape(-1).astype(float))
    return model


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, found (paragraph, family, probability)."""
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]))

    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            found = [[{"paragraph": i, "family": f, "probability": p} for i, f, p in model.families_in(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(paragraphs(t)) for t in texts], pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long"), whole_text()).mapInArrow(scan, "doc_id long, n_paragraphs long, found array<struct<paragraph: long, family: string, probability: double>>")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x.family))), ",").alias("families"))
