"""Licence scans: a trained paragraph classifier with template comparison (operator 5).

Paragraphs are the lines of a text that hold a word. A sparse multinomial logistic regression over word 1- to 3-grams
knows one class per licence family and ``unknown``. It learns from the families' templates, their varied forms, the
families' look-alikes, and a bounded sample of corpus lines (``SAMPLE`` documents, picked by a hash of the id). A held-out
part calibrates it (temperature), and a paragraph is a candidate of a family whose calibrated probability reaches
``CONFIDENCE``. A candidate counts once a template of the family confirms it: at least ``CONFIRM`` of the template's
2-grams stand in the paragraph. A notice that is wrapped over adjoining lines is found on these lines joined: a stretch of
lines, each with a 2-gram of one template, that has enough of them together is judged like a paragraph, unless it meets a
line or stretch where its family is already found. A text's families are those of its confirmed paragraphs and stretches.

Rows: null and empty texts have no paragraphs; every row gives one row, repeated rows and null ids included; further
columns are not read; an empty table gives no rows, and the classifier then learns without corpus lines.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import batched, sampled

SAMPLE = 5_000
REPEATS = 100  # how often one line counts among them
CONFIDENCE = 0.5
CONFIRM = 0.7
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# fixed values: notices by which licences are declared
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "This project is licensed under the terms of the Apache 2.0 license",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Released under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL version 2 or later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license",
        "MIT License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "Proprietary": [
        "All rights reserved",
        "No part of this publication may be reproduced without written permission",
        "All rights reserved. No part of this publication may be reproduced without written permission",
        "This software is proprietary and confidential; unauthorized copying is prohibited",
    ],
}
# fixed values: lines with the same words that declare no licence
LOOK_ALIKES = [
    "The driver's license was renewed at the office in May", "Her licence to practise medicine expired", "He works at MIT in Boston",
    "The apache helicopter landed near the village", "The general public was not admitted", "Permission to land was granted by the tower",
    "They released the new version of the game", "Under the terms of the contract the work is finished", "A license plate was found on the road",
    "The foundation published the work free of charge", "Copying the homework is prohibited", "The source of the river is in the north",
    "This work is done", "This project is a success", "The common attribution of the poem is wrong", "International version of the work",
]


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def grams_of(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


@dataclass(frozen=True)
class Classifier:
    """Sparse weights per n-gram; ``families`` ends with the unknown class."""

    families: list[str]
    bias: np.ndarray
    weights: dict[str, np.ndarray]
    temperature: float
    templates: dict[str, list[frozenset]]

    def __post_init__(self) -> None:
        object.__setattr__(self, "vocabulary", frozenset(w for g in self.weights for w in g.split(" ")))
        forms = [(f, t) for f, ts in self.templates.items() for t in ts]
        holders: dict[tuple, list[int]] = {}
        for k, (_, t) in enumerate(forms):
            for pair in t:
                holders.setdefault(pair, []).append(k)
        object.__setattr__(self, "forms", forms)
        object.__setattr__(self, "holders", holders)

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self.bias.copy()
        for gram in set(grams_of(words)):
            w = self.weights.get(gram)
            if w is not None:
                z += w
        z = np.exp((z - z.max()) / self.temperature)
        return z / z.sum()

    def family(self, line: str) -> tuple[str, float] | None:
        """The confirmed family of a paragraph with its probability."""
        return self.judged(words_of(line))

    def judged(self, words: list[str]) -> tuple[str, float] | None:
        if self.vocabulary.isdisjoint(words):  # no weight applies: the class is unknown by the bias alone
            return None
        p = self.probabilities(words)
        k = int(p.argmax())
        if self.families[k] == UNKNOWN or p[k] < CONFIDENCE:
            return None
        pairs = frozenset(zip(words, words[1:]))
        if max(len(pairs & t) / len(t) for t in self.templates[self.families[k]]) < CONFIRM:
            return None
        return self.families[k], float(p[k])

    def notices(self, lines: list[str]) -> list[tuple[str, float]]:
        """What is found in a text: in its lines, and in adjoining lines joined."""
        found: list[tuple[str, float]] = []
        block: list[list[str]] = []
        own: list[tuple[str, float] | None] = []
        for line in [*lines, ""]:
            if line.strip():
                block.append(words_of(line))
                own.append(self.judged(block[-1]))
            elif block:
                found += [x for x in own if x is not None] + self._wrapped(block, own)
                block, own = [], []
        return found

    def _wrapped(self, block: list[list[str]], own: list[tuple[str, float] | None]) -> list[tuple[str, float]]:
        words = [w for ws in block for w in ws]
        pairs = list(zip(words, words[1:]))
        if len(block) < 2 or self.holders.keys().isdisjoint(pairs):
            return []
        at = [k for k, ws in enumerate(block) for _ in ws]
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for k in self.holders.get(pair, ()):
                places.setdefault(k, []).append(i)
        spans = {(b - a, a, b, self.forms[k][0]) for k, hits in places.items() for a, b in self._stretches(self.forms[k][1], hits, pairs, at)}
        taken: dict[str, set[int]] = {}
        for k, x in enumerate(own):
            if x is not None:
                taken.setdefault(x[0], set()).add(k)
        found = []
        for _, a, b, family in sorted(spans):
            mine = taken.setdefault(family, set())
            if mine.isdisjoint(range(a, b + 1)):
                x = self.judged([w for ws in block[a : b + 1] for w in ws])
                if x is not None and x[0] == family:
                    mine.update(range(a, b + 1))
                    found.append(x)
        return found

    @staticmethod
    def _stretches(template: frozenset, hits: list[int], pairs: list[tuple], at: list[int]) -> Iterator[tuple[int, int]]:
        """(first line, last line) of the least stretches of at least two lines that confirm, and of all their lines."""
        need = math.ceil(CONFIRM * len(template) - 1e-9)
        if len({pairs[i] for i in hits}) < need:
            return
        cuts = [0, *(k for k in range(1, len(hits)) if at[hits[k]] - at[hits[k - 1] + 1] > 1), len(hits)]
        for start, end in zip(cuts, cuts[1:]):
            seen: dict[tuple, int] = {}
            low, enough = start, False
            for k in range(start, end):
                seen[pairs[hits[k]]] = seen.get(pairs[hits[k]], 0) + 1
                while len(seen) >= need:
                    a, b, enough = at[hits[low]], at[hits[k] + 1], True
                    if a < b:
                        yield a, b
                    gone = pairs[hits[low]]
                    seen[gone] -= 1
                    if not seen[gone]:
                        del seen[gone]
                    low += 1
            if enough and at[hits[start]] < at[hits[end - 1] + 1]:
                yield at[hits[start]], at[hits[end - 1] + 1]


def _varied(line: str, filler: list[str], rng: random.Random) -> str:
    """A form of a template as found in texts: words lost, words around it, other case."""
    words = line.split()
    if len(words) > 4 and rng.random() < 0.5:
        del words[rng.randrange(len(words))]
    around = [" ".join(rng.choices(filler, k=rng.randrange(0, 8))) for _ in range(2)]
    out = " ".join([around[0], *words, around[1]]).strip()
    return out.upper() if rng.random() < 0.1 else out


def fit(corpus_lines: list[str], templates: dict[str, list[str]] = TEMPLATES, seed: int = 5, penalty: float = 2e-4, steps: int = 300) -> Classifier:
    """Weights by proximal gradient with an L1 penalty; temperature by the held-out fifth."""
    rng = random.Random(seed)
    families = [*sorted(templates), UNKNOWN]
    pairs = {f: [frozenset(zip(words_of(t), words_of(t)[1:])) for t in ts] for f, ts in templates.items()}
    plain = [x for x in corpus_lines if not any(len(frozenset(zip(words_of(x), words_of(x)[1:])) & t) > len(t) / 2 for ts in pairs.values() for t in ts)]
    filler = [w for x in plain[:500] + LOOK_ALIKES for w in x.split()] or ["text"]
    rows = [(line, families.index(f)) for f, ts in sorted(templates.items()) for t in ts for line in [t] * 4 + [_varied(t, filler, rng) for _ in range(36)]]
    rows += [(x, len(families) - 1) for x in plain] + [(y, len(families) - 1) for x in LOOK_ALIKES for y in [x] * 3 + [_varied(x, filler, rng) for _ in range(9)]]
    own = sorted({g for ts in templates.values() for t in ts for g in grams_of(words_of(t))} | {g for x in LOOK_ALIKES for g in grams_of(words_of(x))})
    place = {g: k for k, g in enumerate(own)}
    x = np.zeros((len(rows), len(own)), dtype=np.float32)
    for i, (line, _) in enumerate(rows):
        x[i, [place[g] for g in set(grams_of(words_of(line))) if g in place]] = 1
    label = np.array([k for _, k in rows])
    y = np.eye(len(families), dtype=np.float32)[label]
    held = np.array([zlib.crc32(f"{i}".encode()) % 5 == 0 for i in range(len(rows))])
    xt, yt, n = x[~held], y[~held], int((~held).sum())
    step = 2.0 / (np.linalg.norm(xt, 2) ** 2 / n + 1)
    bias = np.log(yt.mean(axis=0) + 1e-3)
    w, v, t = np.zeros((len(own), len(families))), np.zeros((len(own), len(families))), 1.0
    for _ in range(steps):
        r = (_softmax(xt @ v + bias) - yt) / n
        bias = bias - step * r.sum(axis=0)
        new = v - step * (xt.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    z = x[held] @ w + bias
    losses = [(-np.log(_softmax(z / s)[np.arange(len(z)), label[held]] + 1e-12).mean(), s) for s in np.geomspace(0.1, 4, 30)]
    return Classifier(families, bias, {g: w[k] for g, k in place.items() if np.abs(w[k]).max() > 1e-4}, float(min(losses)[1]), pairs)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample_lines(documents: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Up to two lines of at most 60 words from each of about ``sample`` documents, in a fixed order."""
    share = min(1.0, sample / max(1, documents.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                lines = [x for x in (text or "").split("\n") if 0 < len(x.split()) <= 60]
                out += sorted(lines, key=lambda x: zlib.crc32(x.encode()))[:2]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    # by id and text, so that an id (or null) on many texts is thinned like all others; equal lines come as one row
    own = documents.filter(sampled(share, "doc_id", "text")).select("text")
    lines = own.mapInArrow(pick, "line string").groupBy("line").agg(F.count("*").alias("n")).toPandas()
    return sorted(line for line, n in zip(lines["line"], lines["n"]) for _ in range(min(int(n), REPEATS)))


def licence_families(documents: DataFrame, templates: dict[str, list[str]] = TEMPLATES, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, families, confidence): families sorted, comma-joined; the least probability."""
    model = documents.sparkSession.sparkContext.broadcast(fit(sample_lines(documents, sample), templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for value in batch.column(1):
                lines = [x for x in (value.as_py() or "").split("\n") if x.strip()]
                found = own.notices((value.as_py() or "").split("\n"))
                for col, x in zip(out, (len(lines), len(found), ",".join(sorted({f for f, _ in found})), min((p for _, p in found), default=None))):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_paragraphs", "n_licences", "families", "confidence"])

    return batched(documents).select("doc_id", "text").mapInArrow(scan, "doc_id long, n_paragraphs long, n_licences long, families string, confidence double")
