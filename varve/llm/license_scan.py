"""Licence notices, wherever they stand in a paragraph: a word n-gram logistic regression, confirmed against templates.

A paragraph is a run of lines between lines without a word; a line end inside it is white space, as notices are mostly wrapped.
Judged are its lines, its best stretches of a template's length and the paragraph itself.

The classifier is fitted on the driver from the templates below and a bounded sample of the corpus's own paragraphs as the unknown
class; a temperature fitted on held-out paragraphs calibrates it. It is applied to every stretch that has enough of a
template's word triples, as no other could be confirmed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.llm.words import ALPHANUMERIC, chain, slices, split_words, text_buffer

UNKNOWN = "unknown"

# Public licence notices, as authors write them into their files, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 3 or later.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

GRAMS = 3


def grams(words: np.ndarray, order: int) -> np.ndarray:
    return chain(words[i : len(words) - order + 1 + i] for i in range(order)) + np.uint64(order) if len(words) >= order else words[:0]


def _features(words: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([grams(words, n) for n in range(1, GRAMS + 1)]))


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = split_words(pa.array(texts, pa.string()), ALPHANUMERIC, fold=True)
    return [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


@dataclass
class LicenceModel:
    families: list[str]  # the unknown class first
    vocabulary: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # n-gram x family
    bias: np.ndarray
    temperature: float
    triples: np.ndarray  # sorted word triples of all templates
    templates: list[tuple[str, np.ndarray]]
    lengths: list[int]  # words of each template

    def member(self) -> np.ndarray:
        """template x triple: whether the template has it."""
        return np.stack([np.isin(self.triples, t, assume_unique=True) for _, t in self.templates])

    def vector(self, words: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.vocabulary, _features(words), assume_unique=True))

    def probabilities(self, vectors: list[np.ndarray]) -> np.ndarray:
        z = np.stack([self.weights[v].sum(axis=0) / np.sqrt(max(1, len(v))) for v in vectors]) + self.bias
        return _softmax(z / self.temperature)

    def similarity(self, words: np.ndarray, family: str) -> float:
        """Share of the word triples of the family's nearest template that the paragraph has."""
        own = np.unique(grams(words, GRAMS))
        return max(float(np.isin(t, own, assume_unique=True).mean()) for f, t in self.templates if f == family)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _near(words: np.ndarray, triples: np.ndarray, templates: list[tuple[str, np.ndarray]]) -> bool:
    g = grams(words, GRAMS)
    return bool(len(g)) and bool(np.isin(triples, g).any()) and max(np.isin(t, g).mean() for _, t in templates) >= 0.3


def _templates() -> tuple[list[tuple[str, np.ndarray]], list[int]]:
    words = [(f, w) for f, texts in TEMPLATES.items() for w in _hashes(list(texts))]
    return [(f, np.unique(grams(w, GRAMS))) for f, w in words], [len(w) for _, w in words]


def train_licences(plain: list[str], seed: int = 11, copies: int = 12, steps: int = 400, penalty: float = 1e-3) -> LicenceModel:
    """`plain`: paragraphs of the corpus for the unknown class (those that hold a template's triples for the most part are left out)."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    templates, lengths = _templates()
    triples = np.unique(np.concatenate([t for _, t in templates]))
    ordinary = [w for w in _hashes(plain) if len(w) and not _near(w, triples, templates)]
    filler = np.concatenate(ordinary) if ordinary else np.zeros(1, np.uint64)
    samples: list[tuple[int, np.ndarray]] = [(0, w) for w in ordinary]
    for f, texts in TEMPLATES.items():
        for words in _hashes(list(texts)):
            samples.append((families.index(f), words))
            for _ in range(copies):
                kept = words[rng.random(len(words)) > 0.08]
                at = rng.integers(0, len(filler))
                samples.append((families.index(f), np.concatenate([filler[at : at + rng.integers(0, 6)], kept, filler[at : at + rng.integers(0, 12)]])))
                # The same words without their order belong to no licence.
                samples.append((0, rng.permutation(words)))
    vocabulary = np.unique(np.concatenate([_features(w) for f, t in TEMPLATES.items() for w in _hashes(list(t))]))
    model = LicenceModel(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), 1.0, triples, templates, lengths)
    x = np.zeros((len(samples), len(vocabulary)), np.float32)
    for i, (_, w) in enumerate(samples):
        v = model.vector(w)
        x[i, v] = 1 / np.sqrt(max(1, len(v)))
    y = np.eye(len(families))[[c for c, _ in samples]]
    held = np.arange(len(samples)) % 4 == 3
    train, wanted = x[~held], y[~held]
    balance = (1 / np.maximum(y[~held].sum(axis=0), 1))[y[~held].argmax(axis=1)]
    balance /= balance.sum()
    moved, moved_bias = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(steps):
        gap = (_softmax(train @ model.weights.astype(np.float32) + model.bias) - wanted) * balance[:, None]
        moved = 0.9 * moved + train.T @ gap.astype(np.float32) + penalty * model.weights
        moved_bias = 0.9 * moved_bias + gap.sum(axis=0)
        model.weights -= 2.0 * moved
        model.bias -= 2.0 * moved_bias
    z = x[held] @ model.weights + model.bias
    loss = [(-np.log(np.maximum((_softmax(z / t) * y[held]).sum(axis=1), 1e-12)).mean(), t) for t in np.geomspace(0.1, 5, 30)]
    model.temperature = float(min(loss)[1])
    return model


def fit_licences(docs: DataFrame, fit_rows: int = 500, paragraphs: int = 3000) -> LicenceModel:
    """Trains on the templates and up to `paragraphs` paragraphs of about `fit_rows` documents, chosen by a hash of their text."""
    texts = columns_or_null(docs, text="string").where("text is not null")
    share = min(1.0, fit_rows / max(1, texts.count()))
    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else texts
    lines = rows.select(F.split("text", "\n").alias("all")).select("all", F.posexplode("all").alias("i", "p")).where("length(p) between 1 and 4000")
    beside = lambda i: F.coalesce(F.get("all", F.col("i") + i), F.lit(""))
    around = F.concat_ws("\n", F.substring(beside(-1), -1000, 1000), "p", F.substring(beside(1), 1, 1000))
    # Lines of a wrapped notice are no examples of the unknown class, however little of the template each has.
    chosen = lines.groupBy("p").agg(F.max(around).alias("around")).orderBy(F.xxhash64("p"), "p").limit(paragraphs)
    templates, _ = _templates()
    triples = np.unique(np.concatenate([t for _, t in templates]))
    rows = sorted((r["p"], r["around"]) for r in chosen.collect())
    pairs = zip(_hashes([p for p, _ in rows]), _hashes([a for _, a in rows]))
    part = [bool(np.isin(grams(w, GRAMS), triples).any()) and _near(a, triples, templates) for w, a in pairs]
    return train_licences([p for (p, _), notice in zip(rows, part) if not notice])


def _stretches(place: np.ndarray, triple: np.ndarray, member: np.ndarray, lengths: list[int], least: float) -> list[tuple[int, int]]:
    """(first word, behind the last word) of stretches that have `least` of a template's triples within its length and a quarter more.

    `place`, `triple`: where the paragraph has template triples, and which. Per template the best stretches that do not overlap."""
    out = []
    for own, length in zip(member, lengths):
        at = np.flatnonzero(own[triple])
        needed = max(1, np.ceil(least * own.sum() - 1e-9))
        if len(at) < needed:
            continue
        where, which, limit = place[at].tolist(), triple[at].tolist(), length + max(2, length // 4)
        inside: dict[int, int] = {}
        left, full = 0, []
        for right, (w, k) in enumerate(zip(where, which)):
            inside[k] = inside.get(k, 0) + 1
            # Triples behind the window's end go, and at its start those that it has again.
            while w + GRAMS - where[left] > limit or inside[which[left]] > 1 and left < right:
                gone = which[left]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if len(inside) >= needed:
                full.append((-len(inside), where[left], w + GRAMS))
        taken: list[tuple[int, int]] = []
        for _, x, y in sorted(full):
            k = bisect.bisect(taken, (x, y))
            if (k == 0 or taken[k - 1][1] <= x) and (k == len(taken) or taken[k][0] >= y):
                taken.insert(k, (x, y))
        out += taken
    return out


def _scanner(shared, least_score: float, least_similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LicenceModel = shared.value
        member = model.member()
        sizes = member.sum(axis=1)

        def enough(kinds: np.ndarray) -> bool:
            return bool((member[:, np.unique(kinds)].sum(axis=1) >= least_similarity * sizes - 1e-9).any())

        def judged(model: LicenceModel, words: np.ndarray, spans: list[tuple[int, int, int]]) -> Iterator[tuple]:
            """(paragraph, first word, behind the last word, family, score, similarity) of the spans that hold a notice."""
            for at in range(0, len(spans), 4096):
                piece = spans[at : at + 4096]
                for (p, x, y), chance in zip(piece, model.probabilities([model.vector(words[x:y]) for _, x, y in piece])):
                    best = int(chance.argmax())
                    if best and chance[best] >= least_score:
                        alike = model.similarity(words[x:y], model.families[best])
                        if alike >= least_similarity:
                            yield p, x, y, model.families[best], float(chance[best]), alike

        for part in slices(batches):
            words = split_words(part.column("text"), ALPHANUMERIC, fold=True)
            offsets = text_buffer(part.column("text"))[1]
            breaks = np.flatnonzero(words.data[offsets[0] : offsets[-1]] == 0x0A) + offsets[0]
            line = np.searchsorted(breaks, words.start)
            row = np.repeat(np.arange(part.num_rows), words.counts)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            n = len(words.hash)
            triple = grams(words.hash, GRAMS)
            place = np.minimum(np.searchsorted(model.triples, triple), len(model.triples) - 1)
            hit = np.flatnonzero(model.triples[place] == triple)
            paragraph = np.concatenate([[0], np.cumsum((np.diff(line) > 1) | (np.diff(row) > 0))]) if n else line
            hit = hit[paragraph[hit] == paragraph[hit + GRAMS - 1]] if n >= GRAMS else hit[:0]
            row_line = np.searchsorted(breaks, offsets[:-1])
            spans: list[tuple[int, int, int]] = []  # paragraph, first word, behind the last word
            whole: list[tuple[int, int, int]] = []
            starts = np.flatnonzero(np.diff(paragraph[hit], prepend=-1)) if len(hit) else hit
            for h in np.split(hit, starts[1:]) if len(hit) else []:
                kinds = place[h]
                if not enough(kinds):
                    continue
                p = int(paragraph[h[0]])
                a, b = np.searchsorted(paragraph, (p, p + 1))
                tight = {(int(x), int(y)) for x, y in _stretches(h, kinds, member, model.lengths, least_similarity)}
                single = h[line[h] == line[h + GRAMS - 1]]
                for k in np.split(single, np.flatnonzero(np.diff(line[single])) + 1) if len(single) else []:
                    if enough(place[k]):
                        x, y = a + np.searchsorted(line[a:b], (line[k[0]], line[k[0]] + 1))
                        tight.add((int(x), int(y)))
                spans += [(p, *t) for t in sorted(tight)]
                if (a, b) not in tight:
                    whole.append((p, int(a), int(b)))
            notices: dict[int, list[tuple]] = {}
            # The likest first, each word in one notice; a paragraph as a whole only for a family that no part of it has.
            for p, *notice in sorted(judged(model, words.hash, spans), key=lambda j: (j[0], -j[5], -j[4], j[2] - j[1], j[1])):
                own = notices.setdefault(p, [])
                at = bisect.bisect(own, notice[:2], key=lambda o: o[:2])
                if (at == 0 or own[at - 1][1] <= notice[0]) and (at == len(own) or own[at][0] >= notice[1]):
                    own.insert(at, notice)
            for p, *notice in judged(model, words.hash, whole):
                own = notices.setdefault(p, [])
                if all(o[2] != notice[2] for o in own):
                    own.append(notice)
            for own in notices.values():
                for x, _, family, score, alike in own:
                    r = int(row[x])
                    found[r].append({"paragraph": int(line[x] - row_line[r]), "family": family, "score": score, "similarity": alike})
            for f in found:
                f.sort(key=lambda x: (x["paragraph"], x["family"]))
            families = [",".join(sorted({x["family"] for x in f})) for f in found]
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(families, pa.string()), pa.array(found, kind)], names=["doc_id", "families", "notices"])

    return scan


def scan_licences(docs: DataFrame, model: LicenceModel, least_score: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """(doc_id, families, notices) for each row of `docs(doc_id, text)`.

    `notices` lists the stretches of a paragraph that the classifier gives to a licence family with calibrated
    probability `score` of at least `least_score`, and of which `similarity`, the share of the nearest template's word
    triples, confirms it; `paragraph` is the line on which one begins, counted from 0. Stretches do not overlap, unless a whole
    paragraph is of a family that no part of it has. `families` are the families found, sorted and joined by commas, empty if none. Null and empty
    texts have no notice. Whole texts are read, whatever their length; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, families string, notices array<struct<paragraph: int, family: string, score: double, similarity: double>>"
    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(_scanner(shared, least_score, least_similarity), schema)
