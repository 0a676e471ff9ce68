"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Paragraphs are lines. Features are the word n-grams (one to three words) of the notice templates, less those that are
common in ordinary paragraphs; a softmax regression over them has a class for ordinary text, one for each licence
family and one for unknown licences. Its training set is made from the templates (words dropped, ordinary words put in
and around), from templates whose family words are replaced by invented ones (unknown), and from ordinary paragraphs of a
bounded sample of the corpus (SAMPLE documents drawn by hash), also with stray words of templates put in. A temperature fitted on a held-out part calibrates the
probabilities. A family is given only if its probability reaches LEAST and a template of the family confirms
it: the share of the template's word pairs found in the paragraph reaches CONFIRMED, of all pairs and of those that hold a
word not shared by all notices; otherwise the paragraph is unknown.
Notices that are wrapped over lines are found by joining: neighbouring lines without a blank one between them are classified and
confirmed together where they hold more of a template than each of them, and count as one licence paragraph.

Defined results: null and empty texts have no paragraphs; lines without words are no paragraphs; repeated rows each get their
row, and are drawn once for the sample; very long texts are read whole; of equally probable families the first in order of
name is taken; empty tables give empty tables; extra columns pass, but for those named as the results, which are replaced."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import Words, mixed
from .common import arrow_columns, drawn, give_back

# Customary notices of well-known licences.
TEMPLATES = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL v3 or later."],
    "All rights reserved": ["All rights reserved.", "Copyright by the authors. All rights reserved. No part may be reproduced without permission."],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.",
    ],
    "Artistic": ["Licensed under the Artistic License 2.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ],
    "Boost": ["Distributed under the Boost Software License, Version 1.0."],
    "CC BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal.", "Released into the public domain under CC0."],
    "EPL": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or later."],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v2 or later.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL v3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "MS-PL": ["Licensed under the Microsoft Public License."],
    "ODbL": ["This database is made available under the Open Database License 1.0."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "Zlib": ["Released under the zlib License.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
COMMON_FRAME = set("this work program source code form file software is are licensed released under the a of license licence version v or later terms subject to 1 2 3 4 0 international public general and".split())
CLASSES = ["ordinary", *TEMPLATES, "unknown"]
#: Bounds of the training sample: documents, code points of a document, and ordinary paragraphs, drawn by their hash.
SAMPLE, LONGEST_DRAWN, MOST_PARAGRAPHS = 300, 20_000, 3000
LEAST, CONFIRMED, RESEMBLES = 0.5, 0.6, 0.2
#: Copies of each template that are made for training, and ordinary paragraphs with stray words of templates.
COPIES, STRAYS = 60, 1500


def grams(h: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside a unit (paragraph), and the positions where they begin."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(unit[: len(h) - n + 1] == unit[n - 1 :])
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return mixed(out), at


class Paragraphs:
    """Words of many texts with the paragraph of each: a line of a text."""

    def __init__(self, column: pa.Array):
        w = self.words = Words(column)
        breaks = np.union1d(np.flatnonzero(w.low == 10) + 1, w.off)
        line = np.searchsorted(breaks, w.start, "right")
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        self.unit = np.cumsum(new) - 1
        #: First word of each paragraph, and paragraphs before each text.
        self.first = np.append(np.flatnonzero(new), len(line))
        self.before = np.searchsorted(self.first[:-1], w.first)
        #: Whether a paragraph stands on the line right after the one before, in the same text.
        self.follows = np.zeros(len(self.first) - 1, bool)
        self.follows[1:] = np.diff(line[new]) == 1
        self.follows[self.before[self.before < len(self.follows)]] = False


class Classifier:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.vocabulary, self.weights, self.bias, self.temperature = vocabulary, weights, bias, temperature
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[vocabulary >> np.uint64(44)] = True

    def hits(self, h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, feature) of all n-grams in the vocabulary."""
        rows, cols = [], []
        for n in (1, 2, 3):
            g, at = grams(h, unit, n)
            maybe = np.flatnonzero(self.sieve[g >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.vocabulary, g[maybe]), len(self.vocabulary) - 1)
            sure = self.vocabulary[place] == g[maybe]
            rows.append(unit[at[maybe[sure]]])
            cols.append(place[sure])
        # a feature is there or not, however long the paragraph
        cells = np.unique(np.concatenate(rows) * len(self.vocabulary) + np.concatenate(cols))
        return cells // len(self.vocabulary), cells % len(self.vocabulary)

    def probabilities(self, h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs with any feature and their class probabilities; all others are ordinary by the bias alone."""
        row, col = self.hits(h, unit)
        which, first = np.unique(row, return_index=True)
        s = np.tile(self.bias, (len(which), 1))
        if len(which):
            s += np.add.reduceat(self.weights[col], first)
        s /= self.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return which, p / p.sum(axis=1, keepdims=True)


def _flat(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(pa.array(lines, pa.string()))
    return w.hash, np.repeat(np.arange(len(lines)), np.diff(w.first))


def fit(ordinary: list[str], seed: int = 11, steps: int = 200) -> Classifier:
    rng = np.random.default_rng(seed)
    filler = [w for line in ordinary for w in line.split()][:20_000] or ["lorem", "ipsum"]
    lines, y = list(ordinary), [0] * len(ordinary)
    strays = sorted({w for templates in TEMPLATES.values() for t in templates for w in t.split()})
    for _ in range(STRAYS):  # a word or two of a notice do not make a licence paragraph
        put = [filler[i] for i in rng.integers(0, len(filler), rng.integers(6, 30))]
        for w in rng.choice(strays, rng.integers(1, 3)):
            put.insert(int(rng.integers(0, len(put) + 1)), str(w))
        lines.append(" ".join(put))
        y.append(0)
    for k, (_, templates) in enumerate(TEMPLATES.items(), 1):
        for template in templates:
            for c in range(COPIES):
                words = [w for w in template.split() if c == 0 or rng.random() > 0.06]
                strange = c % 6 == 5
                if strange:
                    words = [w if w.lower().strip(".,;()") in COMMON_FRAME else "".join(rng.choice(list("abdegiklmnoprstuz"), 7)) for w in words]
                extra = rng.integers(0, 12) if c % 2 else 0
                put = [filler[i] for i in rng.integers(0, len(filler), extra)]
                at = int(rng.integers(0, extra + 1))
                lines.append(" ".join([*put[:at], *words, *put[at:]]))
                y.append(len(CLASSES) - 1 if strange else k)
    h, unit = _flat(ordinary)
    common: dict[int, int] = {}
    for n in (1, 2, 3):
        g, at = grams(h, unit, n)
        pairs = np.unique(np.stack([g, unit[at].astype(np.uint64)], axis=1), axis=0)
        for x, count in zip(*np.unique(pairs[:, 0], return_counts=True), strict=True):
            if count > 0.005 * len(ordinary):
                common[int(x)] = int(count)
    th, tu = _flat([t for v in TEMPLATES.values() for t in v])
    vocabulary = np.unique(np.concatenate([grams(th, tu, n)[0] for n in (1, 2, 3)]))
    vocabulary = vocabulary[[int(x) not in common for x in vocabulary]]
    n_class, labels = len(CLASSES), np.array(y)
    model = Classifier(vocabulary, np.zeros((len(vocabulary), n_class)), np.zeros(n_class), 1.0)
    row, col = model.hits(*_flat(lines))
    x_size = len(lines)
    held = rng.random(x_size) < 0.2
    hot = np.eye(n_class)[labels] * ~held[:, None]
    weight = ~held[:, None]
    sw, sb = np.full_like(model.weights, 1e-2), np.full_like(model.bias, 1e-2)

    which, first = np.unique(row, return_index=True)  # rows come in order

    def raw() -> np.ndarray:
        s = np.tile(model.bias, (x_size, 1))
        s[which] += np.add.reduceat(model.weights[col], first)
        return s

    for _ in range(steps):
        s = raw()
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = hot - p / p.sum(axis=1, keepdims=True) * weight
        gw = np.stack([np.bincount(col, g[row, j], len(vocabulary)) for j in range(n_class)], axis=1) - 0.05 * model.weights
        gb = g.sum(axis=0)
        sw += gw**2
        sb += gb**2
        model.weights += 0.3 * gw / np.sqrt(sw)
        model.bias += 0.3 * gb / np.sqrt(sb)
    s, best = raw()[held], (np.inf, 1.0)
    for t in np.geomspace(0.3, 5, 30):
        z = s / t
        loss = float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(z)), labels[held]]).mean())
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    if ordinary and model.bias.argmax() != 0:
        model.bias[0] = model.bias.max() + 1.0  # a paragraph without any feature is ordinary
    elif not ordinary:
        model.bias[0] += 3.0
    return model


def pairs_of(words: list[bytes]) -> set[tuple]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


def telling(pairs: set[tuple]) -> set[tuple]:
    """The word pairs that are not made of the words which all notices share; all, if there are no others."""
    return {p for p in pairs if any(w.decode("utf-8", "replace") not in COMMON_FRAME for w in p)} or pairs


def train(docs: DataFrame) -> Classifier:
    """Fit with ordinary paragraphs of a bounded, hash-drawn sample of docs (doc_id, text)."""
    texts = [r.text for r in drawn(docs.select("doc_id", "text"), SAMPLE).where(F.length("text") <= LONGEST_DRAWN).collect()]
    lines = sorted({line for t in texts for line in t.split("\n") if line.strip()})
    # notices that stand in the sample are not ordinary
    cues = ("licen", "rights reserved", "copyright", "creative commons", "public domain", "redistribut", "permission is ", "permission to ", "warrant")
    lines = sorted((line for line in lines if not any(c in line.lower() for c in cues)), key=lambda line: blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    model = fit(lines[:MOST_PARAGRAPHS])
    give_back()
    return model


def runs(which: np.ndarray, follows: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of two and more neighbouring lines that begin and end with one of which, with at most one other between two of these."""
    out: list[list[int]] = []
    for k in which.tolist():
        if out and k - out[-1][1] < 2 and follows[out[-1][1] : k + 1].all():
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [(i, j) for i, j in out if j - i > 1]


def windows(lines: list[list[bytes]], templates: list[set[tuple]]) -> list[tuple[int, int, int]]:
    """(word pairs, first, last) of two and more neighbouring lines that together confirm a template better than any one of them;
    most pairs first. A window has at most three times as many words as the template has pairs, and 30 more."""
    out = []
    words = [x for line in lines for x in line]
    row = [i for i, line in enumerate(lines) for _ in line]
    pairs = list(zip(words, words[1:], row, row[1:], strict=False))
    for template in templates:
        hits = [((a, b), i, j) for a, b, i, j in pairs if (a, b) in template]
        if len({h[0] for h in hits}) < CONFIRMED * len(template):
            continue
        alone = [len({h[0] for h in hits if h[1] == h[2] == i}) for i in range(len(lines))]
        for first in sorted({h[1] for h in hits}):
            seen: set = set()
            size, last, at, inside = len(lines[first]), first, [h for h in hits if h[1] >= first], 0
            best = (0, first)
            while last + 1 < len(lines) and size + len(lines[last + 1]) <= 3 * len(template) + 30:
                last += 1
                size += len(lines[last])
                while inside < len(at) and at[inside][2] <= last:
                    seen.add(at[inside][0])
                    inside += 1
                best = max(best, (len(seen), last), key=lambda x: (x[0], -x[1]))
            if best[0] >= CONFIRMED * len(template) and best[0] > max(alone[first : best[1] + 1]):
                out.append((best[0], first, best[1]))
    return sorted(out, key=lambda x: (-x[0], x[2] - x[1], x[1]))


_SPAN = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
ADDED = [("n_paragraphs", "bigint"), ("licences", "array<struct<family:string,start:bigint,end:bigint,score:double,overlap:double>>")]


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with paragraphs and licence paragraphs: family or unknown, code points from first to last word, probability, template overlap."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list[pa.Array]:
        clf, p = sent.value, Paragraphs(column)
        w = p.words
        templates = {f: [pairs_of(_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
        names = {f: [telling(t) for t in ts] for f, ts in templates.items()}
        out: list[list] = [[] for _ in range(len(column))]

        def words(i: int, j: int) -> list[bytes]:
            return [w.low[w.start[x] : w.end[x]].tobytes() for x in range(i, j)]

        def judged(q: np.ndarray, i: int, j: int) -> tuple[bool, dict]:
            own = pairs_of(words(i, j))
            best = int(q[1:-1].argmax()) + 1
            family = CLASSES[best]
            overlap, named = max((len(t & own) / len(t), len(n & own) / len(n)) for t, n in zip(templates[family], names[family], strict=True))
            known = bool(q[best] >= LEAST and min(overlap, named) >= CONFIRMED)
            base = w.off[int(np.searchsorted(w.first, i, "right")) - 1]
            start = len(w.low[base : w.start[i]].tobytes().decode("utf-8", "replace"))
            size = len(w.low[w.start[i] : w.end[j - 1]].tobytes().decode("utf-8", "replace"))
            return known, {"family": family if known else "unknown", "start": start, "end": start + size, "score": float(q[best] if known else 1 - q[0]), "overlap": overlap}

        which, prob = clf.probabilities(w.hash, p.unit)
        found = {int(k): judged(q, p.first[k], p.first[k + 1])[1] for k, q in zip(which, prob, strict=True) if q[0] < 0.5}
        every = [t for ts in templates.values() for t in ts]
        for i, j in runs(which, p.follows):
            taken: set = set()
            for _, first, last in windows([words(p.first[k], p.first[k + 1]) for k in range(i, j)], every):
                lines = range(i + first, i + last + 1)
                if taken & {*lines}:
                    continue
                a, b = p.first[lines[0]], p.first[lines[-1] + 1]
                _, q = clf.probabilities(w.hash[a:b], np.zeros(b - a, np.int64))
                known, span = judged(q[0], a, b) if len(q) else (False, {})
                if not known:
                    continue
                # lines beside it that are unknown and resemble no template carry on the notice
                first_, last_ = lines[0], lines[-1]
                while first_ > i and (f := found.get(first_ - 1)) and f["family"] == "unknown" and f["overlap"] < RESEMBLES and first_ - 1 not in taken:
                    first_ -= 1
                while last_ + 1 < j and (f := found.get(last_ + 1)) and f["family"] == "unknown" and f["overlap"] < RESEMBLES and last_ + 1 not in taken:
                    last_ += 1
                if first_ < lines[0] or last_ > lines[-1]:
                    lines = range(first_, last_ + 1)
                    a, b = p.first[first_], p.first[last_ + 1]
                    wider, more = judged(q[0], a, b)
                    span = more if wider else span
                if {found[k]["family"] for k in lines if k in found} <= {span["family"], "unknown"}:
                    taken |= {*lines}
                    for k in lines:
                        found.pop(k, None)
                    found[lines[0]] = span
        for k in sorted(found):
            out[int(np.searchsorted(w.first, p.first[k], "right")) - 1].append(found[k])
        return [pa.array(np.diff(p.before)), pa.array(out, _SPAN)]

    return arrow_columns(docs, "text", ADDED, compute, 2 << 20)


def _words(text: str) -> list[bytes]:
    w = Words(pa.array([text]))
    return [w.low[i:j].tobytes() for i, j in zip(w.start, w.end, strict=True)]
