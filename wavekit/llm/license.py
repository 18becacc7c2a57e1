"""Licence scan: sparse word n-gram logistic regression over the lines of a document and across them, with a calibrated
unknown class; a template comparison confirms what it finds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.llm.common import hash_sample, whole_text

#: Wordings by which texts state their licence.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "This project is released under the terms of the Apache 2.0 license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This software is distributed under the terms of the MIT license",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Distributed under the terms of the GPL version 2 or later",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "eclipse": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without written permission of the publisher",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited",
    ),
}
#: Sentences with the same words that state no licence.
DECOYS = (
    "The driver was asked to show a licence and the version of the form was wrong",
    "The general public is permitted to use the library in the morning",
    "The apache helicopter was released in a new version",
    "Students of MIT work under a professor and publish free software papers",
    "The rights of the public were reserved in the new law",
    "Copying of the file took a long time and the source code was modified",
    "The committee discussed licenses, attribution and commercial terms at length",
)
UNKNOWN = "unknown"
WINDOW, STRIDE = 24, 12
#: Bound of the sample of corpus paragraphs that train the unknown class; the scan itself has none.
BACKGROUND_DOCS = 600
BACKGROUND_WINDOWS = 3000
VOCABULARY = 4000
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
#: Share of a template that confirms a window without a word pair of that family alone.
SHARED_SIMILARITY = 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(64, 0xD1342543DE82EF95, np.uint64))
_CHUNK = 1 << 20
#: Pairs of one statement stand no further apart than this.
_GAP = 4


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its end): words of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    b = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    place = np.arange(len(b)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(b)]))))
    value = np.where(inside, (_LOWER[b].astype(np.uint64) + np.uint64(1)) * _POWER[place & 63], np.uint64(0))
    h = np.add.reduceat(value, start)
    return (h ^ (h >> np.uint64(29))) * _MULT, start, end


def _pairs(h: np.ndarray) -> np.ndarray:
    return ((h[:-1] * np.uint64(3)) ^ (h[1:] >> np.uint64(1))) * _MULT if len(h) > 1 else h[:0]


def _grams(text: str) -> np.ndarray:
    h = _tokens(text.encode("utf-8", "surrogatepass"))[0]
    return np.concatenate([h, _pairs(h)])


@dataclass
class _Hit:
    """A window that states a licence: its line, and the words of the text that say so."""

    line: int
    family: str
    probability: float
    similarity: float
    confirmed: bool
    first: int
    last: int
    over: bool  # the window runs over a line end


@dataclass
class _Rest:
    """Last words of a part whose text goes on: the text, the number in it of the first of them, how many of them
    stand before the next window, hashes and lines."""

    text: int
    word: int
    seen: int
    h: np.ndarray
    line: np.ndarray


@dataclass
class LicenceModel:
    families: list[str]  # the last one is unknown
    keys: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # one row a key, one column a family
    bias: np.ndarray
    calibration: tuple[float, float]  # slope and offset of the log-odds of "states a licence"
    templates: list[tuple[str, dict[int, int]]]  # word pairs and their first places

    def __post_init__(self) -> None:
        of = {f: {p for g, t in self.templates if g == f for p in t} for f in self.families[:-1]}
        self.own_pairs = {f: own - set().union(*(of[g] for g in of if g != f)) for f, own in of.items()}

    def _contributions(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return np.where(hit[:, None], self.weights[at], 0)

    def windows(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Logits of windows [first, last) of a word sequence, from prefix sums."""
        one = np.vstack([np.zeros(self.weights.shape[1]), np.cumsum(self._contributions(h), axis=0)])
        two = np.vstack([np.zeros(self.weights.shape[1]), np.cumsum(self._contributions(_pairs(h)), axis=0)])
        n = (last - first)[:, None]
        pairs = two[np.maximum(last - 1, first)] - two[first]
        return (one[last] - one[first] + pairs) / np.sqrt(np.maximum(2 * n - 1, 1)) + self.bias

    def probability(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability that a window states a licence."""
        top = logits[:, :-1].max(1)
        known = top + np.log(np.exp(logits[:, :-1] - top[:, None]).sum(1))
        odds = self.calibration[0] * (known - logits[:, -1]) + self.calibration[1]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _match(self, family: str, pairs: np.ndarray, before: np.ndarray) -> tuple[float, int, int]:
        """Largest share of a template's word pairs among ``pairs``, and the words [first, last) where the most of
        them stand together; ``first`` is negative where the template begins in the pairs ``before``."""
        own = set(pairs.tolist())
        sim, t = max(((len(own & t.keys()) / len(t), t) for f, t in self.templates if f == family), key=lambda x: x[0])
        code = pairs.tolist()
        at = np.flatnonzero([p in t for p in code])
        if not len(at):
            return sim, 0, len(pairs) + 1
        group = np.cumsum(np.diff(at, prepend=at[0]) > _GAP)
        at = at[group == np.bincount(group).argmax()].tolist()
        while len(at) > 1 and t[code[at[0]]] > t[code[at[1]]]:  # a pair of the template that stands in front by chance
            del at[0]
        first, place = at[0], t[code[at[0]]]
        for i, p in zip(range(-1, -len(before) - 1, -1), before[::-1].tolist()):
            if first - i > _GAP:
                break
            if t.get(p, place) < place:
                first, place = i, t[p]
        return sim, first, at[-1] + 2

    def _judge(self, logits: np.ndarray, h: np.ndarray, before: np.ndarray, min_similarity: float) -> list[tuple[str, float, bool, int, int]]:
        """(family, similarity, confirmed, first word, last word + 1) of a window that states a licence: every family
        whose template is near and of whose templates it has a word pair that no other family's have (related
        families share most pairs); if none has one, the likeliest family when nearly all of its template is there. Where none is
        confirmed, the likeliest family stands for the window."""
        pairs = _pairs(h)
        likeliest = self.families[int(logits[:-1].argmax())]
        near = {f: m for f in self.families[:-1] if (m := self._match(f, pairs, before))[0] >= min_similarity}
        have = set(pairs.tolist())
        sure = [f for f in near if have & self.own_pairs[f]] or [f for f in near if f == likeliest and near[f][0] >= SHARED_SIMILARITY]
        if sure:
            return [(f, near[f][0], True, near[f][1], near[f][2]) for f in sure]
        return [(likeliest, self._match(likeliest, pairs, before)[0], False, 0, len(h))]

    def scan(self, texts: Sequence[str], min_probability: float, min_similarity: float) -> list[list[dict]]:
        """For every text the lines (from 0) where a licence statement starts; whole texts, in parts of some MB."""
        found: list[list[_Hit]] = [[] for _ in texts]
        rest = _Rest(-1, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        owner, held, size = [], [], 0
        for k, t in enumerate(texts):
            for no, line in enumerate(t.split("\n")):
                raw = line.encode("utf-8", "surrogatepass")
                held.append(raw)
                owner.append((k, no))
                size += len(raw) + 1
                if size >= _CHUNK:
                    rest = self._scan_lines(held, owner, rest, False, min_probability, min_similarity, found)
                    owner, held, size = [], [], 0
        self._scan_lines(held, owner, rest, True, min_probability, min_similarity, found)
        return [_settled(x) for x in found]

    def _scan_lines(self, lines, owner, rest: _Rest, last_part: bool, min_probability, min_similarity, found) -> _Rest:
        """Windows of every line, and windows that run over the line ends of a text. Words at the end of a part
        that no full window has read from its start go to the next part, so parts change no result."""
        h, start, _ = _tokens(b"\n".join(lines))
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))[: len(lines)].astype(np.int64)
        lo = np.searchsorted(start, begin)
        hi = np.append(lo[1:], len(h))[: len(lines)]
        words = hi - lo
        # the words kept from the part before stand in front
        kept = len(rest.h)
        h = np.concatenate([rest.h, h])
        lo, hi = lo + kept, hi + kept
        text = np.concatenate([np.full(kept, rest.text), np.repeat([k for k, _ in owner], words)]).astype(np.int64)
        line = np.concatenate([rest.line, np.repeat([no for _, no in owner], words)]).astype(np.int64)

        def spread(a, b):
            n = np.maximum(1, -(-np.maximum(b - a - WINDOW, 0) // STRIDE) + 1) * (b > a)
            which = np.repeat(np.arange(len(a)), n)
            first = a[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
            return first, np.minimum(first + WINDOW, b[which])

        first, last = spread(lo, hi)
        in_line = len(first)
        edge = np.flatnonzero(np.diff(text)) + 1
        a, b = np.append(0, edge)[: len(h)], np.append(edge, len(h))[: len(h)]
        fresh = a + (text[a] == rest.text) * rest.seen  # the first word that begins a window
        over_first, over_last = spread(fresh, b)
        next_rest = _Rest(-1, 0, 0, h[:0], line[:0])
        zero = {int(text[x]): 0 for x in a}  # number in its text of the first word of each text here
        if kept:
            zero[rest.text] = rest.word
        if len(h) and not last_part:  # the last text may go on: its windows that are not full wait
            wait = (over_first >= fresh[-1]) & (over_last - over_first < WINDOW)
            over_first, over_last = over_first[~wait], over_last[~wait]
            full = max(0, (b[-1] - fresh[-1] - WINDOW) // STRIDE + 1)
            cut = int(fresh[-1]) + full * STRIDE
            from_ = max(int(a[-1]), cut - WINDOW)
            k = int(text[-1])
            next_rest = _Rest(k, zero[k] + from_ - int(a[-1]), cut - from_, h[from_:], line[from_:])
        # a rest that begins inside a window read before and has no word beyond it is no window of its own
        done = (text[over_first] == rest.text) & (over_first == rest.seen) & (rest.seen > 0) & (over_last <= rest.seen + WINDOW - STRIDE) if kept else False
        over = ~(done | (line[over_first] == line[over_last - 1]))
        first, last = np.append(first, over_first[over]), np.append(last, over_last[over])
        if not len(first):
            return next_rest
        logits = self.windows(h, first, last)
        p = self.probability(logits)
        base = dict(zip(text[a].tolist(), a.tolist())) if len(h) else {}
        for w in np.flatnonzero(p >= min_probability):
            f = int(first[w])
            k = int(text[f])
            shift = zero[k] - base[k]
            before = _pairs(h[max(base[k], f - WINDOW) : f + 1]) if w >= in_line else h[:0]
            for family, sim, sure, x, y in self._judge(logits[w], h[f : last[w]], before, min_similarity):
                found[k].append(_Hit(int(line[f + x]), family, float(p[w]), sim, sure, f + x + shift, f + y + shift, bool(w >= in_line)))
        return next_rest


def _settled(hits: list[_Hit]) -> list[dict]:
    """One entry a line and family; a statement found by windows of a line and over line ends counts once."""
    best: dict[tuple[int, str], _Hit] = {}
    for x in hits:
        key = x.line, x.family
        if not x.over and (key not in best or (x.similarity, x.probability) > (best[key].similarity, best[key].probability)):
            best[key] = x
    order = lambda x: (not x.confirmed, x.over if not x.confirmed else False, -x.similarity, x.over, -x.probability, x.first)
    out: dict[tuple[int, str], _Hit] = {}
    spans: dict[str, list[tuple[int, int]]] = {}
    for x in sorted([*best.values(), *(x for x in hits if x.over)], key=order):
        own = spans.setdefault(x.family, [])
        at = bisect_left(own, (x.first, x.last))
        met = (at > 0 and own[at - 1][1] > x.first) or (at < len(own) and own[at][0] < x.last)
        if not met and (x.line, x.family) not in out:
            own.insert(at, (x.first, x.last))
            out[x.line, x.family] = x
    return [
        {"paragraph": x.line, "family": x.family, "probability": x.probability, "similarity": x.similarity, "confirmed": x.confirmed}
        for _, x in sorted(out.items())
    ]


def _samples(background: Sequence[str], rng) -> tuple[list[str], list[str]]:
    """Training texts: templates whole, with words left out, and among words of the corpus; decoys, corpus windows."""
    texts, names = [], []
    filler = [w for t in background for w in t.split()] or ["the", "of", "and", "a"]
    some = lambda n: " ".join(filler[i] for i in rng.integers(0, len(filler), n))
    for family, forms in TEMPLATES.items():
        for form in forms:
            words = form.split()
            for k in range(40):
                kept = [w for w in words if k < 8 or rng.random() > 0.1]
                around = 0 if k % 2 else int(rng.integers(0, WINDOW - min(WINDOW, len(kept)) + 1))
                texts.append(f"{some(around // 2)} {' '.join(kept)} {some(around - around // 2)}")
                names.append(family)
    for decoy in DECOYS:
        for k in range(30):
            texts.append(f"{some(k % 8)} {decoy} {some(k % 5)}")
            names.append(UNKNOWN)
    # the corpus: whole windows, and shorter stretches as short lines and ends of lines have them
    pieces = list(background)
    for t in background:
        words = t.split()
        n = int(rng.integers(1, max(2, len(words) + 1)))
        k = int(rng.integers(0, max(1, len(words) - n + 1)))
        pieces.append(" ".join(words[k : k + n]))
    return texts + pieces, names + [UNKNOWN] * len(pieces)


def fit_licences(background: Sequence[str], epochs: int = 12, rate: float = 0.05) -> LicenceModel:
    """Softmax regression on word and word-pair counts over the square root of their number; a seeded third of
    the sample is held out to calibrate the odds of the unknown class (Platt scaling)."""
    rng = np.random.default_rng(11)
    places = lambda pairs: {p: i for i, p in reversed(list(enumerate(pairs.tolist())))}
    templates = [(f, places(_pairs(_tokens(t.encode())[0]))) for f, forms in TEMPLATES.items() for t in forms]
    plain = []
    for t in background:  # corpus windows that do state a licence are not examples of the unknown class
        own = set(_pairs(_tokens(t.encode("utf-8", "surrogatepass"))[0]).tolist())
        if not any(len(own & s.keys()) >= 0.5 * len(s) for _, s in templates):
            plain.append(t)
    texts, names = _samples(plain, rng)
    families = [*TEMPLATES, UNKNOWN]
    grams = [_grams(t) for t in texts]
    key, count = np.unique(np.concatenate(grams), return_counts=True)
    key = np.sort(key[np.argsort(-count, kind="stable")[:VOCABULARY]])
    x = np.zeros((len(texts), len(key)), np.float32)
    for i, g in enumerate(grams):
        at = np.minimum(np.searchsorted(key, g), len(key) - 1)
        np.add.at(x[i], at[key[at] == g], 1)
        x[i] /= np.sqrt(max(1, len(g)))
    y = np.array([families.index(n) for n in names])
    held = rng.random(len(y)) < 1 / 3
    w, b = np.zeros((len(key), len(families)), np.float32), np.zeros(len(families), np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            z = x[part] @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            g = x[part].T @ d + 1e-4 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            b -= rate * d.sum(0)
    model = LicenceModel(families, key, w.astype(np.float64), b.astype(np.float64), (1.0, 0.0), templates)
    z = (x[held] @ w + b).astype(np.float64)
    top = z[:, :-1].max(1)
    odds = top + np.log(np.exp(z[:, :-1] - top[:, None]).sum(1)) - z[:, -1]
    known = (y[held] != len(families) - 1).astype(float)
    a, c = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps, with a weak pull to slope 1 and offset 0
        p = 1 / (1 + np.exp(-np.clip(a * odds + c, -40, 40)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - known) * odds).sum() + (a - 1), (p - known).sum() + c])
        step2 = np.linalg.solve([[(v * odds * odds).sum() + 1, (v * odds).sum()], [(v * odds).sum(), v.sum() + 1]], g)
        a, c = a - step2[0], c - step2[1]
    model.calibration = (float(a), float(c))
    return model


def train_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = BACKGROUND_DOCS, max_windows: int = BACKGROUND_WINDOWS) -> LicenceModel:
    """The unknown class learns from a bounded sample of corpus windows: of the ``max_docs`` distinct texts with the
    smallest hashes, whatever their lengths, the ``max_windows`` windows of 24 words with the smallest hashes. Windows
    are made where the texts lie; hashes and chosen windows alone are gathered."""
    rows = docs.select(whole_text(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    hashes = hash_sample(rows.select("h"), F.col("h"), max_docs, docs.count()).distinct()
    chosen = hashes.orderBy(F.pmod("h", F.lit(1 << 40)), "h").limit(max_docs)
    rows = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("t")  # at most max_docs rows

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["t"]:
                found = []
                for line in t.split("\n"):
                    words = line.split()
                    found += [" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)]
                yield pd.DataFrame({"w": found}, dtype=object)

    sample = sorted({r.w for r in rows.mapInPandas(windows, "w string").distinct().orderBy(F.xxhash64("w")).limit(max_windows).collect()})
    return fit_licences(sample)


def scan_licences(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text",
    min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """``<id_col>, found``: for every row the paragraphs of the whole text that state a licence, as an array of
    (paragraph, family, probability, similarity, confirmed).

    Every line is read in windows of 24 words, 12 apart, and the whole text in such windows that run over line
    ends (blank lines too), so wrapped statements meet the whole template. ``paragraph`` is the line where the
    statement starts; of the windows that see a statement the one closest to a template stands for it. Each family whose template confirms a window is reported. Null and empty texts have none. Rows are looked at alone, so
    repeated rows give repeated results; extra columns are ignored; an empty table gives an empty table."""
    kind = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scan(list(texts), min_probability, min_similarity), dtype=object)

    return docs.select(F.col(id_col), scan(whole_text(text_col)).alias("found"))
