"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

Every whole text is cut into paragraphs (lines; hard-wrapped lines are joined first). Each is
scored by a logistic regression over sparse word n-grams, one class a family and one for
everything else: as a whole, and in windows of ``WINDOWS`` words from every word on, so that a
notice counts alike alone, in long prose or beside others. Only windows are skipped in which the
weights themselves let no family reach the threshold. Of windows that overlap the clearest
stands. A paragraph yields its clearest family and every other one that is confirmed; of over
``LONG`` characters, it yields a finding for every place with a notice. Scores are calibrated by a temperature, and a
prediction under a threshold, both set on templates and paragraphs held out whole, is unknown. A prediction of a
family is confirmed if enough n-grams of one of its templates stand in the paragraph.

The model is trained on the driver: licence notices are the templates below, cut and disturbed
at random; the unknown class are ``SAMPLE_PARAGRAPHS`` paragraphs, of at most
``SAMPLE_CHARS`` characters, from anywhere in each of at most ``SAMPLE_DOCS`` documents, pieces of them, and sentences
that speak of permits and rights without granting any.

Defined results: a null or empty text has no findings; equal rows get equal findings; texts of
any length are scanned whole; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, prepared, sampled

FEATURES, NGRAMS = 1 << 15, 3
#: The corpus in the unknown class: documents, paragraphs of each, characters of a paragraph. Training only; scans have no bound.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 400, 4, 2_000
COPIES, EPOCHS, RATE, L2, CONFIRM, FALSE_SHARE, PIECES = 36, 60, 0.15, 2e-4, 0.5, 0.002, 10
#: Parts of the templates, near misses and sampled paragraphs, each held out whole from a model that the others train.
FOLDS = 3
UNKNOWN = "unknown"
#: Words of a window; characters above which a paragraph's findings have places of their own; words around such a place that may confirm it.
WINDOWS, LONG, NEAR = (3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64), 1_800, 32
#: Words' codes that a worker remembers.
KNOWN = 200_000

# Notices and core clauses of public licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright the authors. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This material is confidential and proprietary and may not be copied or distributed without permission.",
    ],
}
# Sentences that only sound like licences.
NEAR_MISSES = [
    "His driving licence was taken away for two years after the accident.",
    "The city gives a license to every restaurant that passes the inspection.",
    "Ask your parents for permission before you go on the trip.",
    "The software is free of charge for students and comes with a warranty of two years.",
    "The Massachusetts institute published a copy of the report under a new name.",
    "She granted him permission to use the general conditions of the hotel.",
    "The Apache tribe and the public general store had a version of the story.",
    "A fishing license is required by law in this state without exception.",
    "Our warranty covers parts and work, copies of the receipt must be included.",
    "The court said that the copyright of the song had run out long before.",
    "Creative people in common rooms share what they make with attribution to friends.",
    "The redistribution of land was the first act of the new government.",
    "We lost our license and cannot find the source of the problem.",
    "The license plate of the car was found in the river.",
]
_WORD = re.compile(r"[A-Za-z0-9]+")
_known: dict[str, int] = {}


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the paragraphs of a text; a line that looks hard-wrapped goes on in the next."""
    at = begin = 0
    n = len(text)
    while at <= n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end] if end - at < 200 else ""
        wrapped = 50 <= end - at <= 100 and line.rstrip()[-1:] not in (".", ":", "!", "?", "") and text[end + 1 : end + 2] not in ("\n", "")
        if not wrapped:
            if text[begin:end].strip():
                yield begin, end
            begin = end + 1
        at = end + 1


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def grams(words: list[str], least: int = 1) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(least, NGRAMS + 1) for i in range(len(words) - n + 1)]


def codes(words: list[str]) -> np.ndarray:
    """A number for each word, whatever its case."""
    got = list(map(_known.get, words))
    if None in got:
        if len(_known) > KNOWN:
            _known.clear()
        for i, c in enumerate(got):
            if c is None:
                got[i] = _known[words[i]] = zlib.crc32(words[i].lower().encode())
    return np.array(got, np.uint64)


def hashed(c: np.ndarray) -> list[np.ndarray]:
    """Features of the 1- to 3-grams that end at each word from the first, second and third on."""
    out, h = [], c
    for n in range(NGRAMS):
        if n:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n:]
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        out.append((x >> np.uint64(64 - 15)).astype(np.int64) % FEATURES)
    return out


def features(text: str) -> np.ndarray:
    c = codes(_WORD.findall(text))
    return np.concatenate(hashed(c[fresh(c)]))


def fresh(c: np.ndarray) -> np.ndarray:
    """Which words are not the one before again: a word said over and over counts once."""
    return np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)


def sums(table: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(upto, since): the grams within words i to j - 1, of at least two words, weigh upto[j] - since[i]."""
    n = len(hashes[0])
    ending = np.zeros((n + 3, *table.shape[1:]))
    ending[1 : n + 1] = table[hashes[0]]
    more = [np.zeros_like(ending) for _ in hashes[1:]]
    for k, (m, h) in enumerate(zip(more, hashes[1:], strict=True), 1):
        m[k + 1 : n + 1] = table[h]
        ending += m
    upto = ending.cumsum(0)
    two, three = more
    # grams that begin before word i and end within: the bigram at i, the trigrams at i and i + 1
    return upto[: n + 1], upto[: n + 1] + two[1 : n + 2] + three[1 : n + 2] + three[2 : n + 3]


TEMPLATE_GRAMS = {f: [frozenset(grams(tokens(t), 2)) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(text: str, family: str) -> float:
    """Greatest share of a template's 2- and 3-grams of the family that stand in the text."""
    have = set(grams(tokens(text), 2))
    return max((len(have & t) / len(t) for t in TEMPLATE_GRAMS.get(family, []) if t), default=0.0)


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    lifts: tuple[np.ndarray, float, float] | None = None

    def logits(self, text: str) -> np.ndarray:
        f = features(text)
        return self.bias + self.weights[f].sum(0) / max(1.0, len(f)) ** 0.5

    def bound(self) -> tuple[np.ndarray, float, float]:
        """What a feature, and the bias, lift some family over the unknown at most, and the lift that the threshold needs."""
        u = self.families.index(UNKNOWN)
        other = [i for i in range(len(self.families)) if i != u]
        need = self.temperature * float(np.log(self.threshold / (1 - self.threshold)))
        return (self.weights[:, other] - self.weights[:, [u]]).max(1), float((self.bias[other] - self.bias[u]).max()), need - 1e-6

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < self.threshold:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)])
        return self.families[best], float(p[best])


def disturbed(r: random.Random, text: str, noise: list[str]) -> str:
    """A template as it may stand in a text: cut, with words lost, added or in other case."""
    words = text.split()
    if len(words) > 14 and r.random() < 0.6:
        n = r.randint(10, len(words))
        at = r.randint(0, len(words) - n)
        words = words[at : at + n]
    words = [w for w in words if r.random() > 0.04]
    if r.random() < 0.4:
        words = r.choices(noise, k=r.randint(1, 12)) + words
    if r.random() < 0.4:
        words = words + r.choices(noise, k=r.randint(1, 12))
    out = " ".join(words)
    return out.upper() if r.random() < 0.15 else out


def piece(r: random.Random, text: str) -> str:
    words = text.split()
    n = min(len(words), r.choice((1, 1, 1, 2, *WINDOWS)))
    at = r.randint(0, len(words) - n)
    return " ".join(words[at : at + n])


def trained(others: list[str], seed: int = 5) -> Model:
    """Fit, calibrate and set the threshold; ``others`` are paragraphs of the corpus."""
    r = random.Random(seed)
    noise = [w for p in others for w in p.split()[:40]] or ["word"]
    others = [p for p in others if not any(similarity(p, f) >= CONFIRM for f in TEMPLATES)]
    rows = [(f, disturbed(r, t, noise), i % FOLDS) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for _ in range(COPIES)]
    rows += [(UNKNOWN, q, i % FOLDS) for i, p in enumerate(others) for q in (p, *(piece(r, p) for _ in range(PIECES)))]
    rows += [(UNKNOWN, disturbed(r, t, noise), i % FOLDS) for i, t in enumerate(NEAR_MISSES) for _ in range(COPIES)]
    r.shuffle(rows)
    return calibrated(rows)


def fitted(rows: list[tuple[str, str]]) -> Model:
    """The weights; a family without rows is never the likeliest."""
    families = [*TEMPLATES, UNKNOWN]
    model = Model(families, np.zeros((FEATURES, len(families))), np.zeros(len(families)))
    x = [features(t) for _, t in rows]
    x = [f if len(f) else np.zeros(1, np.int64) for f in x]
    flat, size = np.concatenate(x), np.array([len(f) for f in x])
    start, scale = np.concatenate([[0], np.cumsum(size)[:-1]]), 1 / np.sqrt(size)
    own = np.repeat(np.arange(len(x)), size)
    y = np.zeros((len(rows), len(families)))
    y[np.arange(len(rows)), [families.index(f) for f, _ in rows]] = 1
    share = y.sum(0)
    weight = (len(rows) / len(families) / np.maximum(share, 1)) ** 0.5
    weight = (y * weight).sum(1)[:, None]
    used = np.unique(flat)
    place = np.searchsorted(used, flat)
    w, m, v = (np.zeros((len(used), len(families))) for _ in range(3))
    bm, bv = np.zeros(len(families)), np.zeros(len(families))
    for step in range(1, EPOCHS + 1):
        z = np.add.reduceat(w[place], start) * scale[:, None] + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - y) * weight / len(rows)
        per = (d * scale[:, None])[own]
        g = np.stack([np.bincount(place, per[:, c], len(used)) for c in range(len(families))], 1) + L2 * w / len(families)
        b = d.sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        bm, bv = 0.9 * bm + 0.1 * b, 0.99 * bv + 0.01 * b * b
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        model.bias -= RATE * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.99**step)) + 1e-9)
    model.weights[used] = w
    return model


def calibrated(rows: list[tuple[str, str, int]]) -> Model:
    """Fit on all rows; temperature and threshold from what models say of rows of templates and paragraphs they have not seen."""
    model = fitted([x[:2] for x in rows])
    families, z, label = model.families, [], []
    for fold in range(FOLDS):
        held = [x for x in rows if x[2] == fold]
        if not held or len(held) == len(rows):
            continue
        part = fitted([x[:2] for x in rows if x[2] != fold])
        z += [part.logits(t) for _, t, _ in held]
        label += [families.index(f) for f, _, _ in held]
    z, label = np.array(z), np.array(label)

    def spread(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        return e / e.sum(1, keepdims=True)

    model.temperature = min((0.25 * 1.25**i for i in range(20)), key=lambda t: -np.log(spread(t)[np.arange(len(z)), label] + 1e-12).mean())
    p = spread(model.temperature)
    unknown = families.index(UNKNOWN)
    wrong = np.sort(p[(label == unknown) & (p.argmax(1) != unknown)].max(1, initial=0))[::-1]
    allowed = int(FALSE_SHARE * (label == unknown).sum())
    model.threshold = float(max(0.5, wrong[allowed] + 1e-6 if len(wrong) > allowed else 0))
    model.lifts = model.bound()
    return model


FINDING = T.ArrayType(
    T.StructType(
        [
            T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType()),
        ]
    )
)


def windows(c: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """(begin, end, family, probability, log odds) of the windows of words that the model gives a family.

    ``sizes`` are the paragraphs' words; no window spans two paragraphs.
    """
    hashes, n = hashed(c), len(c)
    most, bias, need = model.lifts
    upto, since = sums(most, hashes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes)
    first = last - sizes
    begins, ends = [first], [last]  # whole paragraphs
    for w in WINDOWS:
        if w > n:
            break
        at = np.flatnonzero(upto[w:] - since[: n + 1 - w] >= (need - bias) * (3 * w - 3) ** 0.5)
        at = at[own[at] == own[at + w - 1]]
        begins.append(at)
        ends.append(at + w)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    size = end - begin
    count = np.maximum(3 * size - 3, 1)
    lift = np.where(size > 1, upto[end] - since[begin], most[hashes[0][begin]])
    ok = lift >= (need - bias) * count**0.5
    begin, end, size, count = begin[ok], end[ok], size[ok], count[ok]
    if not len(begin):
        return begin, end, begin, np.zeros(0), np.zeros(0)
    upto, since = sums(model.weights, hashes)
    z = np.where((size > 1)[:, None], upto[end] - since[begin], model.weights[hashes[0][begin]])
    z = (model.bias + z / (count**0.5)[:, None]) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    every = np.arange(len(best))
    top = p[every, best]
    p[every, best] = 0
    ok = (best != model.families.index(UNKNOWN)) & (top >= model.threshold)
    odds = np.log(np.maximum(top, 1e-300)) - np.log(np.maximum(p.sum(1), 1e-300))
    return begin[ok], end[ok], best[ok], top[ok], odds[ok]


def clearest(found: tuple[np.ndarray, ...], n: int) -> list[tuple[int, int, int, float]]:
    """Windows none of which overlap, those of the highest odds first."""
    begin, end, family, p, odds = found
    taken, out = np.zeros(n, bool), []
    for i in np.lexsort((begin, begin - end, -odds)):
        if not taken[begin[i] : end[i]].any():
            taken[begin[i] : end[i]] = True
            out.append((int(begin[i]), int(end[i]), int(family[i]), float(p[i])))
    return out


def findings(text: str | None, model: Model) -> list[dict]:
    words: list[str] = []
    bounds, sizes = [], []
    for begin, end in paragraphs(text or ""):
        w = _WORD.findall(text, begin, end)
        if w:
            words += w
            bounds.append((begin, end))
            sizes.append(len(w))
    if not words:
        return []
    c, first = codes(words), np.cumsum(sizes) - sizes
    keep = fresh(c)
    keep[first] = True
    c, sizes = c[keep], np.add.reduceat(keep.astype(np.int64), first)
    starts = np.cumsum(sizes) - sizes
    kept: dict[int, list] = {}
    for hit in clearest(windows(c, sizes, model), len(c)):
        kept.setdefault(int(np.searchsorted(starts, hit[0], "right")) - 1, []).append(hit)
    out = []
    for k, hits in sorted(kept.items()):
        begin, end = bounds[k]
        new = keep[first[k] : first[k + 1] if k + 1 < len(first) else None]
        spans = [m.span() for m, one in zip(_WORD.finditer(text, begin, end), new, strict=True) if one]
        hits = [(b - int(starts[k]), e - int(starts[k]), model.families[f], p) for b, e, f, p in hits]
        out += _placed(text, begin, end, spans, hits) if end - begin > LONG else _whole(text, begin, end, spans, hits)
    return out


def _finding(begin: int, end: int, family: str, p: float, s: float) -> dict:
    return {"begin": begin, "end": end, "family": family, "probability": p, "similarity": s, "confirmed": s >= CONFIRM}


def _around(text: str, spans: list, b: int, e: int, clearer: list[tuple[int, int]], reach: int) -> str:
    """The text about words b to e, as far as ``reach`` words or a clearer notice: a rest of one does not borrow its words."""
    lo = max([b - reach, 0, *(y for _, y in clearer if y <= b)])
    hi = min([e + reach, len(spans), *(x for x, _ in clearer if x >= e)])
    return text[spans[lo][0] : spans[hi - 1][1]]


def _whole(text: str, begin: int, end: int, spans: list, hits: list) -> list[dict]:
    """A paragraph's clearest family and the others that are confirmed."""
    best: dict[str, list] = {}
    for i, (b, e, family, p) in enumerate(hits):
        s = similarity(_around(text, spans, b, e, [h[:2] for h in hits[:i] if h[2] != family], len(spans)), family)
        row = best.setdefault(family, [p, s])
        row[:] = max(p, row[0]), max(s, row[1])
    rows = [_finding(begin, end, family, p, s) for family, (p, s) in best.items()]
    return [r for i, r in enumerate(rows) if not i or r["confirmed"]]


def _placed(text: str, begin: int, end: int, spans: list, hits: list) -> list[dict]:
    """The findings of a long paragraph, each with its own place, cut at blanks; windows of a family that touch are one."""
    rank = {h[0]: i for i, h in enumerate(hits)}
    joined: list[list] = []
    for b, e, family, p in sorted(hits):
        if joined and joined[-1][2] == family and b - joined[-1][1] <= 2:
            joined[-1][1], joined[-1][3], joined[-1][4] = e, max(p, joined[-1][3]), min(rank[b], joined[-1][4])
        else:
            joined.append([b, e, family, p, rank[b]])
    joined.sort(key=lambda h: h[4])
    order = sorted(range(len(joined)), key=lambda i: joined[i][0])
    at = {i: k for k, i in enumerate(order)}
    out = []
    for i, (b, e, family, p, _) in enumerate(joined):
        close = []
        for step in (-1, 1):  # places do not overlap: those within reach are the next ones
            k = at[i] + step
            while 0 <= k < len(order) and joined[order[k]][0] < e + NEAR and b - NEAR < joined[order[k]][1]:
                if order[k] < i:
                    close.append(joined[order[k]])
                k += step
        s = similarity(_around(text, spans, b, e, [h[:2] for h in close if h[2] != family], NEAR), family)
        if s < CONFIRM and close:
            continue  # a rest of a clearer notice
        x, y = spans[b][0], spans[e - 1][1]
        while x > begin and not text[x - 1].isspace():
            x -= 1
        while y < end and not text[y].isspace():
            y += 1
        out.append(_finding(x, y, family, p, s))
    return sorted(out, key=lambda r: (r["begin"], r["end"]))


def sample_of(text: str, seed: int) -> list[str]:
    """Paragraphs from anywhere in a text; of a very long one, a cut of ``SAMPLE_CHARS`` from anywhere in it."""
    r, parts = random.Random(f"{seed} {zlib.crc32(text.encode())}"), list(paragraphs(text))
    out = []
    for b, e in r.sample(parts, min(len(parts), SAMPLE_PARAGRAPHS)):
        b = r.randint(b, max(b, e - SAMPLE_CHARS))
        out.append(text[b : min(e, b + SAMPLE_CHARS)])
    return [p for p in out if p.strip()]


def corpus_sample(docs: DataFrame, seed: int = 5) -> list[str]:
    """Paragraphs of a bounded number of documents, taken from whole texts where they lie: only these go to the driver."""
    rows = sampled(docs.where("text is not null").select("doc_id", "text"), "doc_id", SAMPLE_DOCS)
    rows = map_columns(rows, ["text"], [("parts", T.ArrayType(T.StringType()))], lambda: lambda texts: [[sample_of(t, seed) for t in texts]])
    return [p for parts in sorted(row["parts"] for row in rows.select("parts").collect()) for p in parts]


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """Append ``licences``: the findings in each text, places in characters."""

    def make() -> Callable:
        return lambda texts: [[findings(t, model) for t in texts]]

    return map_columns(docs, ["text"], [("licences", FINDING)], make)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and family found: paragraphs, of which confirmed, and the highest probability."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs, trained(corpus_sample(docs))).where(F.size("licences") > 0)
    found = found.withColumn("family", F.explode(F.array_distinct(F.transform("licences", lambda x: x.family))))
    own = F.filter("licences", lambda x: x.family == F.col("family"))  # a row's findings stay in the row: nothing is shuffled
    return found.withColumn("own", own).select(
        "doc_id",
        "family",
        F.size("own").cast("long").alias("paragraphs"),
        F.size(F.filter("own", lambda x: x.confirmed)).cast("long").alias("confirmed"),
        F.round(F.array_max(F.transform("own", lambda x: x.probability)), 6).alias("probability"),
        F.array_min(F.transform("own", lambda x: x.begin)).alias("first_begin"),
    )
