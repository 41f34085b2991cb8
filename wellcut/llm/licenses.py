r"""Licence scan [native]: a trained paragraph classifier, scored by DataFrame functions alone.

A paragraph ends at a blank line (or a comment line without words) and at a line that closes a sentence; other line ends
are wraps, so a notice that was wrapped at some width is one paragraph again. A paragraph of several lines is scored as a
whole and line by line; its lines add families that the whole doesn't have.

A multinomial logistic regression over sparse word 1- and 2-grams tells licence families from one another and from an
"unknown" class. It is trained on the driver from notices of each family, varied by dropping words and by adding what
other paragraphs hold, and from paragraphs of ``max_docs`` documents (those with the smallest hash of the id, whole texts)
as unknowns; of these only the sets of known n-grams and how often each set occurs reach the driver. Its temperature is
fitted on held-out examples, so that the unknown class is calibrated. A paragraph gets a family where that family is the
likeliest with at least ``least`` probability and a notice of the family confirms it: it holds ``overlap`` of its words, and the family's
name where the notice has it (words that several notices of the family have, and those of no other).

A gate goes first and loses nothing: of each notice it takes so many cue words that the others are less than ``overlap``
of it, so that a paragraph without any cue can't be confirmed, whatever its score. The sample decides which words are the
cues (the rarest), hence what the gate costs, not what it lets through. Paragraphs with a cue go through the exact
overlap test before any n-gram is formed. Scoring is one narrow pass: no join, no shuffle, no Python.

Defined results: a null or empty text has no paragraphs; paragraphs without a word don't count; repeated rows are
scanned alike; ties between families go to the first in the order of FAMILIES; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellcut.llm.labels import sampled

# Short notices of licence families.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Released under the GNU GPL, version 2 or later.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1"],
    "bsd": ["Released under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This source code form is subject to the terms of the Mozilla Public License.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "epl": ["This program is made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "zlib": ["Released under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.", "SPDX-License-Identifier: Zlib"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released into the public domain.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright by the author. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
FAMILIES = list(NOTICES)
UNKNOWN = "unknown"
SPLIT = "[^a-z0-9]+"
#: Ends of paragraphs: a line end after a sentence's, or one with nothing but blanks and comment signs up to the next.
PARAGRAPH = r"""\n(?:(?<=[.!?]["')]{0,2}[ \t\r]{0,4}\n)|(?:[ \t\r]*[#*/;%-]*[ \t\r]*\n)+)"""
WORD = "[^\\x20\\x09-\\x0D]"
#: Words of each notice that are put into unknown examples: the rarest, the longest first.
ODD = 4
FOUND = "array<struct<family:string,probability:double,overlap:double,text:string>>"


def words(text: str) -> list[str]:
    """Words of the ASCII letters and digits, in lower case: as the expressions below take them."""
    return [w for w in re.split(SPLIT, text.lower()) if w]


def grams(ws: list[str]) -> list[str]:
    return list(dict.fromkeys([*ws, *(f"{a} {b}" for a, b in zip(ws[:-1], ws[1:], strict=True))]))


def all_notices() -> list[tuple[int, list[str]]]:
    """Number of the family, and words, of each notice."""
    return [(FAMILIES.index(f), words(x)) for f, xs in NOTICES.items() for x in xs]


@dataclass
class Model:
    """weights: a row for each feature; columns are FAMILIES, then unknown."""

    cues: list[str]
    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float = 0.6
    overlap: float = 0.6

    def score(self, paragraph: str) -> tuple[str, float, float]:
        """Family, probability and overlap of one paragraph, as the expressions below have them."""
        ws, number = words(paragraph), {g: i for i, g in enumerate(self.features)}
        z = self.bias + sum((self.weights[number[g]] for g in grams(ws) if g in number), np.zeros(len(self.bias)))
        y = int(np.argmax(z))
        own = [containment(ws, f, n) for f, n in all_notices() if f == y]
        return [*FAMILIES, UNKNOWN][y], float(1 / np.exp((z - z[y]) / self.temperature).sum()), max(own, default=0.0)


def own_words(family: int, notice: list[str]) -> set[str]:
    """The family's name in a notice: words that two of its notices have and no other family's. A paragraph must have one, if there is any."""
    times = Counter(w for f, n in all_notices() if f == family for w in set(n))
    others = {w for f, n in all_notices() if f != family for w in n}
    return {w for w in notice if times[w] > 1 and w not in others}


def containment(ws: list[str], family: int, notice: list[str]) -> float:
    """Share of a notice's distinct words that the paragraph has; 0 without any of its own words."""
    own = own_words(family, notice)
    return 0.0 if own and not own & set(ws) else len(set(ws) & set(notice)) / len(set(notice))


def cue_words(notice: list[str], seen: dict[str, int], overlap: float) -> list[str]:
    """The rarest words of a notice, so many that the others are less than ``overlap`` of it."""
    ws = sorted(set(notice), key=lambda w: (seen.get(w, 0), -len(w), w))
    return ws[: next(k for k in range(1, len(ws) + 1) if k == len(ws) or (len(ws) - k) / len(ws) < overlap)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def feature_names() -> list[str]:
    return sorted({g for _, n in all_notices() for g in grams(n)})


def fit(unknown: dict[tuple[str, ...], int], seed: int = 5, variants: int = 40, rounds: int = 500, sparsity: float = 2e-4) -> Model:
    """Trains on the notices and on ``unknown``: sets of features of other paragraphs, and how often each was seen."""
    notices, features = all_notices(), feature_names()
    number = {g: i for i, g in enumerate(features)}
    patterns = sorted(unknown) or [()]
    times = np.array([unknown.get(p, 1) for p in patterns], float)
    seen: Counter[str] = Counter()
    for p, n in zip(patterns, times, strict=True):
        for g in p:
            seen[g] += int(n)
    cues = sorted({w for _, n in notices for w in cue_words(n, seen, Model.overlap)})
    most = max(2, times.sum() / 300)
    odd = sorted({w for _, n in notices for w in sorted({w for w in n if len(w) > 2 and seen[w] <= most}, key=lambda w: (seen[w], -len(w), w))[:ODD]}) or cues
    rng = np.random.default_rng(seed)
    some = lambda: patterns[rng.choice(len(patterns), p=times / times.sum())]
    examples: list[tuple[int, set[str], float]] = [(y, set(grams(n)), 1.0) for y, n in notices]
    for y, n in notices:
        for _ in range(variants):
            ws = [w for w in n if rng.random() > 0.12] or n
            examples.append((y, set(grams(ws)) | (set(some()) if rng.random() < 0.5 else set()), 1.0))
    # an odd word or two of a notice alone is no licence
    k = len(FAMILIES)
    for _ in range(variants * 12):
        examples.append((k, {odd[int(rng.integers(0, len(odd)))] for _ in range(int(rng.integers(1, 3)))} | set(some()), 1.0))
    # the corpus' paragraphs weigh as much as 2000 examples, each set by its share
    examples += [(k, set(p), float(w)) for p, w in zip(patterns, 2000 * times / times.sum(), strict=True)]
    x = np.zeros((len(examples), len(features)), np.float32)
    for i, (_, gs, _) in enumerate(examples):
        x[i, [number[g] for g in gs if g in number]] = 1
    y, weight = np.array([c for c, _, _ in examples]), np.array([w for _, _, w in examples])
    held = rng.random(len(y)) < 0.25
    held[: len(notices)] = False
    one = np.eye(k + 1)[y]
    w, b = np.zeros((len(features), k + 1)), np.zeros(k + 1)
    xt, ot, part = x[~held].astype(float), one[~held], weight[~held, None] / weight[~held].sum()
    for _ in range(rounds):  # proximal gradient: the L1 part keeps the weights sparse
        d = (_softmax(xt @ w + b) - ot) * part
        w -= 3.0 * (xt.T @ d)
        b -= 3.0 * d.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - sparsity, 0)
    z, yh, wh = x[held] @ w + b, y[held], weight[held]
    heats = np.geomspace(0.3, 4, 40)
    loss = [-(wh * np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12)).sum() for t in heats]
    return Model(cues, features, np.round(w, 6), np.round(b, 6), float(round(heats[int(np.argmin(loss))], 6)))


def train(docs: DataFrame, max_docs: int = 400) -> Model:
    """Fits the model with the paragraphs of ``max_docs`` of docs(doc_id, text) as unknowns, those left out that hold most of a notice."""
    ids = sampled(docs.select("doc_id"), max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    lines = texts.select(F.explode(F.split("text", PARAGRAPH)).alias("line")).select(F.lower("line").alias("line")).where(F.col("line").rlike(WORD))
    known = _literals(feature_names())
    held = lines.where(~_near_notice(F.col("line"), Model.overlap)).select(F.array_sort(F.array_intersect(_grams(_words(F.col("line"))), known)).alias("held"))
    return fit({tuple(r["held"]): r["n"] for r in held.groupBy("held").agg(F.count("*").alias("n")).collect()})


def _once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c evaluated once."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPLIT), lambda w: w != "")


def _grams(ws: Column) -> Column:
    return _once(ws, lambda v: F.array_distinct(F.concat(v, F.transform(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda w, i: F.concat(F.get(v, i), F.lit(" "), w)))))


def _has_cue(lowered: Column, cues: list[str]) -> Column:
    return F.arrays_overlap(F.split(lowered, SPLIT), _literals(cues))


def _array(ws: Iterable[str]) -> str:
    """SQL of an array of words; parsed at once, where a literal for each would take a call each."""
    return f"cast(array({', '.join(repr(w) for w in ws)}) AS array<string>)"


def _literals(ws: Iterable[str]) -> Column:
    return F.expr(_array(ws))


def _numbers(xs: Iterable[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in xs)})"


def _overlap(ws: Column, n: Column) -> Column:
    """What ``containment`` says of words and a notice, struct(f, w, own)."""
    return F.when((F.size(n["own"]) > 0) & ~F.arrays_overlap(ws, n["own"]), F.lit(0.0)).otherwise(F.size(F.array_intersect(ws, n["w"])) / F.size(n["w"]))


def _notices() -> Column:
    one = lambda f, n: f"named_struct('f', '{FAMILIES[f]}', 'w', {_array(dict.fromkeys(n))}, 'own', {_array(sorted(own_words(f, n)))})"
    return F.expr(f"array({', '.join(one(f, n) for f, n in all_notices())})")


def _near_notice(line: Column, overlap: float) -> Column:
    """Whether a paragraph in lower case holds ``overlap`` of any notice, without which no family is confirmed."""
    held = F.array_intersect(F.split(line, SPLIT), _literals(sorted({w for _, n in all_notices() for w in n})))
    return _once(held, lambda h: F.exists(_notices(), lambda n: _overlap(h, n) >= overlap))


def _scored(line: Column, model: Model) -> Column:
    """struct(family, probability, overlap) of one paragraph in lower case."""
    table = F.expr(f"map({', '.join(f'{g!r}, {_numbers(w)}' for g, w in zip(model.features, model.weights, strict=True) if w.any())})")
    names = _literals([*FAMILIES, UNKNOWN])

    def logits(ws: Column) -> Column:
        known = F.filter(F.transform(_grams(ws), lambda g: F.try_element_at(table, g)), lambda v: v.isNotNull())
        return F.aggregate(known, F.expr(_numbers(model.bias)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

    def ranked(z: Column) -> Column:
        high = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - high) / F.lit(model.temperature)))
        return F.struct(F.element_at(names, F.array_position(z, high).cast("int")).alias("family"), (F.lit(1.0) / total).alias("probability"))

    def confirmed(ws: Column, r: Column) -> Column:
        shares = F.transform(F.filter(_notices(), lambda n: n["f"] == r["family"]), lambda n: _overlap(ws, n))
        return F.struct(r["family"].alias("family"), r["probability"].alias("probability"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("overlap"))

    return _once(_words(line), lambda ws: _once(_once(logits(ws), ranked), lambda r: confirmed(ws, r)))


def _licenses(units: Column, model: Model) -> Column:
    """The confirmed families of some paragraphs, with their texts."""
    near = F.filter(units, lambda x: _near_notice(F.lower(x), model.overlap))
    made = F.transform(near, lambda x: _once(_scored(F.lower(x), model), lambda s: F.struct(s["family"].alias("family"), s["probability"].alias("probability"), s["overlap"].alias("overlap"), x.alias("text"))))
    return F.filter(made, lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= model.least) & (s["overlap"] >= model.overlap))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses and licenses: array of (family, probability, overlap, text) in text order."""
    text = F.coalesce("text", F.lit(""))
    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda x: x.rlike(WORD))

    def found(p: Column) -> Column:
        lines = F.filter(F.split(p, "\n"), lambda x: x.rlike(WORD))
        others = lambda whole: F.concat(whole, F.filter(_licenses(lines, model), lambda s: ~F.exists(whole, lambda o: o["family"] == s["family"])))
        return _once(_licenses(F.array(p), model), others)

    cued = F.filter(paragraphs, lambda p: _has_cue(F.lower(p), model.cues))
    near = F.filter(cued, lambda p: _near_notice(F.lower(p), model.overlap))
    flat = F.flatten(F.transform(near, found)).cast(FOUND)
    made = docs.select("doc_id", F.size(paragraphs).cast("long").alias("n_paragraphs"), flat.alias("licenses"))
    return made.withColumn("n_licenses", F.size("licenses").cast("long"))
