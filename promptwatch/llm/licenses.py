"""Licence scans: a trained paragraph classifier on sparse word n-grams, confirmed by comparison with templates.

A paragraph is a run of lines with a letter or digit, joined by a blank, without the marks that comments begin with: a
notice wrapped at any width is one paragraph. Every single line is a candidate besides its paragraph. Features of a
candidate are the distinct words and word pairs (lower-cased letters and digits)
that occur in the templates, without those made of the commonest words only. A multinomial logistic regression over the licence families and ``none``, with a penalty
that leaves most weights at zero, is fitted on the driver to the templates with parts left out (positive rows) and to
``SAMPLE_PARAGRAPHS`` lines and as many paragraphs, at most, of the whole texts of ``SAMPLE_DOCS`` documents, chosen by
hash, that resemble no template (``none``); a temperature fitted on held-out
rows calibrates it. Scoring is native and local to a row: no shuffle, no Python on the executors.

A candidate counts if ``none`` has less than half of the probability. Its family is the most probable one if that
reaches ``LEAST_PROBABILITY`` and a template of the family shares ``LEAST_SIMILARITY`` of its n-grams with the candidate
(``confirmed``), and ``unknown`` otherwise. Lines that count are reported; a paragraph of several lines is reported if
it confirms a family that none of its lines confirms, in place of its unconfirmed lines with that guess, or if it counts
and none of its lines does. Before n-grams are made, texts, paragraphs and lines are asked for words without which
``none`` must keep half: the heaviest n-grams, such that all lighter ones together can't outweigh the intercept. That
test drops nothing that would be reported.

A notice in a longer run of lines is judged with the whole run, unless a line alone confirms it.

Defined results: null and empty texts have no paragraphs to report; repeated rows report each; ties between families
go to the name that sorts first; an empty table is scored with templates and two made-up ordinary lines alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that ordinary paragraphs are taken from, those of the smallest hash; and lines, and paragraphs, at most.
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 3000
LEAST_PROBABILITY = 0.6
LEAST_SIMILARITY = 0.7

# Notices that are commonly used to declare a licence.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
NONE = "none"
_WORD = "[a-z0-9]+"


def grams_of(text: str) -> list[str]:
    """Distinct words and word pairs of a text, on the driver."""
    w = re.findall(_WORD, text.lower())
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def grams(text: Column) -> Column:
    """The same as an expression."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1)
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def _variants(text: str) -> list[str]:
    """A template whole, and with every one of its words, its first or its last words left out."""
    w = text.split()
    drops = [" ".join(w[:i] + w[i + 1 :]) for i in range(len(w))]
    return [text] * 4 + drops + [" ".join(w[k:]) for k in (1, 2) if len(w) > k + 3] + [" ".join(w[:-k]) for k in (1, 2) if len(w) > k + 3]


class Classifier:
    """Weights by n-gram and class, intercepts, temperature, and words one of which every reported paragraph has."""

    def __init__(self, ordinary: list[list[str]], sparsity: float = 5e-4, rounds: int = 500):
        self.classes = [*sorted(TEMPLATES), NONE]
        every = {g for texts in TEMPLATES.values() for t in texts for g in grams_of(t)}
        self.grams = sorted(g for g in every if not _COMMON.issuperset(g.split()))
        place = {g: i for i, g in enumerate(self.grams)}
        rows = [(grams_of(v), k) for k, name in enumerate(self.classes[:-1]) for t in TEMPLATES[name] for v in _variants(t)]
        rows += [(g, len(self.classes) - 1) for g in ordinary] + [([], len(self.classes) - 1)] * 20
        x, y = np.zeros((len(rows), len(self.grams))), np.array([k for _, k in rows])
        for i, (own, _) in enumerate(rows):
            x[i, [place[g] for g in own if g in place]] = 1
        held = np.arange(len(rows)) % 5 == 4
        n = np.bincount(y, minlength=len(self.classes))
        weight = np.where(y == len(self.classes) - 1, len(n) - 1, 1.0) / n[y]  # ordinary lines weigh as much as all families
        self.w, self.b = self._fit(x[~held], y[~held], weight[~held], sparsity, rounds)
        logits = x[held] @ self.w + self.b
        self.temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: self._loss(logits / t, y[held], weight[held]))
        self.needed = self._needed()

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        z = z - z.max(axis=1, keepdims=True)
        return float((weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum())

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, sparsity: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient descent: weights shrink towards zero, intercepts don't."""
        k = int(y.max()) + 1
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        goal = np.eye(k)[y]
        share = weight / weight.sum()
        step = 2 / np.linalg.norm(x1 * np.sqrt(share)[:, None], 2) ** 2
        w = v = np.zeros((x1.shape[1], k))
        for i in range(rounds):
            z = x1 @ v
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = v - step * (x1.T @ (share[:, None] * (p - goal)))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparsity, 0)
            v, w = new + i / (i + 3) * (new - w), new
        return w[:-1], w[-1]

    def _needed(self) -> list[str] | None:
        """Words one of which a paragraph has whenever ``none`` has less than half; None if there are no such words."""
        gain = np.maximum(0, (self.w[:, :-1] - self.w[:, -1:]).max(axis=1)) / self.temperature
        need = (self.b[-1] - self.b[:-1].max()) / self.temperature - np.log(len(self.classes) - 1)
        order = np.argsort(gain, kind="stable")
        light = np.cumsum(gain[order]) < need
        if not light.any() and need <= 0:
            return None
        heavy = {self.grams[i] for i in order[~light]}
        return sorted({max(g.split(), key=lambda w: (w not in _COMMON, len(w))) for g in heavy})


#: Words that say little by themselves; a pair is looked for by its other word.
_COMMON = frozenset("the a of to this is under in and or by you it as with are for that be on at its".split())


#: What a line begins with before its words: signs, and the words that begin a comment.
_MARKS = r"(?i)^[^\p{L}\p{N}]*(?:(?:rem|dnl)(?:\s[^\p{L}\p{N}]*|$))?"
_NUMBERS = r"(?:^|\n)\d+\t"


def _paragraphs(text: Column) -> Column:
    """Runs of lines with a letter or digit, each line after its number and a tab."""
    def numbered(line: Column, i: Column) -> Column:
        return _let(F.regexp_replace(line, _MARKS, ""), lambda bare: F.when(bare == "", "").otherwise(F.concat(i.cast("string"), F.lit("\t"), bare)))

    runs = F.split(F.btrim(F.array_join(F.transform(F.split(text, "\n"), numbered), "\n"), F.lit("\n")), "\n{2,}")
    return F.filter(runs, lambda run: run != "")


def _candidates(paragraph: Column, has=lambda line: F.lit(True)) -> Column:
    """Number of the first line, number of lines and words of a run's lines that ``has`` holds for, and of the whole run if it has several lines."""
    def alone(line: Column) -> Column:
        return F.struct(F.substring_index(line, "\t", 1).cast("int").alias("paragraph"), F.lit(1).alias("lines"), F.regexp_replace(line, r"^\d+\t", "").alias("line"))

    def both(lines: Column) -> Column:
        whole = F.struct(
            F.substring_index(paragraph, "\t", 1).cast("int").alias("paragraph"), F.size(lines).alias("lines"),
            F.regexp_replace(paragraph, _NUMBERS, " ").alias("line"),
        )
        return F.concat(F.transform(F.filter(lines, has), alone), F.filter(F.array(whole), lambda w: w["lines"] > 1))

    return _let(F.split(paragraph, "\n"), both)


def _known() -> Column:
    return _map({c: ["array(" + ",".join(f"'{g}'" for g in grams_of(t)) + ")" for t in texts] for c, texts in TEMPLATES.items()})


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Fit to the templates and to ordinary paragraphs of a bounded number of documents."""
    named = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text")).where("d is not null and text is not null")
    some = named.select("d").orderBy(F.xxhash64("d"), "d").limit(SAMPLE_DOCS).distinct()  # ids alone are sorted
    known = [set(grams_of(t)) for texts in TEMPLATES.values() for t in texts]
    every = set().union(*known)
    templates = F.flatten(F.map_values(_known()))
    runs = named.join(F.broadcast(some), "d", "left_semi").select(F.explode(_paragraphs(F.col("text"))).alias("run"))
    own = F.array_intersect(grams(F.regexp_replace("run", _NUMBERS, " ")), F.lit(sorted(every)))
    like = _let(own, lambda g: F.exists(templates, lambda t: F.size(F.array_intersect(g, t)) >= F.size(t) / 2))
    rows = runs.select(like.alias("part"), F.explode(_candidates(F.col("run"))).alias("c")).select("part", "c.lines", "c.line")
    ordinary = []
    for kind in (F.col("lines") == 1, F.col("lines") > 1):
        chosen = rows.where(kind).orderBy(F.xxhash64("line"), "line", "part").limit(SAMPLE_PARAGRAPHS)
        words = chosen.select(grams(F.col("line")).alias("own"), "part")
        for g, n, part in words.select(F.array_intersect("own", F.lit(sorted(every))), F.size("own"), "part").collect():  # no other n-gram counts
            g = set(g)
            piece = part and len(g) >= n / 2  # a line of a wrapped notice is no ordinary one
            if not piece and not any(len(t & g) >= len(t) / 2 for t in known):
                ordinary.append(sorted(g))
    return Classifier(ordinary + [grams_of("an ordinary line of text"), grams_of("and another one with the same words as any other")])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _map(values: dict[str, list[str]]) -> Column:
    """A constant map of names to arrays of constants; names and words hold no quotes."""
    return F.expr("map(" + ",".join(f"'{k}',array({','.join(v)})" for k, v in values.items()) + ")")


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, similarity, confirmed and lines (1 for a single line), for what is reported."""
    used = np.flatnonzero(np.any(model.w != 0, axis=1))
    weights = _map({model.grams[i]: [f"{v:.6g}D" for v in model.w[i]] for i in used})
    start = F.array(*[F.lit(float(b)) for b in model.b])
    vocabulary = F.lit([model.grams[i] for i in used])
    known = _known()

    def has(words: Column) -> Column:
        return F.lit(True) if model.needed is None else words.rlike(r"(?i)\b(?:" + "|".join(model.needed) + r")\b")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(has(F.col("text")))
    rows = rows.select("doc_id", F.explode(_paragraphs(F.col("text"))).alias("run")).where(has(F.col("run")))

    def add(total: Column, g: Column) -> Column:
        return F.zip_with(total, F.element_at(weights, g), lambda a, b: a + b)

    def shares(own: Column) -> Column:
        return _let(F.aggregate(F.array_intersect(own, vocabulary), start, add), lambda z: _let(
            F.array_max(z), lambda top: _let(
                F.transform(z, lambda v: F.exp((v - top) / F.lit(float(model.temperature)))), lambda e: _let(
                    F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)
                )
            )
        ))

    last = len(model.classes)

    def scored(c: Column) -> Column:
        return _let(grams(c["line"]), lambda own: F.struct(c["paragraph"].alias("paragraph"), c["lines"].alias("lines"), own.alias("own"), shares(own).alias("p")))

    def judged(c: Column) -> Column:
        families = F.slice(c["p"], 1, last - 1)
        best = F.array_position(families, F.array_max(families)).cast("int")
        return _let(F.element_at(F.array(*[F.lit(n) for n in model.classes]), best), lambda guess: _let(
            F.array_max(F.transform(F.element_at(known, guess), lambda t: F.size(F.array_intersect(c["own"], t)) / F.size(t))), lambda alike: _let(
                F.round(F.array_max(families), 6), lambda share: F.struct(
                    c["paragraph"].alias("paragraph"), c["lines"].alias("lines"), guess.alias("guess"), share.alias("probability"), F.round(alike, 6).alias("similarity"),
                    ((share >= LEAST_PROBABILITY) & (F.round(alike, 6) >= LEAST_SIMILARITY)).alias("confirmed"),
                )
            )
        ))

    def reported(of: Column) -> Column:
        def shown(x: Column) -> Column:
            by_line = F.exists(of, lambda y: (y["lines"] == 1) & y["confirmed"] & (y["guess"] == x["guess"]))
            by_run = F.exists(of, lambda y: (y["lines"] > 1) & y["confirmed"] & (y["guess"] == x["guess"]))
            return F.when(x["lines"] == 1, x["confirmed"] | by_line | ~by_run).when(x["confirmed"], ~by_line).otherwise(F.size(of) == 1)

        return F.filter(of, shown)

    counts = F.filter(F.transform(_candidates(F.col("run"), has), scored), lambda c: F.element_at(c["p"], last) < 0.5)
    rows = rows.select("doc_id", F.explode(_let(F.transform(counts, judged), reported)).alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("guess")).otherwise("unknown").alias("family"), "probability", "similarity", "confirmed", "lines")


def license_notices(docs: DataFrame) -> DataFrame:
    """Train on the documents given and scan them all."""
    return scan(docs, train(docs))
