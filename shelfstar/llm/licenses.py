"""Licence scan: a trained paragraph classifier proposes families, templates confirm them.

A sparse logistic regression over word n-grams (one to three words) tells licence families and ``unknown`` apart. It is
fitted on the templates (whole, in parts, and inside other words) and on a bounded sample of paragraphs; a temperature
fitted on held-out examples calibrates it. A paragraph, here the lines between two blank ones, is read in overlapping windows of
three times the longest template. A window proposes each family whose calibrated probability against ``unknown`` is at
least ``sure``; so it may propose several, and none is what most windows do. A proposed family is confirmed if the window has most
word shingles of one of its templates (a template of fewer words than a shingle is compared as a whole).

The classifier judges every window that has n-grams of the model. A text is settled without its windows only if the words it has,
in whatever order, cannot bring a family to ``sure``: the bound is the model's own. DataFrame operations and Spark's own
classifier only.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.llm.common import cut

#: Notices by which works state their licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "MIT License", "SPDX-License-Identifier: MIT", "Apache-2.0 OR MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
                "GNU General Public License v3.0", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.",
                 "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "BSD 3-Clause License", "BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Mozilla Public License 2.0", "MPL-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "CC BY 4.0", "CC-BY-4.0"],
    "all-rights-reserved": ["All rights reserved. No part of this publication may be reproduced without permission.",
                            "All rights reserved"],
}
UNKNOWN, NGRAMS = "unknown", (1, 2, 3)
_WORD = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"


@dataclass(frozen=True)
class Params:
    """``sample``: most paragraphs of the corpus that the model is fitted on (a hash picks about as many);
    ``sure``: least probability of a named family; ``shingle`` and ``share``: words of a shingle (or of the
    template, if it has fewer) and least share of a template's shingles that confirm a family."""

    sample: int = 2000
    sure: float = 0.5
    shingle: int = 5
    share: float = 0.8


def plain_words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


def _templates(p: Params) -> list[tuple[str, int, list[str]]]:
    """(family, words of a shingle, distinct shingles) of every template."""
    words = [(f, plain_words(t)) for f, texts in TEMPLATES.items() for t in texts]
    return [(f, n, sorted(set(_grams(w, n)))) for f, w in words for n in [min(p.shingle, len(w))]]


def _by_size(p: Params) -> dict[int, list[str]]:
    """The shingles of all templates by their number of words."""
    every = _templates(p)
    return {n: sorted({g for _, m, gs in every if m == n for g in gs}) for n in sorted({m for _, m, _ in every})}


def _wordlist(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a plan would inline a column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _hits(text: Column, known: dict[int, list[str]]) -> Column:
    """(gram, at, size, first, last, of) of a text's n-grams in bounded lists by their number of words: place of its first
    word, number of words, the lines of its first and last word, and the words of the text. Words in no list are
    dropped first; linear in the text."""
    listed = sorted({w for grams in known.values() for g in grams for w in g.split()})
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.transform(_wordlist(x), lambda w: F.struct(i.alias("line"), w.alias("word"))))

    def grams(found: Column, n: int, of: Column) -> Column:
        def one(t: Column, j: Column) -> Column:
            last = F.get(found, j + (n - 1))
            gram = F.array_join(F.transform(F.slice(found, j + 1, n), lambda x: x["word"]), " ")
            return F.when(last["at"] == t["at"] + (n - 1), F.struct(gram.alias("gram"), t["at"].alias("at"), F.lit(n).alias("size"), t["line"].alias("first"),
                                                                    last["line"].alias("last"), of.alias("of")))
        return F.filter(F.transform(found, one), lambda h: h["gram"].isin(known[n]))

    def search(words: Column) -> Column:
        placed = F.transform(words, lambda t, i: F.struct(i.alias("at"), t["line"].alias("line"), t["word"].alias("word")))
        some = F.filter(placed, lambda t: t["word"].isin(listed))
        return _let(some, lambda found: F.concat(*[grams(found, n, F.size(words)) for n in sorted(known)]))

    return _let(F.flatten(lines), search)


def _examples() -> list[tuple[str, str, bool]]:
    """(text, family, held out): templates whole, in halves and inside other words; fillers are unknown."""
    out = []
    around = ["", "notice ", "the author says ", "copyright 2020 by someone "]
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            cuts = [w, w, w[len(w) // 3:], w[:-max(1, len(w) // 4)]] if len(w) > 5 else [w]  # a part of a short notice says nothing
            out += [(f"{a}{' '.join(c)}{b}", family, i % 3 == 1) for i, (a, b, c) in enumerate(
                (a, b, c) for a in around for b in ("", " see the file for details") for c in cuts)]
    return out


class Model:
    """Weights of n-grams per class, on the driver: as many as the templates have n-grams. Class 0 is unknown."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: list[list[float]], bias: list[float], temperature: float):
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature = classes, vocabulary, weights, bias, temperature

    def gains(self) -> dict[str, list[float]]:
        """What each n-gram adds to the log-odds of each family against unknown, where it adds anything."""
        out = {g: [(x - w[0]) / self.temperature for x in w[1:]] for g, w in zip(self.vocabulary, self.weights)}
        return {g: w for g, w in out.items() if any(abs(x) > 1e-9 for x in w)}

    def start(self) -> list[float]:
        return [(b - self.bias[0]) / self.temperature for b in self.bias[1:]]


def fit(spark: SparkSession, paragraphs: DataFrame, p: Params | None = None) -> Model:
    """Fit on the templates and about ``sample`` of ``paragraphs`` (text), which count as unknown unless they match a template; of a
    longer one the first window is learned from."""
    p = p or Params()
    words = {f: [plain_words(t) for t in texts] for f, texts in TEMPLATES.items()}
    vocabulary = sorted({g for texts in words.values() for w in texts for n in NGRAMS for g in _grams(w, n)})
    classes = [UNKNOWN, *TEMPLATES]
    made = F.from_json(F.lit(json.dumps([{"text": t, "label": float(classes.index(f)), "held": h} for t, f, h in _examples()])),
                       "array<struct<text:string,label:double,held:boolean>>")
    given = spark.range(1).select(F.explode(made).alias("e")).select("e.*")
    total = max(1, paragraphs.count())
    bucket = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    others = paragraphs.where(bucket < int(min(1.0, p.sample / total) * (1 << 30))).select("text", F.lit(0.0).alias("label"), (F.pmod(bucket, F.lit(3)) == 1).alias("held"))
    known = _by_size(p)
    hits = _hits(F.col("text"), {n: sorted({g for g in vocabulary if len(g.split()) == n} | set(known.get(n, []))) for n in {*NGRAMS, *known}})
    near = lambda n: F.array_distinct(F.transform(F.filter("hits", lambda h: (h["size"] == n) & (h["at"] + h["size"] <= 3 * _span())), lambda h: h["gram"]))
    rows = cut(given.unionByName(others).select("label", "held", hits.alias("hits")), "examples")
    for n, grams in known.items():
        rows = rows.where((F.col("label") > 0) | ~F.arrays_overlap(near(n), F.lit(grams)))
    grams = rows.select("label", "held", F.concat(*[near(n) for n in NGRAMS]).alias("grams"))
    # no template n-gram at all is what most paragraphs look like
    grams = grams.unionByName(spark.range(64).select(F.lit(0.0).alias("label"), F.lit(False).alias("held"), F.array().cast("array<string>").alias("grams")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True).transform(cut(grams, "grams"))
    model = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=100).fit(vectors.where("not held"))
    held = model.transform(vectors.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))

    def loss(t: float) -> Column:
        top = F.array_max("raw")
        total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp((x - top) / t))
        return F.avg((top - F.get("raw", F.col("label").cast("int"))) / t + F.log(total))

    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    losses = held.agg(*[loss(t).alias(str(t)) for t in grid]).first()
    best = min(range(len(grid)), key=lambda i: losses[i] if losses[i] is not None else math.inf)
    return Model(classes[:model.numClasses], vocabulary, model.coefficientMatrix.toArray().T.tolist(), model.interceptVector.toArray().tolist(), grid[best])


def _odds(grams: Column, weight: dict[str, list[float]], start: list[float]) -> Column:
    """``start`` and the weights of those ``grams`` that have any, by family."""
    table = _literal(weight, "map<string,array<double>>")
    return F.aggregate(F.filter(grams, lambda g: g.isin(sorted(weight))), F.array(*[F.lit(float(x)) for x in start]),
                       lambda s, g: F.zip_with(s, F.element_at(table, g), lambda x, y: x + y))


def _chances(odds: Column) -> Column:
    return F.transform(odds, lambda x: F.lit(1.0) / (1.0 + F.exp(-x)))


def reach(model: Model) -> dict[str, list[float]]:
    """The most that a word adds to the log-odds of each family: gains above zero of the n-grams charged to it, each to its longest word.

    A window that has an n-gram has the word it is charged to. So the log-odds of a window are at most the start and the sum
    over its words, or over those of its whole text."""
    out: dict[str, list[float]] = {}
    for g, gain in model.gains().items():
        word = max(g.split(), key=lambda w: (len(w), w))
        out[word] = [x + max(y, 0.0) for x, y in zip(out.get(word, [0.0] * len(gain)), gain)]
    return {w: most for w, most in out.items() if any(most)}


def _gate(text: Column, model: Model, p: Params) -> Column:
    """Whether some window of a text might propose a family. False only where none can (the margin is for rounding)."""
    most = reach(model)
    words = F.array_intersect(_wordlist(text), F.lit(sorted(most)).cast("array<string>"))
    return F.array_max(_chances(_odds(words, most, [x + 1e-6 for x in model.start()]))) >= p.sure


def paragraphs_of(text: Column) -> Column:
    """The non-blank lines of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)


def _span() -> int:
    return max(len(plain_words(t)) for texts in TEMPLATES.values() for t in texts)


def windows(rows: DataFrame, known: dict[int, list[str]], text: str = "text") -> DataFrame:
    """The other columns, ``block``, ``window`` and ``hits`` for every window of the paragraphs of ``text`` that has known n-grams.

    Window k of a paragraph has its words from (k - 1) to (k + 2) times ``_span``; those of the middle third are in no other's middle.
    A paragraph is searched once; each hit then goes to the at most three windows that hold it, so a window's hits are bounded.
    """
    span, rest = _span(), [c for c in rows.columns if c != text]
    blocks = rows.select(*rest, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")).alias("block", "_text"))
    found = blocks.select(*rest, "block", F.explode_outer(_hits(F.col("_text"), known)).alias("h"))
    k = F.floor(F.col("h.at") / span).cast("int")
    inside = F.filter(F.array(k - 1, k, k + 1), lambda w: (w >= 0) & (w * span < F.col("h.of")) & (F.col("h.at") + F.col("h.size") <= (w + 2) * span))
    return (found.select(*rest, "block", "h", F.explode(F.when(F.col("h").isNotNull(), inside)).alias("window"))
            .groupBy(*rest, "block", "window").agg(F.sort_array(F.collect_list("h")).alias("hits")))


def searched(model: Model, p: Params) -> dict[int, list[str]]:
    """The n-grams of the model and the shingles of the templates by their number of words."""
    shingles, gains = _by_size(p), model.gains()
    return {n: sorted({g for g in gains if len(g.split()) == n} | set(shingles.get(n, []))) for n in {*NGRAMS, *shingles}}


def judged(found: DataFrame, model: Model, p: Params) -> DataFrame:
    """``windows`` that propose a family, with ``chance`` (its highest probability), ``families`` (confirmed), and the lines (block,
    line) that hold shingles of confirmed templates (``held``) or, in the middle, n-grams of the model (``named``)."""
    gains, start, span = model.gains(), model.start(), _span()
    rest = [c for c in found.columns if c != "hits"]
    known = _literal([{"family": model.classes.index(f), "grams": g} for f, _, g in _templates(p) if f in model.classes], "array<struct<family:int,grams:array<string>>>")
    names, place = F.array(*[F.lit(c) for c in model.classes]), lambda n: F.struct(F.col("block").alias("block"), n.alias("line"))

    def judge(h: Column) -> Column:
        def with_odds(grams: Column, odds: Column) -> Column:
            fits = F.filter(known, lambda t: (F.get(odds, t["family"] - 1) >= p.sure) & (F.size(F.array_intersect(grams, t["grams"])) >= p.share * F.size(t["grams"]) - 1e-9))

            def with_fits(fit: Column) -> Column:
                shingles = F.flatten(F.transform(fit, lambda t: t["grams"]))
                held = F.filter(h, lambda x: F.array_contains(shingles, x["gram"]))
                named = F.filter(h, lambda x: (x["at"] >= F.col("window") * span) & (x["at"] < (F.col("window") + 1) * span) & x["gram"].isin(sorted(gains)))
                return F.struct(F.array_max(odds).alias("chance"), F.array_distinct(F.transform(fit, lambda t: F.get(names, t["family"]))).alias("families"),
                                F.array_distinct(F.flatten(F.transform(held, lambda x: F.transform(F.sequence(x["first"], x["last"]), place)))).alias("held"),
                                F.array_distinct(F.transform(named, lambda x: place(x["first"]))).alias("named"))

            return _let(fits, with_fits)

        def with_grams(grams: Column) -> Column:
            return _let(_chances(_odds(grams, gains, start)), lambda odds: F.when(F.array_max(odds) >= p.sure, with_odds(grams, odds)))

        return _let(F.array_distinct(F.transform(h, lambda x: x["gram"])), with_grams)

    return found.select(*rest, F.explode(F.array(judge(F.col("hits")))).alias("j")).where("j is not null").select(*rest, "j.*")


def scan(docs: DataFrame, model: Model, p: Params | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, licenses, n_confirmed, n_unconfirmed, best) for every row of ``docs`` (doc_id, text).

    ``n_paragraphs``: non-blank lines. ``licenses``: sorted families that a window proposes and a template confirms; a notice may be
    wrapped over lines, up to a blank one, and a line may state several. ``n_confirmed``: lines that hold shingles of a confirmed
    notice; ``n_unconfirmed``: other lines whose n-grams lie in the middle of a window that proposes a family; ``best``: the
    highest probability of a proposed family, null for none. The windows of a text are judged unless its words cannot reach ``sure``.
    Null and empty texts have no lines. Rows stay apart, repeated ones and those without a doc_id as well; other columns are
    ignored; equal probabilities propose together.
    """
    p = p or Params()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.size(paragraphs_of(F.col("text"))).cast("long").alias("n_paragraphs"))
    rows = cut(rows.select("doc_id", "n_paragraphs", F.when(_gate(F.col("text"), model, p), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")), "candidates")
    loud = rows.where("text is not null")
    places = "array<struct<block:int,line:int>>"
    none = [F.lit(None).cast(k).alias(c) for c, k in {"chance": "double", "families": "array<string>", "held": places, "named": places}.items()]
    every = loud.select("row", "doc_id", "n_paragraphs", *none)
    seen = judged(windows(loud, searched(model, p)), model, p).select(*every.columns)
    both = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    found = every.unionByName(seen).groupBy("row", "doc_id", "n_paragraphs").agg(
        F.array_sort(both("families")).alias("licenses"), both("held").alias("held"), both("named").alias("named"), F.max("chance").alias("best"))
    quiet = rows.where("text is null").select("doc_id", "n_paragraphs", F.array().cast("array<string>").alias("licenses"), *[
        F.lit(0).cast("long").alias(c) for c in ("n_confirmed", "n_unconfirmed")], F.lit(None).cast("double").alias("best"))
    return quiet.unionByName(found.select("doc_id", "n_paragraphs", "licenses", F.size("held").cast("long").alias("n_confirmed"),
                                          F.size(F.array_except("named", "held")).cast("long").alias("n_unconfirmed"), "best"))
