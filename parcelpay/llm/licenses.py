"""Licence paragraphs: word n-gram logistic regression, a calibrated unknown class, and template comparison.

The model is trained by Spark ML on varied template paragraphs against a bounded sample of the corpus's own paragraphs.
Its features are the word n-grams of the templates that the sample hardly uses, so a paragraph without any feature word
scores as no licence; such paragraphs are passed over before n-grams are made. Every line is scored, and every run of
neighbouring lines (or of pieces of long lines) up to a blank line that can be confirmed; of runs that overlap the one
most similar to its template stays. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelpay.llm.common import Store

#: Short statements by which texts name their licence, by family.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "LGPL": ("Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "BSD": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "reserved": ("All rights reserved.", "Copyright holder. All rights reserved. No part of this publication may be reproduced without permission."),
}
NONE, UNKNOWN = "none", "unknown"
SAMPLE_PARAGRAPHS = 3000
COMMON_SHARE = 0.01
CONFIRM = 0.6
RIDGE = 0.002
#: Lines longer than this many words are also scored in pieces; a run has as many words as the longest template and a
#: piece too many on either side.
PIECE_WORDS = 16
#: Pieces of a text that are searched for runs in one row.
BLOCK_PIECES = 512


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct words, pairs and triples of neighbouring words."""
    def follow(runs: Column, n: int) -> Column:
        later = F.slice(words, n, F.greatest(F.size(words), F.lit(0)))
        return F.filter(F.zip_with(runs, later, lambda a, w: F.concat(a, F.lit(" "), w)), lambda g: g.isNotNull())

    pairs = follow(words, 2)
    return F.array_distinct(F.concat(words, pairs, follow(pairs, 3)))


def _constant(strings: list[str]) -> Column:
    return F.split(F.lit("\x1f".join(strings)), "\x1f")


def _may_hold(text: Column, words: list[str]) -> Column:
    """Whether a text holds some of the words, as parts of longer ones too: tried before a text is cut into words.

    The words share their first letters in the pattern, and a match starts where no letter or digit is before it, as
    every word does that starts with one; so nothing is passed over that has one of the words.
    """
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""  # what follows need not match
        parts = [("\\" + c if not c.isalnum() else c) + pattern(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])" + pattern(trie)) if words else F.lit(False)


def paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (its number in the text, from 0) and body of every line that is not blank."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("paragraph", "body")).where(F.trim("body") != "")


def _least_words(grams: list[str]) -> int:
    """Different words without which a text has less than ``CONFIRM`` of the n-grams: every n-gram ends in one word."""
    ends = Counter(g.rsplit(" ", 1)[-1] for g in grams)
    found = 0
    for n, (_, k) in enumerate(ends.most_common(), 1):
        found += k
        if found >= CONFIRM * len(grams):
            return n
    return len(ends)


def _runs(docs: DataFrame, templates: list[list[str]], features: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, paragraph, key, first, last and words of the runs of two or more pieces that could be confirmed.

    ``paragraph`` is the line a run starts in; ``first`` and ``last`` number its pieces by line and place in the line.
    """
    single = [sorted({g for g in t if " " not in g}) for t in templates]
    longest = max(len([g for g in t if g.count(" ") == 2]) + 2 for t in templates) + 2 * PIECE_WORDS

    def possible(words: Column) -> Column:
        return reduce(or_, [F.size(F.array_intersect(_constant(w), words)) >= _least_words(t) for w, t in zip(single, templates, strict=True)])

    def pieces(line: Column, i: Column) -> Column:
        words = words_of(line)
        each = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(words), F.lit(1)) - 1) / PIECE_WORDS).cast("int")), lambda j: F.struct(F.shiftleft(i.cast("long"), 24) + j, F.slice(words, j * PIECE_WORDS + 1, PIECE_WORDS)))
        return each.cast("array<struct<at:bigint,w:array<string>>>")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(_may_hold(text, features))
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.flatten(F.transform(F.split(text, "\n"), pieces)).alias("pieces"))
    starts = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / BLOCK_PIECES).cast("int"))
    rows = rows.select("doc_id", "key", F.explode(F.transform(starts, lambda b: F.slice("pieces", b * BLOCK_PIECES + 1, BLOCK_PIECES + longest))).alias("pieces"))
    rows = rows.where(F.arrays_overlap(F.flatten(F.transform("pieces", lambda u: u["w"])), _constant(features)))

    # The pieces from each start up to a line without words or the bound.
    def more(state: Column, u: Column) -> Column:
        n = state["n"] + F.size(u["w"])
        going = state["going"] & (F.size(u["w"]) > 0) & (n <= longest)
        return F.struct(going.alias("going"), F.when(going, n).otherwise(state["n"]).alias("n"), (state["m"] + going.cast("int")).alias("m"))

    def window(i: Column) -> Column:
        near = F.slice("pieces", i + 1, longest)
        zero = F.struct(F.lit(True).alias("going"), F.lit(0).alias("n"), F.lit(0).alias("m"))
        return F.slice("pieces", i + 1, F.aggregate(near, zero, more)["m"])

    windows = F.transform(F.sequence(F.lit(0), F.least(F.size("pieces"), F.lit(BLOCK_PIECES)) - 1), window)
    rows = rows.select("doc_id", "key", F.explode(windows).alias("run")).where(F.size("run") > 1)
    words = F.flatten(F.transform("run", lambda u: u["w"]))
    rows = rows.withColumn("all", words).where(F.arrays_overlap("all", _constant(features)) & possible(F.col("all"))).drop("all")
    rows = rows.select("doc_id", "key", F.explode(F.transform(F.sequence(F.lit(2), F.size("run")), lambda m: F.slice("run", 1, m))).alias("run"))
    rows = rows.select("doc_id", F.shiftright(F.col("run")[0]["at"], 24).cast("int").alias("paragraph"), "key", F.col("run")[0]["at"].alias("first"), F.element_at("run", -1)["at"].alias("last"), words.alias("words"))
    return rows.where(F.arrays_overlap("words", _constant(features)) & possible(F.col("words")))


def _best_runs(rows: DataFrame) -> DataFrame:
    """Of runs that overlap in a text the best: confirmed, most similar, fewest words. Runs are taken from the best on."""
    text = ["doc_id", "key"]
    before = Window.partitionBy(*text).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1))).cast("int")
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(Window.partitionBy(*text).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    out = ["paragraph", "family", "probability", "similarity", "confirmed"]
    rank = F.struct((~F.col("confirmed")).alias("a"), (-F.col("similarity")).alias("b"), F.col("n_words").alias("c"), (-F.col("probability")).alias("d"), "first", "last", *out)
    islands = rows.groupBy(*text, "island").agg(F.sort_array(F.collect_list(rank)).alias("runs"))
    kept = F.aggregate("runs", F.slice("runs", 1, 0), lambda k, r: F.when(F.exists(k, lambda o: (o["first"] <= r["last"]) & (r["first"] <= o["last"])), k).otherwise(F.concat(k, F.array(r))))
    return islands.select("doc_id", F.explode(kept).alias("r")).select("doc_id", *[F.col(f"r.{c}").alias(c) for c in out])


def _variants(text: str) -> list[str]:
    """The statement itself, without each single word, and with words of a sentence around it."""
    w = text.split()
    cut = [" ".join(w[:i] + w[i + 1 :]) for i in range(len(w))] if len(w) > 3 else []
    return [text, text.lower(), text.upper(), f"Note: {text}", f"{text} See the file for details.", *cut]


@dataclass
class LicenseModel:
    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    words: list[str]
    temperature: float
    cut: float


def train_licenses(docs: DataFrame, *, sample: int = SAMPLE_PARAGRAPHS, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Train on the templates' variants and at most ``sample`` different paragraphs without any template triple.

    A fifth of the rows is held out: the temperature minimises their log loss, and ``cut`` is the probability that
    98 % of the held-out family rows that are classed rightly reach; below it a licence is of the unknown class.
    """
    spark = docs.sparkSession
    families = [*TEMPLATES, NONE]
    rows = [(v, float(families.index(f))) for f, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    made = spark.createDataFrame(rows, "body string, label double")
    triples = made.select(F.explode(F.filter(grams_of(words_of(F.col("body"))), lambda g: F.size(F.split(g, " ")) == 3)).alias("g")).distinct()
    known = [r["g"] for r in triples.collect()]
    store = Store(spark)
    bodies = paragraphs(docs, id_col=id_col, text_col=text_col).select("body")
    share = min(1.0, 2.0 * sample / max(1, bodies.agg(F.approx_count_distinct(F.xxhash64("body"))).first()[0]))
    some = store.put(bodies.where(F.pmod(F.xxhash64("body"), F.lit(1_000_000_000)) < int(1_000_000_000 * share)).distinct(), "sample")
    other = some.where(~F.arrays_overlap(grams_of(words_of(F.col("body"))), _constant(known))).orderBy(F.xxhash64("body"), "body").limit(sample)
    data = made.unionByName(other.withColumn("label", F.lit(float(len(TEMPLATES))))).withColumn("grams", grams_of(words_of(F.col("body"))))
    data = store.put(data.coalesce(2), "training").withColumn("held", F.pmod(F.xxhash64("body", F.lit(4)), F.lit(5)) == 0)
    counts = data.where("label < %d" % len(TEMPLATES)).select(F.explode("grams").alias("g")).distinct()
    common = data.where("label = %d" % len(TEMPLATES)).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > COMMON_SHARE * sample)
    vocabulary = sorted(r["g"] for r in counts.join(common, "g", "left_anti").collect())
    single = {g for g in vocabulary if " " not in g}
    vocabulary = [g for g in vocabulary if any(w in single for w in g.split(" "))]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", 1.0)
    ready = counted.transform(data)
    fitted = LogisticRegression(family="multinomial", regParam=RIDGE, maxIter=40).fit(ready.where("not held"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    held = [(r["label"], r["rawPrediction"].toArray()) for r in fitted.transform(ready.where("held")).select("label", "rawPrediction").collect()]

    def chance(raw, t: float, k: int) -> float:
        top = max(raw)
        e = [math.exp((x - top) / t) for x in raw]
        return e[k] / sum(e)

    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    temperature = min(grid, key=lambda t: -sum(math.log(max(1e-12, chance(raw, t, int(y)))) for y, raw in held)) if held else 1.0
    right = sorted(chance(raw, temperature, int(y)) for y, raw in held if int(y) < len(TEMPLATES) and raw.argmax() == int(y))
    cut = right[int(0.02 * len(right))] if right else 0.5
    return LicenseModel(families, [float(b) for b in bias], {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary)}, sorted(single), temperature, float(cut))


def scan_licenses(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of lines that reads as a licence (``paragraph``: its first line): doc_id, paragraph, family, probability, similarity, confirmed.

    A licence whose best family stays below the calibrated cut is ``unknown``. ``similarity`` is the share of the
    n-grams of the family's nearest template that the paragraph has; ``confirmed`` asks for ``CONFIRM``. Null and empty
    texts have no paragraphs; rows repeating id and text give one result. Other columns are ignored.
    """
    spark, names, n = docs.sparkSession, model.families, len(model.families)
    # One row per feature: bounded by the templates.
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    by_family = {family: [x.split("\x1f") for x in _template_grams(spark, family)] for family in names[:-1]}
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(_may_hold(text, model.words))
    lines = lines.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("paragraph", "body"))
    lines = lines.where(_may_hold(F.col("body"), model.words))
    lines = lines.withColumn("words", words_of(F.col("body"))).where(F.arrays_overlap("words", _constant(model.words)))
    at = F.shiftleft(F.col("paragraph").cast("long"), 24)
    lines = lines.select("doc_id", "paragraph", "key", at.alias("first"), (at + (1 << 24) - 1).alias("last"), "words")
    runs = _runs(docs, [t for ts in by_family.values() for t in ts], model.words, id_col, text_col)
    rows = lines.withColumn("line", F.lit(True)).unionByName(runs.withColumn("line", F.lit(False))).withColumn("grams", grams_of(F.col("words")))
    similar = [F.array_max(F.array(*[F.size(F.array_intersect(_constant(t), F.col("grams"))) / len(t) for t in ts])) for ts in by_family.values()]
    rows = rows.withColumn("similar", F.array(*similar)).where(F.col("line") | (F.array_max("similar") >= CONFIRM))
    known = F.array_intersect("grams", _constant(list(model.weights)))
    run = ["doc_id", "key", "first", "last", "paragraph"]
    each = rows.select(*run, "similar", F.size("words").alias("n_words"), F.posexplode(known).alias("nth", "gram")).join(weights, "gram")
    copies = F.count_if(F.col("nth") == 0)  # rows repeating id and text
    sums = each.groupBy(*run).agg(F.first("similar").alias("similar"), F.first("n_words").alias("n_words"), *[(F.sum(F.col("w")[i]) / copies + model.bias[i]).alias(f"s{i}") for i in range(n)])
    scores = [F.col(f"s{i}") for i in range(n)]
    chances = [F.exp((s - F.greatest(*scores)) / model.temperature) for s in scores]
    total = sum(chances[1:], chances[0])
    rows = sums.withColumn("p", F.array(*[c / total for c in chances])).where(F.col("p")[n - 1] < 0.5)
    licence = F.slice("p", 1, n - 1)
    rows = rows.withColumn("probability", F.array_max(licence)).withColumn("guess", F.array_position(licence, F.col("probability")).cast("int"))
    rows = rows.withColumn("similarity", F.element_at("similar", F.col("guess")))
    family = F.when(F.col("probability") >= model.cut, F.element_at(F.lit(names), F.col("guess"))).otherwise(UNKNOWN)
    return _best_runs(rows.select(*run, "n_words", family.alias("family"), "probability", "similarity", ((F.col("probability") >= model.cut) & (F.col("similarity") >= CONFIRM)).alias("confirmed"))).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")


def _template_grams(spark: SparkSession, family: str) -> list[str]:
    rows = spark.createDataFrame([(t,) for t in TEMPLATES[family]], "t string").select(grams_of(words_of(F.col("t"))).alias("g"))
    return ["\x1f".join(r["g"]) for r in rows.collect()]
