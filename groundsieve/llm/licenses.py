"""Licence scan of paragraphs (lines) in DataFrame functions only.

A multinomial logistic regression over sparse word uni- and bigrams names a paragraph's licence family. It is fitted with
Spark's own estimator on notices of the known families, on parts of them, and on a bounded sample of the corpus's own
paragraphs as ``none``. A line of which ``PIECE`` of the words stand in one notice is not taken as ``none``: it may be a
piece of a notice. ``unknown`` is calibrated: on parts of notices left out of the fit, the accepted probability is set so that all but ``MISSED`` of them pass, and on ordinary lines left out, the floor is set that none of them passes; a
paragraph above the floor but below the accepted probability is ``unknown``. A named family also has to be
confirmed by its templates: the share of a template's words found in the paragraph must reach ``CONFIRM``.

Scoring reads whole texts. Only words with a positive licence weight can lift a paragraph above ``none``, so paragraphs
without any such word need no further work; the others' terms meet the weights (bounded by the notices) in a broadcast join.
Null and empty texts have no paragraph; equal rows give equal results (rows are numbered, never joined by id); an empty
table gives an empty table.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NONE, UNKNOWN = "none", "unknown"
SAMPLE, MISSED, CONFIRM, PIECE = 2_000, 0.05, 0.5, 0.8
#: Short public notices by licence family.
NOTICES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL": ["Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 public domain dedication"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright, all rights reserved, proprietary and confidential."],
}
WORD = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def terms(text: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    both = F.transform(F.array(words(text)), lambda w: F.array_distinct(F.concat(
        w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        .otherwise(F.array().cast("array<string>")))))
    return F.element_at(both, 1)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: the other columns, ``paragraph`` (from 0) and ``line``."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph", "line")).where("trim(line) <> ''")


def examples(spark: SparkSession) -> DataFrame:
    """(family, line, held_out): every notice, and its parts; the odd parts are left out of the fit."""
    rows = []
    for family, notices in NOTICES.items():
        for notice in notices:
            w = notice.split()
            rows += [(family, notice, False)] * 4
            size = max(4, 2 * len(w) // 3)
            for k, a in enumerate(range(0, max(1, len(w) - size + 1), max(1, len(w) // 6))):
                rows.append((family, " ".join(w[a : a + size]), k % 2 == 1))
            rows.append((family, f"{notice} See the file for details.", True))
    return spark.createDataFrame(rows, "family string, line string, held_out boolean")


class Model:
    """Weights by term, biases, the accepted probability of a family and the least probability of any licence."""

    def __init__(self, classes: list[str], weights: DataFrame, bias: list[float], cues: list[str], accepted: float = 0.0):
        self.classes, self.weights, self.bias, self.cues, self.accepted = classes, weights, bias, cues, accepted
        self.floor = 0.5  # of the probability of being any licence

    def scored(self, rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
        """``keys`` and ``p``: probabilities in order of ``classes``, as sparse dot products of the terms."""
        found = rows.select(*keys, F.explode(terms(F.col(line))).alias("term")).join(F.broadcast(self.weights), "term", "left")
        sums = found.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(self.classes))])
        logits = F.array(*[F.col(f"s{k}") + F.lit(b) for k, b in enumerate(self.bias)])
        shifted = sums.select(*keys, F.transform(F.array(logits), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0].alias("e"))
        total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
        return shifted.select(*keys, F.transform(F.array(total), lambda t: F.transform("e", lambda x: x / t))[0].alias("p"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the notices and on at most ``sample`` lines of ``docs`` (doc_id, text), picked by hash, as ``none``."""
    spark = docs.sparkSession
    notices = examples(spark)
    known = F.array(*[F.lit(w) for w in sorted({"license", "licence", "licensed", "copyright", "redistribution", "permission"})])
    share = min(1.0, 2.0 * sample / max(1, docs.count()))
    some = lines(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share).select("doc_id", "text"))
    # nor may a line count as plain whose words are nearly all a notice's: it may be a piece of one
    own = F.array(*[F.array(*[F.lit(w) for w in sorted(set(_plain(n)))]) for f in sorted(NOTICES) for n in NOTICES[f]])
    said = F.array_distinct(words(F.col("line")))
    piece = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(t, said)))) >= F.lit(PIECE) * F.size(said)
    plain = some.where(~F.arrays_overlap(words(F.col("line")), known)).orderBy(F.xxhash64("line"), "line").limit(sample).where(~piece).select(
        F.lit(NONE).alias("family"), "line", (F.pmod(F.xxhash64("line"), F.lit(3)) == 0).alias("held_out"))
    classes = [NONE, *sorted(NOTICES)]
    index = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))])
    rows = notices.union(plain).withColumns({"label": index[F.col("family")], "terms": terms(F.col("line"))}).cache()
    vocabulary = sorted({r.t for r in rows.where(F.col("family") != NONE).select(F.explode("terms").alias("t")).distinct().collect()})  # bounded by NOTICES
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features").setBinary(True)
    counts = {r.family: r.n for r in rows.groupBy("family").agg(F.count("*").alias("n")).collect()}
    balance = F.when(F.col("family") == NONE, F.lit(2.0 * len(classes) * 8 / max(1, counts.get(NONE, 1)))).otherwise(F.lit(1.0))
    fitted = LogisticRegression(regParam=0.002, maxIter=60, family="multinomial", weightCol="weight").fit(
        vector.transform(rows.where(~F.col("held_out"))).withColumn("weight", balance).select("features", "label", "weight"))
    coefficients, bias = fitted.coefficientMatrix.toArray(), list(fitted.interceptVector.toArray())
    # adding one number to all classes changes no probability: none's weights become 0
    relative = coefficients - coefficients[:1]
    weights = spark.createDataFrame([(t, [float(x) for x in relative[:, k]]) for k, t in enumerate(vocabulary)], "term string, w array<double>")
    cues = [t for k, t in enumerate(vocabulary) if relative[1:, k].max() > 0 and " " not in t]
    model = Model(classes, weights, [float(b - bias[0]) for b in bias], cues)
    left_out = rows.where("held_out").withColumns({"k": F.col("label").cast("int"), "row": F.monotonically_increasing_id()})
    right = model.scored(left_out.select("row", "k", "line"), ["row", "k"])
    accepted = F.percentile(F.when(F.col("k") > 0, F.element_at("p", F.col("k") + 1)), F.lit(MISSED))
    levels = right.agg(accepted.alias("accepted"), F.max(F.when(F.col("k") == 0, 1 - F.col("p")[0])).alias("noise")).first()
    model.accepted, model.floor = float(levels.accepted or 0.0), max(0.5, float(levels.noise or 0.0))
    rows.unpersist()
    return model


def scan(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, paragraph, family, probability, likeness: one row per paragraph that holds a licence."""
    cues = F.array(*[F.lit(c) for c in model.cues])
    hit = lambda c: F.arrays_overlap(words(F.col(c)), cues)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *keep, "text").where(hit("text"))
    found = lines(numbered).where(hit("line"))
    scored = model.scored(found, [*keep, "row", "paragraph", "line"])
    best = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*[F.lit(c) for c in model.classes])
    rows = scored.select(*keep, "paragraph", "line", F.element_at(names, best).alias("top"), F.array_max("p").alias("probability"), (1 - F.col("p")[0]).alias("licence"))
    rows = rows.where(F.col("licence") > model.floor)
    templates = F.create_map(*[x for f, notices in NOTICES.items() for x in (F.lit(f), F.array(*[F.array(*[F.lit(w) for w in sorted(set(_plain(n)))]) for n in notices]))])
    share = F.array_max(F.transform(templates[F.col("top")], lambda t: F.size(F.array_intersect(t, words(F.col("line")))) / F.size(t)))
    rows = rows.withColumn("likeness", F.coalesce(share, F.lit(0.0)))
    sure = (F.col("probability") >= model.accepted) & (F.col("likeness") >= CONFIRM) & (F.col("top") != NONE)
    return rows.select(*keep, "paragraph", F.when(sure, F.col("top")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "likeness")


def _plain(notice: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in notice.lower()).split() if w]
