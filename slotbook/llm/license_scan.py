"""License scans with a trained paragraph classifier, DataFrame operations only.

Paragraphs are the lines of a text; their words are ``[a-z0-9.]+`` after
lower-casing, features are their word 1-, 2- and 3-grams.

1. **Training set**: notices of each license family, notices of other or no
   named license (family ``unknown``), plain sentences (``none``), and as ``none`` the documents' own
   paragraphs with a marker that hold no template's wording: ``SAMPLE`` of them at most, by hash, from
   ``SAMPLE`` different texts, whole, by hash.
2. **Classifier**: softmax regression over sparse features.  Only n-grams with a
   *marker* count: a notice word that at most ``COMMON`` of the paragraphs of all documents (without a
   template's wording) hold.  Each gradient
   step is a join of features and weights and two aggregates.
3. **Calibration**: a temperature on the notices' own leave-one-word-out variants; below
   ``SURE`` a paragraph's family is not asserted.
4. **Scan**: a paragraph without any marker has no feature and is ``none``, so only the
   others are cut into n-grams.  A predicted family is confirmed if the
   paragraph holds at least ``CONFIRM`` of the 3-grams of one of that family's
   notices; else the paragraph is an ``unknown`` license.

Defined results: null and empty texts have no paragraphs and license ``none``; several
families are listed in alphabetical order; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of public license notices, by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
               "This project is released under the Apache License 2.0"],
    "mit": ["Released under the MIT License",
            "Licensed under the MIT license",
            "This software is distributed under the terms of the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3",
            "This work is licensed under the GNU General Public License, version 2",
            "Released under the GNU General Public License",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1",
             "Released under the GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3",
             "Released under the GNU Affero General Public License"],
    "bsd": ["Released under the BSD License",
            "Licensed under the BSD 3-Clause License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
            "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by": ["Licensed under CC BY 4.0",
              "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0",
            "Released under CC0 1.0 Universal"],
    "unknown": ["Licensed under the terms of the license agreement",
                "This work is licensed under a proprietary license",
                "Released under the Community License, version 1.1",
                "All rights reserved. No part of this publication may be reproduced without prior written permission",
                "Copyright 2020 the authors. All rights reserved",
                "Use of this software is subject to the end user license agreement"],
    "none": ["The driver was asked to show a license at the border",
             "She holds a master of science from MIT and a degree in law",
             "The source of the river lies under the mountain",
             "A new version of the report was released in public",
             "Software engineers work in general on documentation and code",
             "The person asked for permission to use the work free of charge"],
}
SAMPLE = 4_000    # different texts, and paragraphs of theirs, that are examples of none
COMMON = 0.01
STEPS, RATE = 12, 4.0
SURE, CONFIRM = 0.5, 0.75
FAMILIES = list(NOTICES)
NONE = FAMILIES.index("none")
_BREAK = r"[^a-z0-9.]+"


def _words(text):
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: (w != "") & (w != "."))


def _trim(w):
    """A word without the dots that end it; trimming takes far longer than looking whether there are any."""
    return F.when(w.endswith("."), F.rtrim(w, F.lit("."))).otherwise(w)


def _trimmed(words):
    return F.transform(words, _trim)


def _paragraphs(docs: DataFrame) -> DataFrame:
    """The words of each paragraph that has any.  They come out of the generator as a column of its own: a
    condition on a projected column is moved below it, with the cutting of the text in each of its places,
    so the text would be cut again for every 3-gram."""
    cut = F.transform(F.split("text", "\n"), lambda x: _trimmed(_words(x)))
    return docs.select(F.explode(cut).alias("words")).filter(F.size("words") > 0)


def _grams(words, n: int):
    """Word n-grams of an array column, joined by blanks."""
    last = F.size(words) - n + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def _features(words):
    return F.array_distinct(F.concat(*[_grams(words, n) for n in (1, 2, 3)]))


def _has_marker(markers: list[str]):
    """A list of literals is hashed once a plan; an array of them would be hashed again for every row."""
    return lambda words: F.exists(words, lambda w: w.isin(markers))


def _holds(words, grams: list[str]):
    """Whether the words hold one of the 3-grams; most places end at their first word."""
    first, second, third = (sorted({g.split()[k] for g in grams}) for k in range(3))

    def begins(w, i):
        two, three = F.get(words, i + 1), F.get(words, i + 2)
        return w.isin(first) & two.isin(second) & three.isin(third) & F.concat_ws(" ", w, two, three).isin(grams)

    return F.size(F.filter(words, begins)) > 0


class Model:
    """Markers, feature weights (one a family) and the temperature."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        notices = spark.createDataFrame([(f"{i}", i_family, t) for i_family, f in enumerate(FAMILIES)
                                         for i, t in enumerate(NOTICES[f])], "name string, family int, text string")
        notices = notices.select("family", _trimmed(_words(F.col("text"))).alias("words"))
        grams = [tuple(r) for r in notices.filter(F.col("family") != NONE).select("family", _grams(F.col("words"), 3).alias("g")).collect()]
        self.templates = [(FAMILIES[f], g) for f, g in grams if FAMILIES[f] != "unknown" and g]
        vocabulary = sorted({w for _, g in grams for x in g for w in x.split()})
        # in how many paragraphs that hold no wording of a notice each word of the notices occurs; "" counts them all
        own = F.array_distinct(F.filter(F.col("words"), lambda w: w.isin(vocabulary)))
        worded = _holds(F.col("words"), sorted({x for _, g in grams for x in g}))
        paragraphs = _paragraphs(docs).filter(~worded).withColumn("own", own)
        seen = dict(paragraphs.select(F.explode(F.concat(F.array(F.lit("")), "own")).alias("w")).groupBy("w").count().collect())
        n = seen.pop("", 0)
        self.markers = [w for w in vocabulary if seen.get(w, 0) <= max(1, COMMON * n) and len(w) > 1 and not w.isdigit()]
        has = _has_marker(self.markers)
        # examples of plain text: hashes first, so only the texts below the last one move
        hashed = docs.filter("text is not null").select(F.xxhash64("text").alias("h"), "text")
        last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        plain = (hashed.filter(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"])
                 .transform(_paragraphs).filter(has(F.col("words"))).filter(~worded)
                 .distinct().orderBy(F.xxhash64("words")).limit(SAMPLE))
        variants = notices.select("family", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.filter(F.col("words"), lambda w, j: j != i))).alias("words"))
        examples = (notices.withColumn("check", F.lit(False)).unionByName(variants.withColumn("check", F.pmod(F.xxhash64("words"), F.lit(3)) == 0))
                    .unionByName(plain.select(F.lit(NONE).alias("family"), "words", F.lit(False).alias("check"))))
        examples = examples.withColumn("id", F.xxhash64("words", "family")).dropDuplicates(["id"])
        rows = (examples.select("id", "family", "check", F.explode(_features(F.col("words"))).alias("feature"))
                .filter(has(F.split("feature", " "))).unionByName(examples.select("id", "family", "check", F.lit("").alias("feature")))
                .coalesce(4).persist(StorageLevel.MEMORY_AND_DISK))
        self.weights = {"": [0.0] * len(FAMILIES)}  # "" is the bias
        size = max(1, rows.filter("not check").select("id").distinct().count())
        for step in range(STEPS):
            scores = self._probabilities(rows.filter("not check"), ["id", "family"])
            miss = scores.select("id", *[(F.col(f"p{i}") - (F.col("family") == i).cast("double")).alias(f"p{i}") for i in range(len(FAMILIES))])
            got = (rows.filter("not check").join(miss, "id").groupBy("feature")
                   .agg(*[F.sum(f"p{i}") for i in range(len(FAMILIES))]).collect())  # features of the notices
            for feature, *grad in got:
                w = self.weights.setdefault(feature, [0.0] * len(FAMILIES))
                for i, g in enumerate(grad):
                    w[i] -= RATE * g / math.sqrt(size) / math.sqrt(step + 1)
        logits = [tuple(r) for r in self._logits(rows.filter("check"), ["id", "family"]).drop("id").collect()]  # variants of the notices

        def loss(t):
            out = 0.0
            for family, *s in logits:
                top = max(s)
                out += math.log(sum(math.exp((x - top) / t) for x in s)) - (s[family] - top) / t
            return out

        self.temperature = min([0.25 * 1.25**k for k in range(16)], key=loss) if logits else 1.0
        rows.unpersist()

    def _table(self, spark):
        return spark.createDataFrame([(f, *w) for f, w in self.weights.items()],
                                     "feature string, " + ", ".join(f"w{i} double" for i in range(len(FAMILIES))))

    def _logits(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Sums of weights over the (keys, feature) rows; the table is bounded by the notices."""
        return (rows.join(F.broadcast(self._table(rows.sparkSession)), "feature").groupBy(*keys)
                .agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(FAMILIES))]))

    def _probabilities(self, rows: DataFrame, keys: list[str], temperature: float = 1.0) -> DataFrame:
        k = range(len(FAMILIES))
        top = F.greatest(*[F.col(f"s{i}") for i in k])
        e = self._logits(rows, keys).withColumn("top", top).select(
            *keys, *[F.exp((F.col(f"s{i}") - F.col("top")) / temperature).alias(f"e{i}") for i in k])
        whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
        return e.withColumn("whole", whole).select(*keys, *[(F.col(f"e{i}") / F.col("whole")).alias(f"p{i}") for i in k])

    def scan(self, docs: DataFrame) -> DataFrame:
        """One row a document: doc_id, n_paragraphs, n_licensed, license, confidence, families."""
        has = _has_marker(self.markers)
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        # a text without any marker word is not cut into paragraphs
        any_marker = F.exists(F.split(F.lower("text"), _BREAK), lambda w: _trim(w).isin(self.markers))
        marked = F.when(any_marker, F.filter(lines, lambda x: has(_trimmed(_words(x)))))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(F.size(lines), F.lit(0)).alias("n_paragraphs"), marked.alias("marked"))
        rows = rows.withColumn("n_paragraphs", F.greatest("n_paragraphs", F.lit(0)))
        each = rows.select("row", "doc_id", "n_paragraphs", F.posexplode_outer("marked").alias("place", "text"))
        each = each.withColumn("words", _trimmed(_words(F.col("text"))))
        for i, (_, g) in enumerate(self.templates):
            share = F.size(F.array_intersect(_grams(F.col("words"), 3), F.array(*[F.lit(x) for x in g]))) / float(len(set(g)))
            each = each.withColumn(f"t{i}", F.when(F.col("text").isNotNull(), share >= CONFIRM).otherwise(False))
        by = {f: [i for i, (x, _) in enumerate(self.templates) if x == f] for f in FAMILIES}
        confirmed = F.filter(F.array(*[F.when(sum((F.col(f"t{i}").cast("int") for i in at), F.lit(0)) > 0, F.lit(f))
                                       for f, at in by.items() if at]), lambda x: x.isNotNull())
        each = each.withColumn("confirmed", confirmed)
        keys = ["row", "doc_id", "n_paragraphs", "place", "confirmed"]
        # the bias row keeps texts without a marked paragraph
        cut = F.concat(F.array(F.lit("")), F.coalesce(_features(F.col("words")), F.array().cast("array<string>")))
        features = each.select(*keys, F.explode(cut).alias("feature"))
        scored = self._probabilities(features, keys, self.temperature)
        licensed = 1 - F.col(f"p{NONE}")
        top = F.greatest(*[F.col(f"p{i}") for i in range(len(FAMILIES)) if i != NONE])
        family = F.coalesce(*[F.when(F.col(f"p{i}") == F.col("best"), F.lit(f)) for i, f in enumerate(FAMILIES) if i != NONE])
        scored = (scored.withColumn("licensed", licensed).withColumn("best", top).withColumn("family", family)
                  .withColumn("family", F.when(F.col("place").isNull() | (F.col("licensed") < SURE), F.lit(None))
                              .when((F.col("best") >= SURE * F.col("licensed")) & F.array_contains("confirmed", F.col("family")), F.col("family"))
                              .otherwise(F.lit("unknown"))))
        return (scored.groupBy("row", "doc_id", "n_paragraphs").agg(
            F.count("family").alias("n_licensed"), F.array_sort(F.collect_set("family")).alias("families"),
            F.max(F.when(F.col("family").isNotNull(), F.col("licensed"))).alias("confidence"))
            .select("doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "n_licensed",
                    F.when(F.size("families") > 0, F.array_join("families", ",")).otherwise("none").alias("license"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence")))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_paragraphs, n_licensed, license, confidence."""
    texts = docs.select("doc_id", "text")
    return Model(texts).scan(texts)
