"""Licence scan: a trained paragraph classifier, a calibrated unknown class, and template confirmation.

Paragraphs are what stands between blank lines; the lines inside are joined, so wrapped notices are whole. They are
read in overlapping word windows of several sizes, so that the words around a notice do not outvote it; paragraphs up to the
largest size are read whole as well. Windows are turned into word 1- and 2-grams. A multinomial logistic regression over these
sparse features gives each family a logit. It is trained on licence templates and thinned copies of them, and, as ordinary
text, on windows of a sample of the corpus, as they are and with some words of templates put in, so that a mention of
a licence is no licence. A temperature fitted on other thinned copies turns logits into probabilities. A
window whose best family is under ``least`` is ``unknown``. The prediction is confirmed if the window and one of that family's
templates share ``overlap`` of either's n-grams; otherwise it becomes ``unknown`` too. A window taken for ordinary
text that holds ``overlap`` of a template's n-grams is ``unknown`` as well; a part of a paragraph that is not confirmed
counts from ``least`` on. Of windows that overlap, the one that matches its template best stands, and a paragraph has one
row for each family found in it.

Every window that can give a row is scored. That takes either most of a template or a guess other than ordinary text. Anchors
are chosen from each template's words, the rarest in ordinary text first, until the n-grams without one are fewer than
``overlap`` of the template's: so no window that holds a template lacks an anchor, whatever the corpus. A window without one is left out only where its
n-grams together, each taken for the family that it speaks for most, can't lift any family over ordinary text (``Rise``).

Scoring is DataFrame work only: the weights, one row per n-gram of the training set, are joined to the windows'
n-grams. That table and the templates' are bounded by the templates and the sample, so they are broadcast.

Edge cases: null and empty texts have no paragraphs; every word of a long paragraph is read, in blocks; ids may be null; rows
of one doc_id with different texts are reported each, repeated rows once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# Usual wording of licence notices, by family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under AGPL-3.0."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "Released under the BSD License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2.", "Licensed under GPL-3.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3.", "Licensed under LGPL-2.1."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this work may be reproduced without the written permission of the copyright holder."],
}
NONE, UNKNOWN = "none", "unknown"
#: Copies of each template, one word in so many left out of each.
COPIES, THIN = 10, 5
#: Words of a window; windows start every third of that. The longest template has less than two thirds of the largest.
SIZES = [6, 12, 24, 48, 96]
#: Words of a paragraph in one row; windows start in one block and may end in the next.
BLOCK = 2048
BLANK = r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"
#: N-grams with weights; the templates and their copies have some 1,500.
VOCABULARY = 1 << 12
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
#: What names a paragraph.
PLACE = ["doc_id", "text_key", "paragraph"]


def grams(words: Column) -> Column:
    """Distinct 1- and 2-grams of an array of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, paragraph (its number) and words of every paragraph with words."""
    parts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", BLANK)).alias("paragraph", "body"))
    return parts.select(*PLACE, words(F.col("body")).alias("words")).where(F.size("words") > 0)


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Rise:
    """How much an n-gram can lift a family over ordinary text, at most, and how much that takes.

    N-grams of about equal worth share a grade, whose worth is that of its best one. A mark is an n-gram behind the letter of its grade; n-grams that lift no family have none.
    """

    def __init__(self, weights: dict[str, list[float]], bias: list[float]):
        worth = sorted(((max(w[:-1]) - w[-1], g) for g, w in weights.items() if max(w[:-1]) > w[-1]), reverse=True)
        self.grades: list[tuple[float, list[str]]] = []
        for v, g in worth:
            if not self.grades or v < self.grades[-1][0] / 1.15 and self.grades[-1][0] > self.grades[0][0] / 200:
                self.grades.append((v, []))
            self.grades[-1][1].append(g)
        self.need = bias[-1] - max(bias[:-1]) - 1e-6  # sums of logits are rounded

    def some(self, pairs: bool) -> list[tuple[str, list[str]]]:
        """Letter and n-grams of the grades, of words or of pairs of words."""
        each = [(chr(33 + k), [g for g in gs if (" " in g) == pairs]) for k, (_, gs) in enumerate(self.grades)]
        return [(c, gs) for c, gs in each if gs]

    def mark(self, gram: Column, pairs: bool) -> Column:
        def letter(of: list[tuple[str, list[str]]]) -> Column:
            half = len(of) // 2
            return F.when(gram.isin([g for _, gs in of[:half] for g in gs]), letter(of[:half])).otherwise(letter(of[half:])) if half else F.lit(of[0][0])

        known = self.some(pairs)
        return F.when(gram.isin([g for _, gs in known for g in gs]), F.concat(letter(known), gram)) if known else F.lit(None).cast("string")

    def marks(self, words: Column) -> Column:
        """Two for each word, null for none: its own, and that of the pair that it begins."""
        firsts = sorted({g.split(" ")[0] for _, gs in self.some(True) for g in gs})
        pair = lambda w, i: F.when(w.isin(firsts), let(F.concat_ws(" ", w, F.get(words, i + 1)), lambda g: self.mark(g, True)))
        return F.flatten(F.transform(words, lambda w, i: F.array(self.mark(w, False), pair(w, i))))

    def worth(self, mark: Column) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(v) for v, _ in self.grades] or [F.lit(0.0)]), F.ascii(mark) - 33), F.lit(0.0))


def starts(n: Column, size: int) -> Column:
    """Where the windows of a size start in n words, if these are more."""
    steps = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)) + size // 3 - 1, F.lit(size // 3))
    return F.transform(steps, lambda i: F.least(i, n - size))


def opened(rise: Rise) -> Column:
    """start and size of a block's windows that ``rise`` does not rule out.

    Words, with the pairs that they begin, are summed by runs of 2, 4, 8, ... words, a third of a window each: so most windows are ruled out by three or four sums, in which
    repeated n-grams count every time, or all by the sums of the longest runs. The others are judged by their distinct n-grams.
    """
    n, words = F.size("words"), F.col("words")
    at = lambda c, j: F.coalesce(F.get(c, j), F.lit(0.0))
    numbers = lambda count: F.sequence(F.lit(0), count - 1)
    halved = lambda c: F.transform(numbers(F.ceil(F.size(c) / 2).cast("int")), lambda j: F.get(c, 2 * j) + at(c, 2 * j + 1))
    kind = "array<struct<start:int,size:int>>"
    none = F.array().cast(kind)

    def of(size: int, runs: Column, hot: Column, long: int) -> Column:
        step = size // 3
        three = lambda j: F.get(runs, j) + at(runs, j + 1) + at(runs, j + 2)
        own = F.flatten(F.transform(hot, lambda j: F.sequence(j * (long // step), (j + 1) * (long // step) - 1))) if size <= long else numbers(F.size(runs))
        near = F.transform(F.filter(own, lambda j: (j * step <= n - size) & (F.col("last") | (j * step < BLOCK)) & (three(j) > rise.need)), lambda j: j * step)
        # The last one may start inside a run.
        j = F.floor((n - size) / step).cast("int")
        rest = F.when(F.col("last") & ((n - size) % step != 0) & (three(j) + at(runs, j + 3) > rise.need), F.array(n - size)).otherwise(F.array().cast("array<int>"))
        return F.when(n > size, F.transform(F.concat(near, rest), lambda i: F.struct(i.alias("start"), F.lit(size).alias("size")))).otherwise(none).cast(kind)

    def every(runs: list[Column]) -> Column:
        if len(runs) < len(SIZES):
            return let(halved(runs[-1]), lambda c: every([*runs, c]))
        top = runs[-1]
        some = F.exists(numbers(F.size(top)), lambda j: F.get(top, j) + at(top, j + 1) + at(top, j + 2) + at(top, j + 3) > rise.need)
        # Windows of a longest run's length at most are in the run that they start in and the next.
        hot = F.filter(numbers(F.size(top)), lambda j: F.get(top, j) + at(top, j + 1) > rise.need)
        found = let(hot, lambda h: F.concat(whole, *[of(size, c, h, SIZES[-1] // 3) for size, c in zip(SIZES, runs, strict=True)]))
        return F.when(some, found).otherwise(none)

    def judged(marks: Column) -> Column:
        each = F.transform(numbers(n), lambda j: rise.worth(F.get(marks, 2 * j)) + rise.worth(F.get(marks, 2 * j + 1)))
        near = let(each, lambda v: let(halved(v), lambda c: every([c])))
        own = lambda x: F.array_distinct(F.slice(marks, 2 * x["start"] + 1, 2 * x["size"] - 1))
        return F.filter(near, lambda x: F.aggregate(own(x), F.lit(0.0), lambda acc, m: acc + rise.worth(m)) > rise.need)

    whole = F.when(n <= SIZES[-1], F.array(F.struct(F.lit(0).alias("start"), n.alias("size")))).otherwise(none).cast(kind)
    return let(rise.marks(words), judged)


def blocks(parts: DataFrame, anchors: list[str], rise: Rise | None = None) -> DataFrame:
    """PLACE, block, last, words and ``at`` (places of the anchors) of the blocks that have an anchor; repeated rows once.

    With ``rise`` also the blocks with windows that it does not rule out, and these windows, ``open``.
    """
    n = F.size("words")
    last = F.greatest(F.lit(0), F.ceil((n - SIZES[-1]) / BLOCK).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("block"), (b == last).alias("last"), F.slice("words", b * BLOCK + 1, F.when(b == last, n).otherwise(BLOCK + SIZES[-1])).alias("words")))
    anchored = F.arrays_overlap("words", literal(anchors))
    if rise is None:
        rows = parts.where(anchored).select(*PLACE, F.inline(cut)).where(anchored)
    else:
        rows = parts.select(*PLACE, F.inline(cut)).withColumn("open", opened(rise)).where(anchored | (F.size("open") > 0))
    rows = rows.dropDuplicates([*PLACE, "block"])
    return rows.withColumn("at", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(literal(anchors), F.get("words", i))))


def windows(rows: DataFrame) -> DataFrame:
    """PLACE, block, start, size, broad, words of the windows with an anchor, and of the open ones. ``rows``: stored blocks."""
    n, kind = F.size("words"), "array<struct<start:int,size:int,broad:boolean,words:array<string>>>"

    def of(size: int) -> Column:
        anchored = lambda i: F.exists("at", lambda p: (p >= i) & (p < i + size))
        chosen = (lambda i: anchored(i) | F.exists("open", lambda o: (o["start"] == i) & (o["size"] == size))) if "open" in rows.columns else anchored
        near = F.filter(starts(n, size), lambda i: (F.col("last") | (i < BLOCK)) & chosen(i))
        cut = F.transform(near, lambda i: F.struct((i + F.col("block") * BLOCK).alias("start"), F.lit(size).alias("size"), F.lit(size == SIZES[-1]).alias("broad"), F.slice("words", i + 1, size).alias("words")))
        return F.when(n > size, cut).otherwise(F.array().cast(kind)).cast(kind)

    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("size"), F.lit(True).alias("broad"), F.col("words")))
    every = F.concat(F.when(n <= SIZES[-1], whole).otherwise(F.array().cast(kind)).cast(kind), *map(of, SIZES))
    return rows.select(*PLACE, "block", F.inline(every))


def apart(found: Column) -> Column:
    """The best of an array of windows, the best of those that do not overlap it, and so on."""
    met = lambda kept, x: F.exists(kept, lambda k: (x["start"] < k["start"] + k["size"]) & (k["start"] < x["start"] + x["size"]))
    return F.aggregate(F.reverse(F.array_sort(found)), F.slice(found, 1, 0), lambda kept, x: F.when(met(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def template_table(spark: SparkSession) -> DataFrame:
    """family, template (number), words."""
    rows = json.dumps([{"family": f, "template": 100 * i + j, "text": t} for i, (f, ts) in enumerate(TEMPLATES.items()) for j, t in enumerate(ts)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<family:string,template:int,text:string>>"))).select("family", "template", words(F.col("text")).alias("words"))


def thinned(rows: DataFrame, first: int) -> DataFrame:
    """Copies of rows (family, words), the first whole, the others without a fifth of their words."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(first), F.lit(first + COPIES - 1))))
    stays = lambda w, i: (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(THIN)) != 0) | (F.col("copy") == 0)
    return copies.select("family", F.filter("words", stays).alias("words"))


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """Words of windows of the ``sample_docs`` documents first by a hash of their id, few of each size."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order).limit(sample_docs)
    parts = paragraphs(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).dropDuplicates(PLACE)
    n = F.size("words")
    size = F.explode(F.array(*[F.lit(x) for x in SIZES])).alias("size")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - F.col("size")), F.col("size"))).alias("start")
    cut = parts.select(*PLACE, F.slice("words", 1, 4 * SIZES[-1]).alias("words"), size).select(*PLACE, "words", "size", starts)
    cut = cut.select(F.slice("words", F.col("start") + 1, F.col("size")).alias("words"), "size", "start", "doc_id", "paragraph")
    return cut.orderBy(F.md5(F.concat_ws(":", "doc_id", "paragraph", "size", "start").cast("binary")), "words").limit(10 * sample_docs).select("words")


def in_context(rows: DataFrame, prose: DataFrame) -> DataFrame:
    """The rows (family, words), and each between some ordinary words, half as many as its own and two more."""
    keys = 64
    some = prose.groupBy(F.pmod(F.xxhash64("words"), F.lit(keys)).alias("key")).agg(F.max("words").alias("around"))
    met = rows.withColumn("key", F.pmod(F.xxhash64("words", "family"), F.lit(keys))).join(F.broadcast(some), "key")
    n = (F.size("words") / 4).cast("int") + 1
    return rows.unionByName(met.select("family", F.concat(F.slice("around", F.lit(1), n), "words", F.slice("around", n + 1, n)).alias("words")))


def shares(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """row, family, template, n, theirs: n-grams that each row (row, grams) shares with each template that it meets."""
    met = rows.select("row", F.explode("grams").alias("gram")).join(F.broadcast(templates), "gram")
    return met.groupBy("row", "family", "template").agg(F.count("*").alias("n"), F.first("template_grams").alias("theirs"))


def logits(features: DataFrame, weights: DataFrame, bias: list[float], keys: list[str]) -> DataFrame:
    """keys, logits: sums over n-grams of their weights, plus the bias. ``features``: keys and grams."""
    each = features.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    sums = each.groupBy(*keys).agg(F.array(*[F.sum(F.col("w")[k]) + b for k, b in enumerate(bias)]).alias("logits"))
    return sums


def softmax(values: Column, temperature: float | Column) -> Column:
    top = F.array_max(values)
    scaled = F.transform(values, lambda v: F.exp((v - top) / temperature))
    return F.transform(scaled, lambda v: v / F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x))


class Model:
    """Families, the anchors, the broadcast weights table, the biases, what lifts families over ordinary text, and the temperature."""

    def __init__(self, docs: DataFrame, sample_docs: int, overlap: float):
        spark = docs.sparkSession
        templates = template_table(spark)
        own = templates.select("family", "template", grams(F.col("words")).alias("grams"))
        self.templates = stored(own.select("family", "template", F.size("grams").alias("template_grams"), F.explode("grams").alias("gram")), "licence-templates")
        found = sample(docs, sample_docs).select(F.monotonically_increasing_id().alias("row"), "words", grams(F.col("words")).alias("grams"))
        found = stored(found, "licence-sample")
        # What shares much with a template may be a licence, and teaches nothing.
        near = shares(found.select("row", "grams"), self.templates).join(found.select("row", F.size("grams").alias("own")).hint("merge"), "row")
        near = near.where(F.col("n") >= overlap / 2 * F.least("own", "theirs")).select("row").distinct()
        prose = stored(found.join(near.hint("merge"), "row", "left_anti").select("words"), "licence-prose")
        wording = [(r["family"], r["words"]) for r in templates.collect()]
        self.anchors = anchors([ws for _, ws in wording], rates(prose, sorted({w for _, ws in wording for w in ws})), overlap)
        background = stored(self.ordinary(prose, sorted({w for _, ws in wording for w in ws})), "licence-ordinary")
        self.families = [*TEMPLATES, NONE]
        number = F.array_position(literal(self.families), F.col("family")) - 1
        blank = spark.range(1).select(F.lit(NONE).alias("family"), F.array(F.lit("-")).alias("words"))
        rows = in_context(thinned(templates, 0), prose).unionByName(background).unionByName(blank)
        rows = stored(rows.select(number.cast("double").alias("label"), grams(F.col("words")).alias("grams")), "licence-training")
        # Some thousand rows, in few tasks: each sends its gradient, a number for each family and n-gram, in every round.
        rows = rows.coalesce(2)
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=VOCABULARY, minDF=2.0).fit(rows)
        fit = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(counter.transform(rows))
        w = fit.coefficientMatrix.toArray()
        table = [{"gram": g, "w": [round(float(x), 5) for x in w[:, i]]} for i, g in enumerate(counter.vocabulary)]
        self.bias = [float(b) for b in fit.interceptVector]
        values = F.from_json(F.lit(json.dumps(table)), "array<struct<gram:string,w:array<double>>>")
        self.weights = stored(spark.range(1).select(F.inline(values)), "licence-weights")
        self.rise = Rise({r["gram"]: r["w"] for r in table}, self.bias)
        self.temperature = self.calibrated(in_context(thinned(templates, COPIES), prose).unionByName(background))

    @staticmethod
    def ordinary(prose: DataFrame, wording: list[str]) -> DataFrame:
        """Ordinary windows, each as it is and with one to four words of templates put in."""
        pick = lambda k: F.get(literal(wording), F.pmod(F.xxhash64("words", F.lit(k)), F.lit(len(wording))).cast("int"))
        put = F.slice(F.array(*[pick(k) for k in range(4)]), 1, F.pmod(F.xxhash64("words"), F.lit(4)).cast("int") + 1)
        half = F.ceil(F.size("words") / 2).cast("int")
        mixed = F.concat(F.slice("words", F.lit(1), half), put, F.slice("words", half + 1, F.size("words")))
        return prose.select(F.lit(NONE).alias("family"), "words").unionByName(prose.select(F.lit(NONE).alias("family"), mixed.alias("words")))

    def calibrated(self, held: DataFrame) -> float:
        """The temperature under which other thinned copies and the ordinary windows are likeliest."""
        rows = held.select(F.monotonically_increasing_id().alias("row"), "family", grams(F.col("words")).alias("grams"))
        rows = stored(rows, "licence-held")
        found = logits(rows.select("row", "grams"), self.weights, self.bias, ["row"]).join(rows.select("row", "family").hint("merge"), "row")
        trial = found.withColumn("t", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])))
        p = F.element_at(softmax(F.col("logits"), F.col("t")), F.array_position(literal(self.families), F.col("family")).cast("int"))
        best = trial.groupBy("t").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss")).orderBy(F.round("loss", 6), "t").first()
        return best["t"] if best else 1.0


def rates(prose: DataFrame, wording: list[str]) -> dict[str, int]:
    """How many ordinary windows have each of these words."""
    each = prose.select(F.explode(F.array_intersect("words", literal(wording))).alias("word"))
    return dict(each.groupBy("word").count().collect())  # a row for each word of the templates at most


def anchors(templates: list[list[str]], rate: dict[str, int], overlap: float) -> list[str]:
    """Words, the rarest first, such that of every template fewer than ``overlap`` of its n-grams have none of them."""
    chosen: set[str] = set()
    for ws in templates:
        own = {(w,) for w in ws} | set(zip(ws, ws[1:], strict=False))
        for w in sorted(set(ws), key=lambda w: (w not in chosen, rate.get(w, 0), -len(w), w)):
            if sum(not chosen & set(g) for g in own) < overlap * len(own):
                break
            chosen.add(w)
    return sorted(chosen)


def scan(docs: DataFrame, sample_docs: int = 200, least: float = 0.6, overlap: float = 0.6) -> DataFrame:
    """Licence paragraphs: doc_id, paragraph, at_word, words, family (or ``unknown``), score, guess, template, shared, confirmed."""
    model = Model(docs, sample_docs, overlap)
    spark = docs.sparkSession
    # Stored, as the windows' lambdas would else split the text anew for each window.
    rows = stored(blocks(paragraphs(docs.select("doc_id", "text")), model.anchors, model.rise), "licence-blocks")
    found = windows(rows).select(F.monotonically_increasing_id().alias("row"), *PLACE, "block", "start", "size", "broad", grams(F.col("words")).alias("grams"))
    # Dealt out by number: few bytes, but much work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(found, "licence-windows").repartition(tasks, "row")
    each = found.select("row", "grams")
    p = softmax(F.col("logits"), model.temperature)
    order = F.transform(F.sequence(F.lit(0), F.lit(len(model.families) - 1)), lambda i: F.struct(F.get("p", i).alias("score"), i.alias("k")))
    names = literal(model.families)
    scored = logits(each, model.weights, model.bias, ["row"]).select("row", p.alias("p")).select("row", "p", F.get(names, F.array_max(order)["k"]).alias("guess"))
    # All templates are compared before ordinary windows are dropped.
    met = shares(each, model.templates).groupBy("row").agg(F.collect_list(F.struct("family", "template", "n", "theirs")).alias("met"))
    own = found.select("row", *PLACE, "block", "start", "size", "broad", F.size("grams").alias("own"))
    both = own.join(scored.hint("merge"), "row").join(met.hint("merge"), "row", "left")
    held = F.filter("met", lambda m: m["n"] >= overlap * m["theirs"])
    held = F.array_max(F.transform(held, lambda m: F.struct((m["n"] / m["theirs"]).alias("part"), m["n"].alias("n"), (-m["template"]).alias("minus"), m["family"].alias("family"))))
    both = both.withColumn("ordinary", F.col("guess") == NONE).withColumn("guess", F.when(F.col("guess") == NONE, held["family"]).otherwise(F.col("guess"))).where("guess is not null")
    shared = lambda m: F.round(m["n"] / F.least(F.col("own").cast("long"), m["theirs"].cast("long")), 6)
    best = F.array_max(F.transform(F.filter("met", lambda m: m["family"] == F.col("guess")), lambda m: F.struct(shared(m).alias("shared"), (-m["template"]).alias("minus"), m["n"].alias("n"))))
    score = F.round(F.get("p", F.array_position(names, F.col("guess")).cast("int") - 1), 6)
    both = both.select(*PLACE, "block", "start", "size", "broad", "own", "ordinary", "guess", score.alias("score"), best.alias("m")).withColumn("shared", F.coalesce("m.shared", F.lit(0.0)))
    both = both.withColumn("sure", ~F.col("ordinary") & (F.col("score") >= least) & (F.col("shared") >= overlap))
    both = both.where(F.col("broad") | F.col("ordinary") | (F.col("score") >= least))
    # What a window shares with its template, less half of what it does not.
    rank = 1.5 * F.coalesce("m.n", F.lit(0)) - 0.5 * F.col("own")
    family = F.when(F.col("sure"), F.col("guess")).otherwise(UNKNOWN)
    hit = F.struct("sure", rank.alias("rank"), "score", "size", "start", family.alias("family"), "guess", (-F.col("m.minus")).alias("template"), "shared")
    # First inside each block, which bounds the array, then in the paragraph.
    kept = both.groupBy(*PLACE, "block").agg(F.collect_list(hit).alias("hits")).select(*PLACE, F.explode(apart(F.col("hits"))).alias("h"))
    kept = kept.groupBy(*PLACE).agg(F.collect_list("h").alias("hits")).select(*PLACE, F.explode(apart(F.col("hits"))).alias("h"))
    out = kept.groupBy(*PLACE, F.col("h.family").alias("family")).agg(F.max("h").alias("h"))
    return out.select("doc_id", "paragraph", F.col("h.start").alias("at_word"), F.col("h.size").alias("words"), "family", "h.score", "h.guess", "h.template", "h.shared", F.col("h.sure").alias("confirmed"))
