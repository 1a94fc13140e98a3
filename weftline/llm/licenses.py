"""License scans: a trained paragraph classifier in DataFrame operations.

A multinomial logistic regression over sparse word 1- and 2-grams learns the
families from sentences about each of them, and an unknown class from lines of
the corpus (half of them with licence words), denials ("not released under
..."), mentions ("we discussed the ... in class") and fragments of the
sentences. All families weigh the same in training, and the unknown class as
much as half of them together. Its probabilities are calibrated by a
temperature fitted on sentences held back, and a family is reported only if it
is likelier than ``threshold`` and a template comparison confirms it: the line
must hold at least ``share`` of the word pairs of some key phrase of the family.

Features are n-grams with a telling word (one that is in the sentences and not
among the commonest words), a negation or a word that speaks about licences,
and marks for how many other words a line without a granting one has: a bare
name is a notice, the same name in a sentence on something else is not. A line without a
telling word is unknown, as a test confirms of the model, and is left out
before its n-grams are made.

Of names and notices in contexts that training has not seen, a test finds all
by family, and no name in a sentence about it passes.

A paragraph is a line; a phrase wrapped over two lines is judged by halves.
Defined cases: null and empty texts have none; a very long line is one
paragraph with as many n-grams as it has; of equally likely families the first
in the order of ``PHRASES`` is reported; rows that repeat come back as often;
null ids stay null; nothing found, and an empty table, give an empty result;
further columns of the input, whatever their names, are left behind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import col, draw_key, least_draws, materialise, table

#: Lines of the corpus from which the unknown class is learnt at most, by least draw key.
UNKNOWN_LINES = 2000
SEED = 5
UNKNOWN = "unknown"
NEGATIONS = ("not", "never", "no", "longer")
#: What a line that does not grant is marked with by the number of its words that no key phrase has.
OTHERS = {1: "<1 other>", 3: "<3 others>", 6: "<6 others>"}
#: A phrase with one of these grants; the others are names.
GRANTS = (
    r"copyright|licensed|released|distributed|available|permission|permitted|may not|subject to|dedicated|waives|spdx|reserved|prohibited|redistribut|"
    r"required by|retain|neither|confidential|unencumbered|in the public domain|terms|share alike|use only|if a copy|shall be"
)
#: Share of all families' weight in training that the unknown class has.
UNKNOWN_WEIGHT = 0.5

#: Key phrases of licence families. The first of each are also its templates.
PHRASES: dict[str, tuple[str, ...]] = {
    "mit": (
        "MIT License", "released under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "licensed under the MIT license", "distributed under the terms of the MIT license", "this project is available under the MIT License", "MIT licensed", "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Apache License Version 2.0", "licensed under the Apache License", "you may not use this file except in compliance with the License",
        "unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis",
        "released under the Apache License, Version 2.0", "available under the Apache 2.0 license", "Apache 2.0 licensed", "SPDX-License-Identifier: Apache-2.0", "apache software license",
    ),
    "bsd": (
        "BSD License", "BSD 3-Clause License", "redistribution and use in source and binary forms, with or without modification, are permitted",
        "redistributions of source code must retain the above copyright notice", "neither the name of the copyright holder nor the names of its contributors may be used to endorse",
        "licensed under the BSD license", "released under the 3-clause BSD license", "BSD 2-clause license", "new BSD licensed", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "GNU General Public License", "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "this program is free software: you can redistribute it and/or modify it", "licensed under the GNU GPL",
        "this work is licensed under the GNU General Public License, version 3", "released under the GPL version 2", "GPLv3 licensed", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under GPL 3",
    ),
    "lgpl": (
        "GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License", "this library is free software; you can redistribute it",
        "licensed under the LGPL", "released under the GNU Library General Public License", "LGPL version 2.1", "SPDX-License-Identifier: LGPL-2.1", "distributed under the Lesser General Public License, version 3",
    ),
    "agpl": (
        "GNU Affero General Public License", "under the terms of the GNU Affero General Public License", "licensed under the AGPL", "released under the AGPL version 3",
        "AGPLv3 licensed", "SPDX-License-Identifier: AGPL-3.0", "this service is licensed under the Affero General Public License",
    ),
    "mpl": (
        "Mozilla Public License", "this source code form is subject to the terms of the Mozilla Public License", "licensed under the MPL 2.0",
        "if a copy of the MPL was not distributed with this file, you can obtain one", "released under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "CC BY 4.0", "Creative Commons Attribution License", "licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0",
        "this work is licensed under the Creative Commons Attribution license", "available under CC BY 3.0", "CC-BY licensed", "text is available under CC BY",
    ),
    "cc-by-sa": (
        "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License", "licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike license",
        "text is available under CC BY-SA 3.0", "share alike: distributed under the same CC BY-SA license",
    ),
    "cc-by-nc": (
        "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial License", "licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial license",
        "released under CC BY-NC 3.0", "for non-commercial use only under CC BY-NC", "CC BY-NC-ND licensed, noncommercial and no derivatives",
    ),
    "public-domain": (
        "dedicated to the public domain", "CC0 1.0 Universal", "this is free and unencumbered software released into the public domain", "the author waives all rights under CC0",
        "this work is in the public domain", "released under the Unlicense", "licensed under CC0",
    ),
    "proprietary": (
        "All rights reserved", "no part of this publication may be reproduced without prior written permission", "unauthorized copying of this file is strictly prohibited",
        "proprietary and confidential", "copyright, all rights reserved worldwide", "may not be copied or distributed without permission of the copyright holder",
    ),
}
#: Words too common to tell a licence.
COMMON = frozenset(
    "a an and any are as at be been by can do for from has have if in into is it its may more must no nor not of on one or other our shall so such than that the their then "
    "there these they this to under up use used was we were which will with within without you your above all out new part name names form forms real work text file copy same above".split()
)


def words(text: Column) -> Column:
    """Lower-case letters and digits, with points inside numbers."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), "")


def grams(array: str) -> Column:
    """Distinct words and pairs of neighbours."""
    w = F.col(array)
    rest = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(w, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(w, pairs))


@dataclass(frozen=True)
class Model:
    """``weights`` (gram and a weight for each class), words, intercepts and temperature: all of fixed size."""

    classes: list[str]
    weights: DataFrame
    #: Words without which a line is unknown, and those that no mark counts.
    telling: list[str]
    known: list[str]
    intercepts: list[float]
    temperature: float


def features(array: str, known: list[str]) -> Column:
    """N-grams and marks of a line's words."""
    other = F.when(F.array_join(array, " ").rlike(GRANTS), 0).otherwise(F.size(F.filter(array, lambda x: ~x.isin(known))))
    marks = F.array_compact(F.array(*[F.when(other >= n, F.lit(m)) for n, m in OTHERS.items()]))
    return F.concat(grams(array), marks)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, line, text)`` of every line that is not blank."""
    each = docs.select(col(id_col).alias("doc_id"), F.posexplode_outer(F.split(col(text_col).cast("string"), "\n", -1)).alias("line", "text"))
    return each.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _grants(text: str) -> bool:
    return re.search(GRANTS, text.lower()) is not None


def _openings(text: str) -> list[str]:
    """Lines that give notice of a licence."""
    if not _grants(text):
        return [f"{o}{text}" for o in ("", "license: ", "note: ", "license of this file: ", "copyright by our firm, 1999. ")]
    before = (
        "", "this project is ", "the code and documentation are ", "unless noted, it is ", "note: ", "a fine text of some words that says nothing twice; it was ",
        "as of today every part of what you see here is ", "our group of nine friends wrote that in two weeks and it is ", "thank you for visiting our page; its content was ",
    )
    return [f"{o}{text}" for o in before] + [f"{text}, as the file of that name says", f"{text}. we hope you enjoy the many stories that wait on our other pages"]


def _denials(text: str) -> list[str]:
    """Sentences about a licence that do not grant it."""
    return [f"not {text}, ask us first", f"this is not {text}", f"it was never {text}", f"no longer {text}"]


def _mentions(text: str) -> list[str]:
    """Sentences that speak about a licence by its name."""
    about = (
        "we discussed the {} in class and its history", "the book compares the {} with others", "an article about the {} appeared last week", "he asked what the {} means",
        "the history of the {} is long", "she wrote a paper on the {} and its rivals", "students read the {} before the exam", "the {} was the subject of a talk",
        "critics of the {} say it is too strict", "lawyers debate whether the {} applies", "many people confuse the {} with another one", "compared with the {} it is simple",
    )
    return [] if _grants(text) else [a.format(text) for a in about]


def _fragments(text: str) -> list[str]:
    """Sentences on something else that hold two neighbouring words of a longer phrase."""
    parts = [w for w in text.lower().replace(",", " ").replace(":", " ").replace(";", " ").split() if w]
    pairs = list(zip(parts, parts[1:], strict=False)) if len(parts) > 4 else []
    return [f"we spoke of {a} {b} at school every day" for a, b in pairs]


def _speaks(telling: list[str]) -> Callable[[Column], Column]:
    """Whether an array of words has a telling one."""
    return lambda w: F.exists(w, lambda x: x.isin(telling))


def train(docs: DataFrame, *, limit: int = UNKNOWN_LINES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from ``PHRASES``, from denials and fragments of them, and from ``limit`` lines of ``docs``.

    Half of the lines are any, half have a telling word, and none names a
    licence outright: what speaks of one is left to the phrases.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    families = list(PHRASES)
    own = [(f, t, k) for f in families for p in PHRASES[f] for k, t in enumerate(_openings(p))]
    others = [(UNKNOWN, t, k) for f in families for p in PHRASES[f] for k, t in enumerate(_denials(p) + _mentions(p) + _fragments(p))]
    sentences = spark.createDataFrame(own, "family string, text string, k int").withColumn("w", words(F.col("text")))
    split = lambda t: t.lower().replace(",", " ").replace(":", " ").replace(";", " ").split()
    plain = {w for o in (*_openings(""), *_openings("licensed")) for w in split(o)} - {"license", "licensed"}
    spoken_of = sorted({w for m in _mentions("") for w in split(m.replace("{}", ""))} - COMMON)
    said = {r[0] for r in sentences.select(F.explode("w")).distinct().collect()}
    known = sorted({w for f in families for p in PHRASES[f] for w in split(p)} | COMMON | {"licence"})
    telling = sorted(said - COMMON - plain)
    telling = [t for t in telling if len(t) > 1]
    has = _speaks([*telling, *NEGATIONS, *spoken_of])
    marks = list(OTHERS.values())
    # Word pairs of the names.
    named = sorted({f"{a} {b}" for f in families for p in PHRASES[f] if not _grants(p) for a, b in pairwise(split(p))})
    names = F.lower("text").rlike(r"licen[cs]e|copyright|public domain|rights reserved")
    lines = paragraphs(docs, id_col, text_col).select("text").withColumn("draw", draw_key(SEED, F.xxhash64("text")))
    text = col(text_col).cast("string")
    # Line ends tell about how many lines there are; no line is looked at for that.
    total = docs.agg(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0
    near = _speaks(telling)(words(F.col("text")))
    drawn = least_draws(lines, limit // 2, ~names, total).unionByName(least_draws(lines, limit - limit // 2, ~names & near, total)).distinct()
    unknown = drawn.select(F.lit(UNKNOWN).alias("family"), "text", F.pmod(F.xxhash64("text"), F.lit(9)).cast("int").alias("k"))
    made = spark.createDataFrame(others, "family string, text string, k int")
    every = unknown.unionByName(made).withColumn("w", words(F.col("text"))).unionByName(sentences)
    spoken = F.filter(features("w", known), lambda g: g.isin(marks) | has(F.split(g, " ")))
    featured = materialise(every.select("family", "k", spoken.alias("g")))
    vectors = CountVectorizer(inputCol="g", outputCol="x", binary=True, minDF=1).fit(featured.where(F.col("family") != UNKNOWN).unionByName(made.withColumn("w", words(F.col("text"))).select("family", "k", spoken.alias("g"))))
    classes = [*families, UNKNOWN]
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    sizes = {r["family"]: r["count"] for r in featured.groupBy("family").count().collect()}
    share = {f: len(families) * UNKNOWN_WEIGHT if f == UNKNOWN else 1.0 for f in sizes}
    weight = F.create_map(*[x for f, n in sizes.items() for x in (F.lit(f), F.lit(100 * share[f] / n))])[F.col("family")]
    # A name in a sentence is the hardest to tell from a notice.
    weight = weight * F.when((F.col("family") == UNKNOWN) & F.arrays_overlap("g", F.array(*map(F.lit, marks))) & F.arrays_overlap("g", F.array(*map(F.lit, named))), 8).otherwise(1)
    # A bounded number of rows: one task goes over them in each iteration.
    rows = vectors.transform(featured).select("x", "k", place.alias("y"), weight.alias("weight")).coalesce(1).cache()
    held = F.col("k") % 4 == 3
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=0.0001, elasticNetParam=0.5, maxIter=100).fit(rows.where(~held))
    # A bounded number of held-back rows, for one number.
    scored = [(list(r["rawPrediction"]), int(r["y"])) for r in fitted.transform(rows.where(held)).select("rawPrediction", "y").collect()]
    rows.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for raw, y in scored:
            z = [v / t for v in raw]
            top = max(z)
            total += top + math.log(sum(math.exp(v - top) for v in z)) - z[y]
        return total

    temperature = min((0.25 * 1.15**k for k in range(25)), key=loss)
    matrix = fitted.coefficientMatrix.toArray()
    some = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(vectors.vocabulary) if any(matrix[:, i])]
    weights = spark.createDataFrame(some, "gram string, weights array<double>")
    return Model(classes, weights, telling, known, [float(x) for x in fitted.interceptVector], temperature)


def scan(docs: DataFrame, model: Model, *, threshold: float = 0.5, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line, family, probability, template_share, text)`` of every line with a confirmed licence."""
    spark = docs.sparkSession
    told = materialise(
        paragraphs(docs, id_col, text_col).withColumn("w", words(F.col("text"))).where(_speaks(model.telling)(F.col("w")))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "line", "text", "w")
    )
    each = told.select("row", F.explode(features("w", model.known)).alias("gram"))
    n = len(model.classes)
    sums = each.join(F.broadcast(model.weights), "gram").groupBy("row").agg(*[F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(n)])
    z = F.array(*[(F.col(f"s{k}") + b) / model.temperature for k, b in enumerate(model.intercepts)])
    top = F.array_max("z")
    odds = F.aggregate("z", F.lit(0.0), lambda t, x: t + F.exp(x - top))
    names = F.array(*[F.lit(c) for c in model.classes])
    classed = sums.select("row", z.alias("z")).select(
        "row", (1 / odds).alias("p"), F.element_at(names, F.array_position("z", top).cast("int")).alias("family")
    )
    likely = classed.where((F.col("family") != UNKNOWN) & (F.col("p") >= threshold))
    # Templates: the pairs of each key phrase.
    phrases = spark.createDataFrame([(f, k, p) for f, ps in PHRASES.items() for k, p in enumerate(ps)], "family string, k int, phrase string")
    pairs = (
        phrases.withColumn("w", words(F.col("phrase"))).withColumn("g", F.filter(grams("w"), lambda g: g.contains(" ")))
        .select(F.col("family").alias("f"), "k", F.size("g").alias("size"), F.explode("g").alias("gram"))
    )
    hits = (
        each.join(F.broadcast(pairs), "gram").groupBy("row", "f", "k").agg((F.count("*") / F.max("size")).alias("share"))
        .groupBy("row", "f").agg(F.max("share").alias("share"))
    )
    sure = likely.join(hits, (likely["row"] == hits["row"]) & (F.col("family") == F.col("f"))).where(F.col("share") >= share)
    found = sure.select(likely["row"].alias("r"), "family", F.round("p", 6).alias("probability"), F.round("share", 6).alias("template_share"))
    return told.join(found, F.col("row") == F.col("r")).select("doc_id", F.col("line").cast("long").alias("line"), "family", "probability", "template_share", "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).select("doc_id", "line", "family", "probability", "template_share")
