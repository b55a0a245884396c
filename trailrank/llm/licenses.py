"""Licence statements: a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line with the lines that carry its sentence on: a line that does
not end in a stop goes on in the next one, if that begins with a small letter.
Features are the word n-grams (one to three words) of the templates below. A
multinomial logistic regression, trained on windows of the templates against a
bounded sample of the corpus' own paragraphs and on lines of no family, gives each
paragraph a family, unknown or none. Windows that several families share teach
unknown. A family needs the probability that keeps the share of wrong claims below
``FALSE_CLAIMS`` on templates and lines that the model did not see (two halves,
each judged by the other's model); and it is confirmed by comparing the paragraph's
n-grams with the family's templates. What speaks of licences without that is ``unknown``.

Paragraphs that hold neither a telling word of the templates (a licence's name, or
what only licences say) nor three words of a template in a row are passed over
before features are made; every window of four template words or more holds one.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailrank.llm._sample import hash_share
from trailrank.llm._store import cut

#: Families and sentences that state them. Fixed values.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT license."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0"],
    "gpl-2.0": ["This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
}
#: Statements in other languages, by family. Fixed values.
FOREIGN = {
    "apache-2.0": ["Lizenziert unter der Apache-Lizenz, Version 2.0.", "Distribué sous licence Apache, version 2.0.", "Publicado bajo la licencia Apache, versión 2.0."],
    "mit": ["Lizenziert unter der MIT-Lizenz.", "Distribué sous licence MIT.", "Publicado bajo la licencia MIT."],
    "gpl-3.0": ["Lizenziert unter der GNU General Public License, Version 3.", "Distribué sous licence publique générale GNU, version 3.", "Publicado bajo la Licencia Pública General de GNU, versión 3."],
    "cc-by": ["Lizenziert unter CC BY 4.0.", "Distribué sous licence CC BY 4.0.", "Publicado bajo la licencia CC BY 4.0."],
    "cc-by-sa": ["Lizenziert unter CC BY-SA 4.0.", "Distribué sous licence CC BY-SA 4.0.", "Publicado bajo la licencia CC BY-SA 4.0."],
    "cc-by-nc": ["Lizenziert unter CC BY-NC 4.0.", "Distribué sous licence CC BY-NC 4.0.", "Publicado bajo la licencia CC BY-NC 4.0."],
}
#: Licence-like lines of no family above; they teach the unknown class. Fixed values.
UNFAMILIAR = ["Copyright the authors. All rights reserved.", "Licensed under the terms of our own license agreement.", "See the license file for the terms of use.", "Released under a proprietary license.", "This work is licensed under terms that the publisher sets.", "Permission to copy must be asked for in writing.", "Redistribution is not permitted without a license.", "The software license is included with the product.", "You need a license to use this software.", "Distributed under the Example Vendor License, version 1.", "Ce logiciel est distribué sous licence libre.", "Die Software steht unter einer freien Lizenz.", "El programa se publica bajo una licencia libre."]
#: Lines with telling words that state no licence; they teach the class of plain lines. Fixed values.
PLAIN = ["Your driving license must be valid.", "She got her driving licence and the license plate.", "The public may use this work free of charge in the library.", "We were hereby granted permission to visit the foundation.", "The commons lay open to the creative people of the town.", "The apache helicopter was released to the public.", "A general of the army was subject to the terms of the treaty.", "He gave permission for any purpose without fee.", "The form is subject to the terms of the contract.", "The fishing licence costs less this year.", "Her novel was published and widely distributed.", "The foundation modified its statement.", "The gnu is an antelope that lives in herds.", "All copyright lawyers of the firm met in the hall.", "The conditions were met and the binary star was seen.", "Er hat den Führerschein und eine Lizenz als Trainer.", "Elle a obtenu sa licence de lettres à Lyon.", "Tiene una licencia de conducir nueva.", "The attribution of the painting is international news.", "The restriction on public files was waived by the author."]
#: Words too common to tell a licence; n-grams of these alone are no features. Fixed values.
COMMON = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "this", "that", "with", "under", "by", "for", "you", "your", "be", "as", "are", "may", "not", "any", "all", "on", "use", "work", "later", "can", "has", "into", "at", "from", "either", "v", "0", "1", "2", "3", "4", "4.0", "2.0", "3.0", "1.0", "person", "purpose", "following", "conditions", "met", "without", "fee", "copy", "forms", "form", "source", "law", "possible", "extent", "author", "related", "rights", "files", "terms", "version", "subject", "general", "universal", "international", "domain", "deal", "binary", "library", "program", "project", "free", "public", "charge", "other", "provided", "associated", "documentation", "restriction", "code", "unter", "der", "distribué", "sous", "bajo", "la", "de", "general", "publicado", "versión", "ce", "logiciel", "est", "die", "steht", "einer", "el", "programa", "se", "publica", "una")
#: Words of templates that are everyday words, or words of other languages, by themselves. Fixed values.
EVERYDAY = ("mit", "file", "except", "published", "software", "obtaining", "distribu", "versi", "publique", "lica", "blica")
#: Bound of the training sample: lines of the corpus, from a quarter as many texts, each of at most so many bytes.
TRAIN_LINES, TRAIN_BYTES = 2000, 32_768
#: Most wrong claims, as a share of the claims, on templates that the model did not see.
FALSE_CLAIMS = 0.005
#: Least share of n-grams that a confirmed paragraph has in common with a template of its family.
LEAST_SHARED = 0.5
_NONE, _UNKNOWN = "none", "unknown"
#: Corpus paragraphs with a telling word teach the plain class only below this similarity to every template.
FAR = 0.2
#: What a corpus paragraph weighs in training; a whole template weighs 1 and its windows together 1.
PLAIN_WEIGHT = 0.05
#: Words that speak of licences in the languages of the templates. Fixed values.
_SPEAKS = r"(?i)licen[cs]|lizenz|copyright|spdx"
#: Ends of paragraphs: a line's end after a stop or another line's end, or before anything but a small letter.
_PARAGRAPHS = r"(?<=[\n.!?:;][ \t\r]{0,3})\n|\n(?![ \t]*\p{Ll})"
_SPLIT = r"[^\p{L}\p{N}.+]+|\.+(?![\p{L}\p{N}])"


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct n-grams of one to three words."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    longer = [F.when(F.size(words) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    return F.array_distinct(F.concat(*longer))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of fixed values, held in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _all_templates() -> list[tuple[str, str]]:
    return [(f, t) for said in (TEMPLATES, FOREIGN) for f, ts in said.items() for t in ts]


def _templates(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "template": n, "line": t} for n, (f, t) in enumerate(_all_templates())]
    return _table(spark, rows, "family string, template int, line string").withColumn("words", words_of(F.col("line")))


def _windows(templates: DataFrame) -> DataFrame:
    """Every run of four words or more of each line (words): what is left of statements that are cut or wrapped."""
    lengths = F.sequence(F.least(F.lit(4), F.size("words")), F.size("words"))
    runs = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))))
    return templates.withColumn("words", F.explode(runs))


class LicenseModel:
    """Vocabulary, per-class weights and intercepts, and the least probability of a claim."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: list[list[float]], intercepts: list[float], least: float):
        self.classes, self.vocabulary, self.weights, self.intercepts, self.least = classes, vocabulary, weights, intercepts, least

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, w): the weight of each class for every n-gram of the vocabulary."""
        rows = [{"gram": g, "w": [row[k] for row in self.weights]} for k, g in enumerate(self.vocabulary)]
        return _table(spark, rows, "gram string, w array<double>")


def telling_words() -> list[str]:
    """Words of three letters or digits or more in templates and licence-like lines, outside ``COMMON`` and ``EVERYDAY``."""
    return sorted({w for _, line in _all_templates() for w in re.findall(r"[a-z0-9]{3,}", line.lower()) if w not in (*COMMON, *EVERYDAY)})


def telling_runs() -> list[tuple[str, ...]]:
    """Three words in a row of a template without a telling word."""
    told, runs = set(telling_words()), set()
    for _, line in _all_templates():
        words = [w for w in re.split(r"[^\w.+]+|\.+(?!\w)", line.lower()) if w]
        runs |= {r for r in zip(words, words[1:], words[2:]) if not told & {x for w in r for x in re.findall("[a-z0-9]+", w)}}
    return sorted(runs)


def _tells(text: Column) -> Column:
    """Whether a text has a telling word (look-ups in a small hash set) or a telling run of words; linear in its length."""
    words = F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in telling_words()]))
    runs = "|".join(r"[^\p{L}\p{N}]+".join(map(re.escape, r)) for r in telling_runs())
    return words | F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{runs})(?![\p{{L}}\p{{N}}])")


def _paragraphs(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line): the telling paragraphs, with the number of their first telling line (of their first, if no line tells alone)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_tells(F.col("text")))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()), "licence-texts")
    parts = rows.select("n", "doc_id", F.posexplode(F.split("text", _PARAGRAPHS)).alias("k", "line"))
    before = Window.partitionBy("n").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inner", F.regexp_count("line", F.lit("\n")))
    parts = parts.withColumn("line_no", (F.col("k") + F.coalesce(F.sum("inner").over(before), F.lit(0))).cast("int"))
    first = F.array_position(F.transform(F.split("line", "\n"), _tells), True).cast("int")
    line_no = F.col("line_no") + F.greatest(first - 1, F.lit(0))
    return parts.where(_tells(F.col("line"))).select(F.struct("n", "k").alias("row"), "doc_id", line_no.alias("line_no"), "line")


def _likeness(grams: DataFrame) -> DataFrame:
    """(row, family, similarity) from (row, size, gram): most n-grams shared with a template of the family, as a share of the smaller set."""
    known = _templates(grams.sparkSession).select("family", "template", grams_of(F.col("words")).alias("g")).select("family", "template", F.size("g").alias("t_size"), F.explode("g").alias("gram"))
    shared = grams.join(F.broadcast(known), "gram").groupBy("row", "family", "template").agg((F.count(F.lit(1)) / F.least(F.first("size"), F.first("t_size"))).alias("similarity"))
    return shared.groupBy("row", "family").agg(F.max("similarity").alias("similarity"))


def _plain_paragraphs(documents: DataFrame) -> DataFrame:
    """(words): at most ``TRAIN_LINES`` paragraphs of a bounded sample of the corpus that are far from every template."""
    texts = hash_share(documents.where(F.col("doc_id").isNotNull()), TRAIN_LINES // 4, "doc_id").where(F.octet_length("text") <= TRAIN_BYTES)
    some = texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text").limit(TRAIN_LINES // 4)
    lines = some.select(F.explode(F.split("text", _PARAGRAPHS)).alias("line")).where(~F.col("line").rlike(_SPEAKS))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(TRAIN_LINES)
    lines = cut(lines.select(F.monotonically_increasing_id().alias("row"), _tells(F.col("line")).alias("tells"), words_of(F.col("line")).alias("words")), "licence-plain")
    grams = lines.where("tells").select("row", grams_of(F.col("words")).alias("g")).select("row", F.size("g").alias("size"), F.explode("g").alias("gram"))
    near = _likeness(grams).where(F.col("similarity") >= FAR).select("row").distinct()
    return lines.join(near, "row", "left_anti").select("words")


def training_rows(documents: DataFrame) -> DataFrame:
    """(family, half, words, weight): windows of templates and of lines of no family, and plain paragraphs.

    All windows of a line are in one half. They weigh as much as the whole line
    does beside them, so long templates do not outweigh short ones.
    """
    spark = documents.sparkSession
    fixed = [{"family": f, "template": n, "line": x} for f, lines in ((_UNKNOWN, UNFAMILIAR), (_NONE, [*PLAIN, "the way of the other is in a book"])) for n, x in enumerate(lines)]
    fixed = _table(spark, fixed, "family string, template int, line string").select("family", "template", words_of(F.col("line")).alias("words"))
    lines = _templates(spark).select("family", "template", "words").unionByName(fixed).withColumn("whole", F.size("words"))
    windows = _windows(lines).withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("family", "template")) + (F.size("words") == F.col("whole")).cast("int"))
    several = windows.groupBy("words").agg(F.count_distinct("family").alias("families"))
    family = F.when((F.col("families") > 1) & (F.col("family") != _NONE), _UNKNOWN).otherwise(F.col("family"))
    windows = windows.join(several, "words").select(family.alias("family"), (F.col("template") % 2).alias("half"), "words", "weight")
    plain = _plain_paragraphs(documents).select(F.lit(_NONE).alias("family"), F.pmod(F.xxhash64("words"), F.lit(2)).cast("int").alias("half"), "words", F.lit(PLAIN_WEIGHT).alias("weight"))
    return windows.unionByName(plain)


def train(documents: DataFrame) -> LicenseModel:
    """Fit on ``training_rows``; the least probability of a claim comes from halves judged by the other half's model."""
    from pyspark.ml.functions import vector_to_array

    spark = documents.sparkSession
    grams = _templates(spark).select(F.explode(grams_of(F.col("words"))).alias("gram")).distinct()
    vocabulary = sorted(r[0] for r in grams.where(~F.col("gram").isin(*COMMON)).collect())
    classes = [_NONE, _UNKNOWN, *TEMPLATES]
    names = F.array(*[F.lit(c) for c in classes])
    label = F.array_position(names, F.col("family")).cast("double") - 1
    rows = training_rows(documents).select("family", "half", label.alias("label"), "weight", grams_of(F.col("words")).alias("grams")).coalesce(1)
    featured = cut(CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True).transform(rows).drop("grams"), "licence-lines")
    learner = LogisticRegression(regParam=2e-4, maxIter=80, family="multinomial", standardization=False, weightCol="weight")
    claims = None
    for half in (0, 1):
        judged = learner.fit(featured.where(F.col("half") != half)).transform(featured.where(F.col("half") == half))
        judged = judged.select("family", vector_to_array("probability").alias("p"), (F.col("prediction").cast("int") + 1).alias("k")).where("k > 2")
        judged = judged.select((F.element_at(names, F.col("k")) != F.col("family")).alias("wrong"), F.element_at("p", F.col("k")).alias("p"))
        claims = judged if claims is None else claims.unionByName(judged)
    falls = claims.withColumn("share", F.avg(F.col("wrong").cast("double")).over(Window.orderBy(F.col("p").desc())))
    least = falls.where(F.col("share") <= FALSE_CLAIMS).agg(F.min("p")).first()[0]
    fitted = learner.fit(featured)
    return LicenseModel(classes, vocabulary, fitted.coefficientMatrix.toArray().tolist(), list(fitted.interceptVector), 1.0 if least is None else least)


def scan(documents: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, line_no, family, probability, similarity) for every paragraph that states a licence.

    ``family`` is a key of ``TEMPLATES``, or ``unknown`` for a licence-like line
    whose family is not sure or not confirmed. ``line_no`` is the paragraph's first telling line, from 0. Null
    and empty texts state nothing. Repeated ids and rows with null ids count like
    others. Extra columns are ignored.
    """
    spark = documents.sparkSession
    model = model or train(documents)
    found = cut(_paragraphs(documents).select("row", "doc_id", "line_no", words_of(F.col("line")).alias("words")), "licence-found")
    found = found.select("row", "doc_id", "line_no", grams_of(F.col("words")).alias("grams"))
    grams = found.select("row", "doc_id", "line_no", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    zero = F.array(*[F.lit(0.0)] * len(model.classes))
    scored = grams.join(F.broadcast(model.table(spark)), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.classes))]
    scored = scored.groupBy("row", "doc_id", "line_no").agg(*sums)
    logits = F.array(*[F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.intercepts)])
    scored = scored.select("row", "doc_id", "line_no", logits.alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.array_max("z")))
    best = F.array_position("z", F.array_max("z")).cast("int")
    judged = scored.select("row", "doc_id", "line_no", F.element_at(F.array(*[F.lit(c) for c in model.classes]), best).alias("claim"), (1 / total).alias("probability")).where(F.col("claim") != _NONE)

    shared = _likeness(grams).withColumnRenamed("family", "claim")
    # A merge join at every size: both sides grow with the lines found.
    both = judged.join(shared.hint("merge"), ["row", "claim"], "left")
    both = both.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("claim") != _UNKNOWN) & (F.col("probability") >= model.least) & (F.col("similarity") >= LEAST_SHARED)
    return both.select("doc_id", "line_no", F.when(sure, F.col("claim")).otherwise(_UNKNOWN).alias("family"), "probability", "similarity")
