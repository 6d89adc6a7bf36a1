"""Licence scans: a trained paragraph classifier with template confirmation.

Everything on the path over the texts is DataFrame and SQL functions.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.names import column

UNKNOWN = "unknown"
#: How each licence family is named, most telling name first.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0"],
    "BSD": ["BSD License", "3-Clause BSD License", "BSD-3-Clause", "2-Clause BSD License", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL-2.0"],
    "ISC": ["ISC License", "ISC licence"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "CC-BY-ND-4.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "Zlib licence"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License", "EPL-2.0"],
    "Proprietary": ["all rights reserved", "proprietary and confidential", "unauthorized copying is prohibited"],
}
#: Paragraphs of the licences themselves, and of the notices that apply them.
TERMS: dict[str, list[str]] = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "you may not use this file except in compliance with the License",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.',
    ],
    "CC0-1.0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.", "has waived all copyright and related or neighboring rights to this work"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Proprietary": ["No part of this document may be reproduced or transmitted in any form without the prior written permission of the publisher"],
}
#: Sentences around a name, and sentences that only look like a licence.
CARRIERS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "This software is made available under {}, see the file for details.", "SPDX-License-Identifier: {}", "{}", "The text of this page is published under {}.", "License: {}"]
UNRELATED = [
    "You need a driving license to rent this car.", "His fishing licence expired last year.", "The warranty of the device covers two years of use.", "Copyright law protects the authors of books.", "The work is done.", "The version of the story that we know is old.",
    "The software runs on any computer.", "He asked for permission to use the room.", "The terms of the contract were clear.", "The public library opens at nine.", "A general came to the city with his men.", "The foundation was free of charge for visitors.", "See the file for details.",
    "The museum holds the source of this story in binary form.", "Apache helicopters flew over the valley.", "She studied at MIT and works on software.", "The Mozilla foundation has an office here.", "GNU is an animal that lives in herds.", "Version 3 of the plan was released under pressure.", "The commons were open to all people of the village.",
    "This work is published in two parts.", "The project is available in four languages.", "The attribution of the painting is not certain.", "They reserved all seats in the hall.", "All rights come with duties.", "The document may be signed by the publisher.", "A license number is written on the plate.", "The city is released from its terms.",
    "The of and to in is that it for on as with was by this be at from.", "the and of", "", "page 2 of 3", "It was made in 2.0 hours by 4.0 people.", "The program is broadcast on the radio at ten.", "You can modify the recipe and use it later.", "The conditions are met by the provider.", "Contributors may send their names to the editor.",
    "An eclipse of the sun was seen in public.", "The boost in sales came without any fee.", "The damages were paid by the holder of the shop.", "The author gave notice of the event.", "Any person may bring a claim in this action.", "The list of the following names is provided as is.", "She will distribute copies of the book to anyone.",
]
#: What the calibration is measured on, in other words than the training set's.
HELD_CARRIERS = ["You may copy this code, its licence is the {}", "All files in this folder are covered by {} unless noted", "the {} applies to this package", "We publish our data set under {} since last year.", "licensed {}", "Code: {}. Pictures: see below."]
HELD_UNRELATED = [
    "The council granted a licence to sell food in the square.", "Her software helps people to find a job.", "Read the conditions before you buy the ticket.", "The copyright of the song was sold to a company.", "Two versions of the play are known, and both are free.", "The general public was not admitted to the foundation's garden.",
    "The creative class moved to the commons of the old town.", "Permission to build was refused by the mayor.", "The source of the river is not on any map.", "Anyone who wants a copy can write to the author.", "MIT and other schools take part in the contest.", "The warranties that come with a car are limited.",
    "The distribution of seats is done by lot.", "No part of the house was left in its original form.", "All rights to the land were reserved for the king.", "The terms under which they work are published each year.", "The zip code is 2.0 and the version is 3.", "Use the form at the end of this document.", "The files were provided by the police in this action.",
    "He obtained the book free of charge.", "The eclipse was public and the version of it 2.0.", "Attribution of the letter to her is a mistake.", "It is distributed by mail.", "The notice was put up above the door.",
]
STOP = set("a an and any are as at be been but by can for from has have in is it its may not of on or shall that the their these this those to was were which will with you your all above into".split())
#: What parts paragraphs: lines without a word.
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
#: Shares that a template's grams must reach in a paragraph.
CONFIRM = 0.6
#: Pairs of words that a template must have to be looked for over several lines.
PAIRS = 3


def _constant(value: list, kind: str) -> Column:
    """One literal: thousands of nested ones would take the planner seconds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def words(text: Column) -> Column:
    """Lower-cased words: letters, digits and what isn't ASCII, with . + - inside."""
    return F.split(F.trim(F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[.+-]*[^a-z0-9.+\x{80}-\x{10FFFF}-]+[.+-]*", " ")), " ")


def grams(of: Column) -> Column:
    """Words and neighbouring pairs of them."""
    pairs = F.zip_with(of, F.slice(of, F.lit(2), F.greatest(F.size(of) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(of, F.filter(pairs, lambda p: p.isNotNull()))


def _local_grams(text: str) -> set[str]:
    of = re.sub(r"[.+-]*[^a-z0-9.+\x80-\U0010FFFF-]+[.+-]*", " ", f" {text.lower()} ").strip(" ").split(" ")
    return {*of, *(f"{a} {b}" for a, b in zip(of, of[1:], strict=False))}


def samples() -> list[tuple[str, str]]:
    """(family, paragraph) of the training set: names in carriers, terms whole and
    in halves, and unrelated sentences, each alone and behind another one."""
    out = [(f, c.format(n)) for f, names in NAMES.items() for n in names for c in CARRIERS]
    for f, terms in TERMS.items():
        for t in terms:
            half = len(t) // 2
            out += [(f, t), (f, t[: t.rfind(" ", 0, half + 20)]), (f, t[t.find(" ", half - 20) :]), *((f, f"{c.format(NAMES[f][0])} {t}") for c in CARRIERS[:4])]
    out += [(UNKNOWN, t) for t in UNRELATED] * 3
    return out + [(UNKNOWN, f"{a} {b}") for k, a in enumerate(UNRELATED) for b in UNRELATED[k % 3 :: 3]]


def held_out() -> list[tuple[str, str]]:
    """(family, paragraph) of the calibration set, none of whose sentences is trained on."""
    out = [(f, c.format(n)) for f, names in NAMES.items() for n in names for c in HELD_CARRIERS]
    out += [(f, f"{a} {t[t.find(' ', len(t) // 3) : t.rfind(' ', 0, 9 * len(t) // 10)]}") for f, terms in TERMS.items() for k, t in enumerate(terms) for a in (HELD_UNRELATED[k],)]
    return out + [(UNKNOWN, t) for t in HELD_UNRELATED] + [(UNKNOWN, f"{a} {b}") for k, a in enumerate(HELD_UNRELATED) for b in HELD_UNRELATED[k % 4 :: 4]]


@dataclass
class Model:
    families: list[str]
    vocabulary: list[str]
    weights: list[list[float]]  # by gram, then family
    bias: list[float]
    templates: list[tuple[int, list[int]]]  # family, grams
    temperature: float = 1.0
    threshold: float = 0.5

    def logits(self, ids: Column) -> Column:
        w = _constant(self.weights, "array<array<double>>")
        return F.aggregate(ids, _constant(self.bias, "array<double>"), lambda acc, i: F.zip_with(acc, F.element_at(w, i + 1), lambda a, b: a + b))

    def judged(self, df: DataFrame) -> DataFrame:
        """df (with ids, the distinct grams in the vocabulary, of so many lines, size)
        with family, probability and similarity. Of several lines only pairs of words
        are compared, with templates of PAIRS or more: words of a template that stand
        anywhere in a long run say little."""
        x = df.withColumn("_z", F.transform(self.logits(F.col("ids")), lambda z: z / F.lit(self.temperature)))
        x = x.withColumn("_top", F.array_max("_z")).withColumn("_best", F.array_position("_z", F.col("_top")).cast("int") - 1)
        x = x.withColumn("probability", 1 / F.aggregate("_z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("_top"))))
        pairs = [(f, [i for i in g if " " in self.vocabulary[i]]) for f, g in self.templates]
        near = []
        for some in (self.templates, [(f, g) for f, g in pairs if len(g) >= PAIRS]):
            t = _constant([{"f": f, "g": g} for f, g in some], "array<struct<f:int,g:array<int>>>")
            near.append(F.array_max(F.transform(F.filter(t, lambda v: v.f == F.col("_best")), lambda v: F.size(F.array_intersect(v.g, F.col("ids"))) / F.size(v.g))))
        best = F.when(F.col("size") > 1, near[1]).otherwise(near[0])
        names = F.array(*map(F.lit, self.families))
        return x.withColumn("similarity", F.coalesce(best, F.lit(0.0))).withColumn("family", F.element_at(names, F.col("_best") + 1)).drop("_z", "_top", "_best")


_trained: dict[str, Model] = {}


def trained(spark: SparkSession) -> Model:
    """train(), once an application."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        _trained[key] = train(spark)
    return _trained[key]


def train(spark: SparkSession) -> Model:
    """Multinomial logistic regression on samples(), a fixed set of a bounded size.

    Temperature and threshold are chosen on held_out(), which shares no sentence
    with it: the temperature with the least log loss, and as threshold the highest
    probability that an unrelated paragraph gets for any family, so that none of
    them passes.
    """
    rows = samples()
    data = spark.createDataFrame(rows, "name string, text string").coalesce(1).withColumn("grams", F.array_distinct(grams(words(F.col("text"))))).cache()
    seen = set().union(*(_local_grams(t) for f, t in rows if f != UNKNOWN))
    informative = lambda g: not set(g.split()) <= STOP and (len(g) > 2 or g.isalpha())
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 16).fit(data)
    keep = [g for g in counted.vocabulary if g in seen and informative(g)]
    vectors = CountVectorizerModel.from_vocabulary(keep, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    families = [UNKNOWN, *NAMES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("name")) - 1
    fit = LogisticRegression(regParam=2e-4, maxIter=60, family="multinomial").fit(vectors.transform(data.withColumn("label", label.cast("double"))))
    data.unpersist()
    w, at = fit.coefficientMatrix.toArray(), {g: i for i, g in enumerate(keep)}
    ids = lambda t: sorted(at[g] for g in _local_grams(t) if g in at)
    templates = sorted({(families.index(f), tuple(ids(t))) for d in (NAMES, TERMS) for f, ts in d.items() for t in ts if ids(t)})
    model = Model(families, keep, [[round(float(x), 6) for x in col] for col in w.T], [round(float(x), 6) for x in fit.interceptVector], [(f, list(g)) for f, g in templates])
    held = []
    for f, t in held_out():
        z = list(model.bias)
        for i in ids(t):
            z = [a + b for a, b in zip(z, model.weights[i], strict=True)]
        held.append((families.index(f), z))

    def share(z: list[float], k: int, heat: float) -> float:
        top = max(z)
        return math.exp((z[k] - top) / heat) / sum(math.exp((x - top) / heat) for x in z)

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=lambda heat: -sum(math.log(max(share(z, k, heat), 1e-12)) for k, z in held))
    wrong = [share(z, k, model.temperature) for f, z in held if not f for k in range(1, len(families)) if max(z) == z[k]]
    model.threshold = round(max([0.5, *wrong]) + 1e-6, 6)
    return model


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """For each row: id, n_paragraphs, n_licences (confirmed findings), families
    (sorted), n_unconfirmed (a family is predicted, but no template of it is near)
    and findings, an array of (line, lines, family, probability, similarity,
    confirmed) in the order of the text.

    Paragraphs are told by blank lines. Within them, runs of neighbouring lines
    with a word of the vocabulary are judged as one, and each of their lines for
    itself, so that a wrapped licence is found as well as one that is named in a
    line. Both are of a family if the classifier's calibrated probability for that
    reaches the threshold, and confirmed if they have CONFIRM of the grams of one of
    the family's templates; all others are unknown. A run's finding is left out if
    one of its lines confirms the family. A line's is left out if it only suggests
    the family of a confirmed run, or confirms another with less likeness than the
    run has, as the first line of "Creative Commons / Attribution-ShareAlike" does. Null and empty texts have no paragraphs. Rows that repeat
    come back repeated. Other columns aren't read; empty tables give empty results.

    Only lines with a word of the vocabulary are shuffled, once, by row, with one
    marker for each row of docs. Their grams meet the vocabulary, which has a fixed
    size, in a broadcast join.
    """
    spark = docs.sparkSession
    model = model or trained(spark)
    vocabulary = F.broadcast(spark.createDataFrame([*((g, i) for i, g in enumerate(model.vocabulary)), ("\n", -1)], "gram string, id int"))
    known = _constant(sorted({w for g in model.vocabulary for w in g.split(" ")} - STOP), "array<string>")
    text = F.coalesce(column(text_col), F.lit(""))
    has_word = lambda p: p.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc"), F.size(F.filter(F.split(text, BLANK), has_word)).alias("n"), F.split(text, "\n").alias("lines"))
    lines = rows.select("row", "doc", "n", F.posexplode("lines").alias("at", "line")).withColumn("words", words(F.col("line"))).withColumn("hit", F.arrays_overlap("words", known))
    # the first line also carries the row's marker
    kept = lines.where("hit or at = 0").select("row", "doc", "n", "at", "hit", F.when(F.col("hit"), F.col("words")).alias("words"))
    # lines that follow each other have the same difference to their rank
    apart = F.col("at") - F.row_number().over(W.partitionBy("row", "hit").orderBy("at"))
    runs = kept.repartition("row").withColumn("apart", F.when(F.col("hit"), apart)).groupBy("row", "doc", "n", "hit", "apart").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x"))
    one = F.transform("x", lambda v: F.struct(v.at.alias("at"), F.lit(1).alias("size"), v.words.alias("words")))
    whole = F.array(F.struct(F.col("x")[0].at.alias("at"), F.size("x").alias("size"), F.flatten(F.col("x.words")).alias("words")))
    units = runs.select("row", "doc", "n", "hit", "apart", F.explode(F.when(F.size("x") > 1, F.concat(one, whole)).otherwise(one)).alias("u"))
    mark, none = F.array(F.lit("\n")), F.array().cast("array<string>")
    cut = F.concat(F.when(F.col("u.at") == 0, mark).otherwise(none), F.when(F.col("hit"), grams(F.col("u.words"))).otherwise(none))
    met = units.select("row", "doc", "n", "apart", "u.at", "u.size", F.explode(F.array_distinct(cut)).alias("gram")).join(vocabulary, "gram")
    found = met.groupBy("row", "doc", "n", "apart", "at", "size").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    judged = model.judged(found.withColumn("ids", F.filter("ids", lambda i: i >= 0)))
    licensed = (F.size("ids") > 0) & (F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold)
    finding = F.struct(F.col("at").alias("line"), F.col("size").alias("lines"), "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= CONFIRM).alias("confirmed"))
    each = judged.withColumn("finding", F.when(licensed, finding)).groupBy("row", "doc", "n", "apart").agg(F.collect_list("finding").alias("all"))
    # confirmed families of the run's lines, and of the run as a whole
    by_line = F.transform(F.filter("all", lambda x: x.confirmed & (x.lines == 1)), lambda x: x.family)
    by_run = F.transform(F.filter("all", lambda x: x.confirmed & (x.lines > 1)), lambda x: x.family)
    best = F.coalesce(F.array_max(F.transform(F.filter("all", lambda x: x.confirmed & (x.lines > 1)), lambda x: x.similarity)), F.lit(0.0))
    own = lambda x: F.array_contains(by_run, x.family)
    told = F.filter("all", lambda x: F.when(x.lines > 1, ~F.array_contains(by_line, x.family)).otherwise(F.when(x.confirmed, own(x) | (x.similarity >= best)).otherwise(~own(x))))
    each = each.withColumn("all", told).groupBy("row", "doc", "n").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("findings"))
    sure = F.filter("findings", lambda x: x.confirmed)
    return each.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_paragraphs"),
        F.size(sure).alias("n_licences"),
        F.array_sort(F.array_distinct(F.transform(sure, lambda x: x.family))).alias("families"),
        (F.size("findings") - F.size(sure)).alias("n_unconfirmed"),
        "findings",
    )
