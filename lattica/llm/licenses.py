"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Paragraphs end at blank lines; marks of comments at the beginning of lines are dropped first. A paragraph is looked at
by its lines and by the sentences of its joined lines, so that neither a notice on a line of its own nor one that is
wrapped over many is missed. Features are the distinct word n-grams (1 to 3 words) that hold a stem of
STEMS; a multinomial logistic regression over them, trained on the templates, shortened forms of them and sentences that
only sound alike, gives each family and the class ``unknown`` a probability, calibrated by a temperature on forms that
were not trained on. Lines and sentences without a feature are ``unknown`` whatever the model, so only texts with a stem are
cut up. A prediction of MINIMUM or more is confirmed if the line or sentence shares CONFIRMED of the words of a template
of that family. Paragraphs with a stem that are confirmed as nothing are reported as ``unknown``.

Training is a few hundred short fixed texts on the driver. The scan is DataFrame and SQL functions; weights and
templates, whose size is fixed by the code, are broadcast.

Defined results: null and empty texts have no paragraphs; documents without a stem have no row; one row for each
document row and family, ``unknown`` among them; repeated rows give repeated results; doc_id may be null; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINIMUM, CONFIRMED, GRAMS = 0.5, 0.6, 3

#: Parts of words that notices have.
STEMS = ["licen", "copyright", "warrant", "redistribut", "permission", "rights", "gpl", "gnu", "apache", "mozilla", "creative", "public domain", "spdx", "cc by"]
#: As they may stand in raw text; a text or paragraph without any of these has no feature.
RAW = [*STEMS, "cc-by"]

#: Usual notices of each family.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "you may obtain a copy of the license at", "spdx license identifier apache 2 0"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this project is licensed under the mit license", "spdx license identifier mit"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program", "released under the gpl v3 license", "spdx license identifier gpl 3 0 only"],
    "lgpl": ["licensed under the gnu lesser general public license version 2 1", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", "released under the lgpl license", "spdx license identifier lgpl 2 1 only"],
    "agpl": ["licensed under the gnu affero general public license version 3", "you should have received a copy of the gnu affero general public license along with this program", "released under the agpl license", "spdx license identifier agpl 3 0 only"],
    "bsd": ["released under the bsd license", "licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "spdx license identifier bsd 3 clause"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under a creative commons by nc license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "text is available under the creative commons attribution license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "text is available under the creative commons attribution sharealike license"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc"],
    "public-domain": ["this work is in the public domain", "released into the public domain", "this is free and unencumbered software released into the public domain", "licensed under cc0 1 0 public domain dedication"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without prior written permission of the copyright holder", "unauthorised copying of this file is prohibited all rights reserved"],
}
#: Sentences with the same words that are no notices.
OTHERS = [
    "she lost her driving license on the way home", "the license of the pub was not renewed", "a fishing license costs ten euros a year", "he asked for permission to leave the room", "permission was denied by the officer",
    "the court spoke of human rights and civil rights", "equal rights for all people", "the warranty of the car ends in may", "a warrant was issued for his arrest", "copyright law is taught in the second year",
    "the apache helicopter landed at noon", "the apache people lived in the south", "the gnu grazes on the plains with zebras", "a creative mind finds a way", "creative writing is a course for adults",
    "the committee discussed how licences are priced", "redistribution of wealth was the topic of the debate", "the rights to the film were sold", "what a license to print money", "licensed plumbers earn more", "the library of public domain books in town is closed", "mozilla released a new browser",
]
UNKNOWN = "unknown"


def grams_of(paragraph: str) -> set[str]:
    words = re.findall(r"[^\W_]+", paragraph.lower())
    found = (" ".join(words[i : i + k]) for k in range(1, GRAMS + 1) for i in range(len(words) - k + 1))
    return {g for g in found if any(s in g for s in STEMS)}


def _shortened(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    keep = rng.random(len(words)) > 0.2
    return " ".join(w for w, k in zip(words, keep) if k)


@functools.cache
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Families (unknown last), weights of each n-gram, biases and the temperature."""
    rng = np.random.default_rng(9)
    families = [*TEMPLATES, UNKNOWN]
    texts = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in OTHERS] + [(s, UNKNOWN) for s in STEMS]
    train = texts + [(_shortened(t, rng), f) for t, f in texts for _ in range(4)]
    held = [(_shortened(t, rng), f) for t, f in texts for _ in range(2)]
    index = {g: i for i, g in enumerate(sorted({g for t, _ in train for g in grams_of(t)}))}

    def design(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(index) + 1))
        x[:, -1] = 1
        for r, (t, _) in enumerate(rows):
            x[r, [index[g] for g in grams_of(t) if g in index]] = 1
        return x, np.eye(len(families))[[families.index(f) for _, f in rows]]

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    x, y = design(train)
    empty = np.zeros((20, x.shape[1]))
    empty[:, -1] = 1
    x, y = np.vstack([x, empty]), np.vstack([y, np.tile(np.eye(len(families))[-1], (20, 1))])
    w = np.zeros((x.shape[1], len(families)))
    for _ in range(600):
        w -= 2.0 * (x.T @ (softmax(x @ w) - y) / len(x) + 1e-4 * w)
    x, y = design(held)
    loss = {t: -np.log((softmax(x @ w / t) * y).sum(1) + 1e-12).mean() for t in np.arange(0.5, 4.01, 0.1)}
    weights = {g: w[i].round(6).tolist() for g, i in index.items() if np.abs(w[i]).max() > 1e-4}
    return families, weights, w[-1].round(6).tolist(), round(float(min(loss, key=loss.get)), 2)


def _has_stem(text: Column, stems: list[str] = RAW) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in stems])


def paragraphs(docs: DataFrame) -> DataFrame:
    """key, at (of the paragraph), part, words of the lines and sentences that may have a feature; texts that are equal
    give one set of rows."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(text.alias("text")).where(_has_stem(F.col("text"))).select(_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    plain = F.regexp_replace("text", r"(?m)^[ \t]*+(?:(?:/\*+|\*+/?|//+|#+|;+|%+|--+|<!-+)[ \t]*+)*+", "")
    cut = rows.select("key", F.posexplode(F.split(plain, r"\n\s*\n")).alias("at", "paragraph")).where(_has_stem(F.regexp_replace("paragraph", r"\s+", " ")))
    sentences = F.split(F.regexp_replace("paragraph", r"\s+", " "), r"(?<=[.!?]) ")
    lines = F.split("paragraph", r"\n|(?<=[.!?])\s+")
    parts = cut.select("key", "at", F.posexplode(F.filter(F.array_distinct(F.concat(sentences, lines)), lambda x: _has_stem(x))).alias("part", "text"))
    return parts.select("key", "at", "part", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words")).where(F.size("words") > 0)


def _key(lowered: Column) -> Column:
    return F.unhex(F.md5(lowered.cast("binary")))


def _grams(k: int) -> Column:
    last = F.size("words") - k
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice("words", i + 1, k)))


def identified(docs: DataFrame) -> DataFrame:
    """key, at, family, probability, similarity of paragraphs: the confirmed families, or unknown where there is none."""
    spark = docs.sparkSession
    families, weights, bias, temperature = model()
    table = F.broadcast(spark.createDataFrame(list(weights.items()), "gram string, w array<double>"))
    templates = F.broadcast(spark.createDataFrame([(f, [sorted(set(t.split())) for t in ts]) for f, ts in TEMPLATES.items()], "family string, templates array<array<string>>"))
    part = ["key", "at", "part"]
    grams = F.filter(F.array_distinct(F.concat(*[_grams(k) for k in range(1, GRAMS + 1)])), lambda g: _has_stem(g, STEMS))
    # Words travel beside the n-grams, which are few: a part is looked at once, and no table is written between.
    met = paragraphs(docs).select(*part, "words", F.explode_outer(grams).alias("gram")).join(table, "gram", "left")
    sums = met.groupBy(*part).agg(F.any_value("words").alias("words"), *[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(families))])
    z = F.array(*[(F.col(f"s{i}") + b) / temperature for i, b in enumerate(bias)])
    p = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    met = F.col("s0").isNotNull()
    scored = sums.select(*part, "words", F.when(met, z).alias("z")).select(*part, "words", p.alias("p")).withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, b: a + b))
    best = F.array_position("p", F.array_max("p")).cast("int")
    # A part with a stem but none of the model's n-grams is unknown by the biases alone.
    top = max(bias)
    prior = float(np.exp((bias[-1] - top) / temperature) / sum(np.exp((b - top) / temperature) for b in bias))
    unknown = F.coalesce(F.get("p", F.lit(len(families) - 1)) / F.col("total"), F.lit(prior))
    scored = scored.select("key", "at", "words", (F.array_max("p") / F.col("total")).alias("probability"), unknown.alias("unknown"), F.element_at(F.array(*map(F.lit, families)), best).alias("family"))
    likely = (F.col("family") != UNKNOWN) & (F.col("probability") >= MINIMUM)
    similarity = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("words"))) / F.size(t)))
    compared = scored.join(templates, "family", "left").withColumn("similarity", F.when(likely, similarity)).withColumn("confirmed", F.coalesce(F.col("similarity") >= CONFIRMED, F.lit(False)))
    chosen = [F.when(F.col("confirmed"), F.col(c)).otherwise(other).alias(c) for c, other in (("family", F.lit(UNKNOWN)), ("probability", F.col("unknown")), ("similarity", F.lit(0.0)))]
    by_family = compared.select("key", "at", *chosen).groupBy("key", "at", "family").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    found = by_family.groupBy("key", "at").agg(F.collect_list(F.struct("family", "probability", "similarity")).alias("found"))
    confirmed = F.filter("found", lambda x: x["family"] != UNKNOWN)
    return found.select("key", "at", F.inline(F.when(F.size(confirmed) > 0, confirmed).otherwise(F.col("found"))))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, family, n_paragraphs, probability and similarity (the greatest of them)."""
    by_text = identified(docs).groupBy("key", "family").agg(F.count("*").alias("n_paragraphs"), F.round(F.max("probability"), 4).alias("probability"), F.round(F.max("similarity"), 4).alias("similarity"))
    text = F.lower(F.coalesce("text", F.lit("")))
    keys = docs.select("doc_id", text.alias("text")).where(_has_stem(F.col("text"))).select("doc_id", _key(F.col("text")).alias("key"))
    return keys.join(by_text, "key").drop("key")
