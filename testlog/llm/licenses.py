"""License scans by an exact set-similarity join (DataFrame functions only).

Texts are cut into overlapping blocks of ``BLOCK`` words, ``STRIDE`` apart, so that every
run of STRIDE words lies whole in one of them.  A block matches a template when it
holds a share of ``THRESHOLD`` or more of the template's distinct words.  The join is
exact and never compares all pairs: words are ordered by how many documents have them,
rarest first; a template of n words that needs o of them has a match only in blocks
that hold one of its first n - o + 1 words (prefix filter), that have o words of the
vocabulary (length filter), and in which enough words remain on both sides from the
first common one on (positional filter).  The candidates are counted out.

Beside the templates, fixed phrases are looked for word by word; their labels stay.

Defined results: a null text counts as empty and has no words and labels; repeated
rows give equal rows; rows without an id are scanned like others; an empty table
gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.operators.durable import store

# Phrases of successive words and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# The usual wording of license notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)

THRESHOLD = 0.9
STRIDE = 32  # no template is longer
BLOCK = 2 * STRIDE
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
P = "__l_"


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(NO_WORD, text.lower()) if w))


def needed(size: int) -> int:
    return math.ceil(THRESHOLD * size - 1e-9)


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(docs: DataFrame) -> DataFrame:
    """Row key, id and the words of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias(P + "row"),
        F.array_remove(F.split(F.lower(text), NO_WORD), "").alias(P + "words"),
    )


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, words of the fewest documents first.

    The counts of at most ``len(vocabulary)`` words come to the driver.
    """
    seen = _words(docs).select(F.explode(F.array_intersect(P + "words", _array(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _templates(docs: DataFrame, order: list[str]) -> DataFrame:
    """One row per template: label, ranks in the global order, words needed."""
    rank = {w: i for i, w in enumerate(order, 1)}
    rows = []
    for label, text in TEMPLATES:
        ranks = sorted(rank[w] for w in template_words(text))
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                F.array(*[F.lit(r) for r in ranks]).alias("template"),
                F.lit(needed(len(ranks))).alias("needed"),
            )
        )
    one = docs.sparkSession.range(1)
    return one.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def matches(words: DataFrame, order: list[str]) -> DataFrame:
    """(row, label, score) of every block and template that reach the threshold."""
    templates = _templates(words, order)
    rank = {w: i for i, w in enumerate(order, 1)}
    prefix_words = set()
    for _, text in TEMPLATES:
        ordered = sorted(template_words(text), key=rank.get)
        prefix_words.update(ordered[: len(ordered) - needed(len(ordered)) + 1])
    least = min(needed(len(template_words(t))) for _, t in TEMPLATES)
    prefix_ranks = sorted(rank[w] for w in prefix_words)

    vocabulary = _array(order)
    # documents without a prefix word or with too few words of the vocabulary have no match
    some = words.filter(F.arrays_overlap(P + "words", _array(sorted(prefix_words)))).filter(
        F.size(F.array_intersect(P + "words", vocabulary)) >= least
    )
    placed = some.select(
        P + "row",
        F.posexplode(P + "words").alias("place", "word"),
    ).filter(F.col("word").isin(order))
    at = F.floor(F.col("place") / STRIDE).cast("int")
    blocks = (
        placed.select(
            P + "row",
            F.explode(F.array(at - 1, at)).alias("block"),
            F.array_position(vocabulary, F.col("word")).cast("int").alias("rank"),
        )
        .groupBy(P + "row", "block")
        .agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
        .filter((F.size("ranks") >= least) & F.arrays_overlap("ranks", F.array(*[F.lit(r) for r in prefix_ranks])))
    )
    index = templates.select(
        "label", "template", "needed", F.posexplode("template").alias("template_place", "rank")
    ).filter(F.col("template_place") <= F.size("template") - F.col("needed"))
    candidates = (
        blocks.select(P + "row", "block", "ranks", F.posexplode("ranks").alias("block_place", "rank"))
        .join(index, "rank")
        .filter(F.size("ranks") >= F.col("needed"))
        .filter(F.size("template") - F.col("template_place") >= F.col("needed"))
        .filter(F.size("ranks") - F.col("block_place") >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("ranks", "template"))
    return (
        candidates.select(P + "row", "label", shared.alias("shared"), "needed", F.size("template").alias("size"))
        .filter(F.col("shared") >= F.col("needed"))
        .select(P + "row", "label", (F.col("shared") / F.col("size")).alias("score"))
    )


def _phrase_starts(words: DataFrame) -> DataFrame:
    """Add the places where each phrase starts; words are looked at around the last word only."""
    out = words
    last_words = sorted({phrase.split()[-1] for phrase in PHRASES})
    for word in last_words:
        out = out.withColumn(
            P + "at_" + word,
            F.when(
                F.array_contains(P + "words", word),
                F.array_remove(
                    F.transform(P + "words", lambda w, i: F.when(w == word, i).otherwise(-1)), -1
                ),
            ).otherwise(F.array().cast("array<int>")),
        )
    for number, phrase in enumerate(PHRASES):
        parts = phrase.split()

        def stands(place: Column, parts: list[str] = parts) -> Column:
            good = place >= len(parts) - 1
            for back, part in enumerate(reversed(parts[:-1]), 1):
                good = good & (F.get(F.col(P + "words"), place - back) == part)
            return good

        ends = F.filter(P + "at_" + parts[-1], _one(stands))
        out = out.withColumn(P + f"start_{number}", F.transform(ends, _one(_back(len(parts) - 1))))
    return out


def _one(fn):
    """A lambda of exactly one parameter, as Spark's higher-order functions ask for."""
    return lambda x: fn(x)


def _back(steps: int):
    return lambda place: (place - steps).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, phrase places, base_labels, labels and score."""
    vocabulary = sorted({w for _, text in TEMPLATES for w in template_words(text)})
    order = global_order(docs, vocabulary)
    words = _words(docs)
    starts = [P + f"start_{k}" for k in range(len(PHRASES))]
    found = _phrase_starts(words)
    labels = list(PHRASES.values())
    named = F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, label in zip(starts, labels)])
    base = found.select(
        "doc_id",
        P + "row",
        F.size(P + "words").cast("long").alias("n_words"),
        F.concat(*starts).alias(P + "starts"),
        F.array_sort(F.array_distinct(F.array_compact(named))).alias(P + "base"),
    )
    per_row = store(
        matches(words, order)
        .groupBy(P + "row")
        .agg(F.collect_set("label").alias(P + "more"), F.max("score").alias("score"))
    )
    every = F.array_sort(F.array_distinct(F.concat(P + "base", F.coalesce(P + "more", F.array().cast("array<string>")))))
    return (
        base.join(per_row, P + "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.size(P + "starts").cast("long").alias("n_base"),
            F.array_min(P + "starts").alias("first_word"),
            F.array_max(P + "starts").alias("last_word"),
            F.array_join(P + "base", ",").alias("base_labels"),
            F.array_join(every, ",").alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
