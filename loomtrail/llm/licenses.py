"""License scans by diagonal voting.

Rolling hashes of word pairs of every text are joined with the pairs of known phrases. A match at word
``p`` of the text and word ``q`` of the phrase votes for the diagonal ``p - q``: where the phrase would
begin. Votes are added up by diagonal, neighbouring diagonals (words put in or left out) are merged to
one span, and spans with votes enough are verified on the words themselves. Base phrases must
stand word by word on one diagonal; templates must have ``LEAST_COVERED`` of their distinct words in the span.

Words are runs of ASCII digits and letters and of all other characters beyond ASCII; A-Z count as a-z.

Results on edge cases: a null or empty text has no words and no labels, score 0; equal texts are judged
once and all their rows get the result; a null ``doc_id`` stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.llm.text_native import once

#: Fixed phrases and labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Standard sentences of public licenses.
TEMPLATES = {
    "licensed under the apache license version 2.0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by sa 4.0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution 4.0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd",
    "subject to the terms of the mozilla public license v 2.0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
GRAM = 2
#: Diagonals this close are one span: so many words may have been put in or left out at a place.
SHIFT = 3
LEAST_VOTES = 0.5
LEAST_COVERED = 0.9

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Only A-Z may become a-z: the two other letters that ``lower`` turns into ASCII are set aside first."""
    aside = F.replace(F.replace(text, F.lit("K"), F.lit("ÿ")), F.lit("İ"), F.lit("ÿ"))
    return F.filter(F.split(F.lower(aside), _SEPARATORS), lambda w: w != "")


def phrase_table(spark: SparkSession) -> DataFrame:
    """One row per phrase; a fixed, small list."""
    rows = [(k, label, k < len(BASE), phrase.replace(".", " ").split())
            for k, (phrase, label) in enumerate([*BASE.items(), *TEMPLATES.items()])]
    return spark.createDataFrame(rows, "phrase int, label string, base boolean, phrase_words array<string>")


def _grams(items: Column) -> Column:
    return F.when(
        F.size(items) >= GRAM,
        F.transform(
            F.sequence(F.lit(0), F.size(items) - GRAM),
            lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(GRAM)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """Verified spans of each distinct text (``k1``, ``k2``: its hashes): phrase, label, base, begin, end, covered."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text")).select("text", *text_keys(F.col("text")))
    phrases = phrase_table(spark)
    # As many rows as the phrases above have word pairs.
    positions = F.broadcast(
        phrases.select("phrase", F.size("phrase_words").alias("n_phrase"), F.posexplode(_grams(F.col("phrase_words"))).alias("q", "gram"))
    )
    grams = once(keyed, _w=words(F.col("text"))).select("k1", "k2", F.posexplode(_grams(F.col("_w"))).alias("p", "gram"))
    hits = grams.join(positions, "gram").groupBy("k1", "k2", "phrase", "n_phrase", (F.col("p") - F.col("q")).alias("diagonal"), "q").agg(
        F.lit(1).alias("vote"))
    diagonals = hits.groupBy("k1", "k2", "phrase", "n_phrase", "diagonal").agg(
        F.sum("vote").alias("votes"), F.min("q").alias("low"), F.max("q").alias("high")
    )
    along = W.partitionBy("k1", "k2", "phrase").orderBy("diagonal")
    apart = F.col("phrase") < len(BASE)
    fresh = F.coalesce(apart | (F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT), F.lit(True))
    spans = (
        diagonals.withColumn("span", F.sum(fresh.cast("int")).over(along))
        .groupBy("k1", "k2", "phrase", "n_phrase", "span")
        .agg(
            F.sum("votes").alias("votes"),
            F.min(F.col("diagonal") + F.col("low")).alias("begin"),
            (F.max(F.col("diagonal") + F.col("high")) + GRAM).alias("end"),
        )
    )
    grams_of = F.col("n_phrase") - GRAM + 1
    least = F.when(apart, F.lit(1.0)).otherwise(F.lit(LEAST_VOTES))
    spans = spans.where(F.col("votes") >= least * grams_of).join(F.broadcast(phrases), "phrase")
    listed = spans.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("phrase", "label", "base", "phrase_words", "begin", "end")).alias("spans")
    )
    texts = keyed.join(listed, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = once(texts.select("k1", "k2", "text", "spans"), _w=words(F.col("text")))

    def judged(s: Column) -> Column:
        there = F.slice("_w", s["begin"] + 1, s["end"] - s["begin"])
        known = F.array_distinct(s["phrase_words"])
        found = F.size(F.array_intersect(known, there)) / F.size(known)
        exact = F.when(there == s["phrase_words"], F.lit(1.0)).otherwise(F.lit(0.0))
        return F.struct(
            *[s[n].alias(n) for n in ("phrase", "label", "base", "begin", "end")],
            F.when(s["base"], exact).otherwise(found).alias("covered"),
        )

    checked = texts.select("k1", "k2", F.explode(F.transform("spans", judged)).alias("s")).select("k1", "k2", "s.*")
    return checked.where(F.col("covered") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(LEAST_COVERED)))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, labels and score."""
    spans = find_spans(docs)
    base_begin = F.when(F.col("base"), F.col("begin"))
    found = spans.groupBy("k1", "k2").agg(
        F.count_if("base").alias("n_base"),
        F.min(base_begin).cast("long").alias("first_word"),
        F.max(base_begin).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("label_set"),
        F.max("covered").alias("best"),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", *text_keys(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(F.sort_array(name), ","), F.lit(""))

    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        listed("base_set").alias("base_labels"),
        listed("label_set").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
