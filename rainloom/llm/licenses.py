"""License scan by diagonal voting, in DataFrame functions only.

Every rolling gram of words is hashed and joined to the positions at which the templates have it. A match
votes for the diagonal (position in the text minus position in the template); neighbouring diagonals of one
template are merged, so that an inserted or missing word doesn't break a span, and the spans that have
enough votes are verified against the words of the text.

The base phrases are templates too: a diagonal on which every gram votes is a place, confirmed word by
word. Null and empty texts have no words and no labels; a very long text is one row of grams like any
other, whole. Repeated rows are scanned once and reported as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.llm.common import narrow

#: Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further texts, by label; a span of one gives the label if enough of its words are there.
NOTICES = {
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-released": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}
GRAM = 3  # words; phrases of two words have grams of two
NEAR = 3  # diagonals so far apart belong together
COVER = 80  # per cent of a notice's words that its span must have

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered: digits, letters, and everything beyond ASCII."""
    return F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), _NO_WORD), lambda w: w != "")


def _grams(ws: Column, k: int) -> Column:
    """Hash of the ``k`` words from each position on; fewer at the end of the text are no gram."""
    each = F.transform(ws, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(ws, i + j) for j in range(1, k)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0)))


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per template and gram position; as many rows as the templates have words."""
    rows = [(n, text, label, True) for n, (text, label) in enumerate(base.items())]
    rows += [(len(rows) + n, text, label, False) for n, (label, text) in enumerate(notices.items())]
    df = spark.createDataFrame(rows, "template int, phrase string, label string, base boolean").withColumn("tw", F.split("phrase", " "))
    grams = F.when(F.size("tw") < GRAM, _grams(F.col("tw"), 2)).otherwise(_grams(F.col("tw"), GRAM))
    return df.withColumn("n_grams", F.size(grams)).select("*", F.posexplode(grams).alias("at", "hash"))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: places of base phrases, their first and last word, labels, and the best coverage of a template."""
    spark = docs.sparkSession
    texts = narrow(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    known = templates(spark, base, notices)
    key = ["doc_id", "_h"]

    both_grams = lambda w: F.struct(F.greatest(F.size(w) - (GRAM - 1), F.lit(0)).alias("n3"), F.concat(_grams(w, GRAM), _grams(w, 2)).alias("g"))
    hashed = texts.select(*key, F.inline(F.transform(F.array(words(F.col("text"))), both_grams)))
    rolled = hashed.select(*key, "n3", F.posexplode("g").alias("p", "hash"))
    # the templates are a parameter with a row per word: small whatever the corpus
    hits = rolled.join(F.broadcast(known.select("hash", "template", "at", "n_grams", "base")), "hash")
    position = F.when(F.col("p") < F.col("n3"), F.col("p")).otherwise(F.col("p") - F.col("n3"))
    votes = (
        hits.select(*key, "template", "base", "n_grams", (position - F.col("at")).alias("diagonal"), "at")
        .groupBy(*key, "template", "base", "n_grams", "diagonal")
        .agg(F.count_distinct("at").alias("votes"))
    )
    places = votes.where(F.col("base") & (F.col("votes") == F.col("n_grams"))).select(*key, "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")  # bounded by the words of one text
    chained = votes.where(~F.col("base")).withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1)))
    merged = (
        chained.withColumn("chain", F.sum("fresh").over(order))
        .groupBy(*key, "template", "n_grams", "chain")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
        .where(F.col("votes") * 2 >= F.col("n_grams"))
    )
    named = places.unionByName(merged.select(*key, "template", "low", "high")).join(F.broadcast(known.select("template", "phrase", "tw", "label", "base").distinct()), "template")
    found = named.groupBy(*key).agg(F.collect_list(F.struct("low", "high", "phrase", "tw", "label", "base")).alias("spans"))

    f = found.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), "spans")
    both = texts.join(f, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left")
    spans = F.coalesce("spans", F.array().cast(f.schema["spans"].dataType))

    def verified(w):
        exact = F.filter(spans, lambda s: s["base"] & (F.slice(w, s["low"] + 1, F.size(s["tw"])) == s["tw"]))
        near = F.transform(F.filter(spans, lambda s: ~s["base"]), lambda s: F.struct(s["label"].alias("label"), _coverage(w, s).alias("cover")))
        return F.struct(F.size(w).cast("long").alias("n_words"), exact.alias("sure"), near.alias("likely"))

    # an array of one binds the words, so that they are split once and not once per use
    scored = both.select("doc_id", F.inline(F.transform(F.array(words(F.col("text"))), verified)))
    own = F.transform("sure", lambda s: s["label"])
    more = F.transform(F.filter("likely", lambda s: s["cover"] * 100 >= COVER), lambda s: s["label"])
    starts = F.transform("sure", lambda s: s["low"])
    best = F.array_max(F.transform("likely", lambda s: s["cover"]))
    return scored.select(
        "doc_id",
        "n_words",
        F.size("sure").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, more))), ",").alias("labels"),
        F.round(F.when(F.size("sure") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))), 6).alias("score"),
    )


def _coverage(ws: Column, s: Column) -> Column:
    """Share of a template's different words that the span of the text has."""
    start = F.greatest(s["low"], F.lit(0))
    span = F.slice(ws, start + 1, s["high"] - start + F.size(s["tw"]))
    return F.size(F.array_intersect(span, s["tw"])) / F.size(F.array_distinct(s["tw"]))
