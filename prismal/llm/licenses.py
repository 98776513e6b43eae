r"""License phrases and texts by diagonal voting, in DataFrame functions only.

All rolling K-word grams of every text meet the grams of the templates in a hash join; the templates are the fixed tables
below, a few hundred grams, so that side is broadcast, and grams whose hash no template has go before a row is made of each. A hit votes for the diagonal (place in the text less place in the
template) of its template; the words of a hit are compared as well, not only their hash. Votes are counted by diagonal,
neighbouring diagonals (a few words put in or left out) are merged, and a merged span counts if enough of the template's
grams stand in it and it is not much longer than the template. A base phrase needs all its grams on one diagonal, which is
the whole phrase, word after word.

Cases: a null text has no words; a null id or repeated rows get their own row each, with the values of their text; fewer
than K words give no votes; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_key, text_of

K = 3
#: Diagonals at most so far apart are merged; a span needs this share of its template's grams, in so many times its length.
NEIGHBOUR, LEAST, STRETCH = 3, 0.7, 1.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Well-known opening sentences of public licenses and their labels.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this is free and unencumbered software released into the public domain": "unlicense-text",
    "this work is licensed under a creative commons attribution": "cc-by-text",
}


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z need lower case, and what else lower() changes is in no template's words."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def templates(spark: SparkSession) -> DataFrame:
    """A row for each template gram: template, label, base, grams, length, place, w0 .. and hash."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES.items(), *TEXTS.items()]):
        words = text.split()
        rows += [(n, label, text in PHRASES, len(words) - K + 1, len(words), i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    names = [f"t{j}" for j in range(K)]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, length int, place int, " + ", ".join(f"{x} string" for x in names))
    return made.withColumn("t_hash", F.xxhash64(*names))


def diagonals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, template, diagonal and the places of the template that voted for it."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    w = F.col("words")

    def gram(i: Column) -> Column:
        own = [F.get(w, i + j) for j in range(K)]
        return F.struct(i.alias("at"), F.xxhash64(*own).alias("hash"), *[x.alias(f"w{j}") for j, x in enumerate(own)])

    t = templates(docs.sparkSession)
    known = [r[0] for r in t.select("t_hash").distinct().collect()]  # of the fixed tables
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.when(F.xxhash64(*[F.get(w, i + j) for j in range(K)]).isin(known), i))
    places = F.when(F.size(w) >= K, F.array_compact(hashes))
    each = rows.select("doc_id", "text_key", F.explode(F.transform(places, gram)).alias("g"))
    t = F.broadcast(t)
    same = F.col("g.hash") == F.col("t_hash")
    for j in range(K):
        same = same & (F.col(f"g.w{j}") == F.col(f"t{j}"))
    hits = each.join(t, same).select("doc_id", "text_key", "template", "label", "base", "grams", "length", (F.col("g.at") - F.col("place")).alias("diagonal"), "place")
    return hits.groupBy("doc_id", "text_key", "template", "label", "base", "grams", "length", "diagonal").agg(F.collect_set("place").alias("places"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, label, base, start, end (words, end exclusive), coverage (share of the template's grams)."""
    d = diagonals(docs)
    base = d.where(F.col("base") & (F.size("places") == F.col("grams"))).select("doc_id", "text_key", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("coverage"))
    own = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > NEIGHBOUR).cast("int"), F.lit(0))
    runs = d.where(~F.col("base")).withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "text_key", "template", "label", "base", "grams", "length", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hit"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        (F.max(F.col("diagonal") + F.array_max("places")) + K).alias("end"),
    )
    long = merged.select("doc_id", "text_key", "label", "base", "start", "end", (F.col("hit") / F.col("grams")).alias("coverage"), ((F.col("end") - F.col("start")) <= STRETCH * F.col("length")).alias("tight"))
    return base.unionByName(long.where("tight").drop("tight"))


def op10_licenses(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", text_of().alias("text"))
    is_base = F.col("base")
    sure = is_base | (F.col("coverage") >= LEAST)
    found = spans(docs).groupBy("doc_id", "text_key").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("label")))), ",").alias("labels"),
        F.max("coverage").alias("score"),
    ).withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["f_id"]) & (F.col("text_key") == F.col("f_key")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
