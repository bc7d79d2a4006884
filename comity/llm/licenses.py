"""Operator 6: licence scans by diagonal voting.

All rolling GRAM-word grams of every text are joined, by hash, to their places in licence
templates. A hit votes for the diagonal document place - template place. Votes are summed
by diagonal, neighbouring diagonals (a word put in or left out shifts the diagonal by one)
are merged into spans, and a span counts if its words verify: every joined gram is compared
word for word, and the matched words must cover COVER of the template, or all of it for a
base phrase, on one diagonal and without a gap.

The template table is fixed and small (its grams are counted against MAX_GRAMS), so the
join is a map-side one and only hits leave the tasks. They are few, and are grouped by
document, template and diagonal.

Defined results: null and empty texts have no words, no labels, null places and score 0;
repeated rows (same id and text) each get their own result; null ids are an id like others;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comity.llm.common import lower_ascii, stored, text_of

GRAM = 3
COVER = 0.8
SHIFT = 3  # diagonals this far apart merge
MAX_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Well-known licence notices, whose near forms count too.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        "the mit license",
        "licensed under the mit license",
        "released under the mit license",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def grams(words: Column) -> Column:
    """Structs of place, hash and words of every rolling gram."""
    def gram(i: Column) -> Column:
        text = F.concat_ws(" ", *[F.get(words, i + j) for j in range(GRAM)])
        return F.struct(i.alias("pos"), text.alias("gram"))

    return F.when(
        F.size(words) >= GRAM,
        F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), gram),
    )


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, length, place, gram_hash and gram of all templates."""
    rows = [(p, label, True) for p, label in PHRASES.items()]
    rows += [(n, label, False) for label, notices in NOTICES.items() for n in notices]
    if sum(len(r[0].split()) for r in rows) > MAX_GRAMS:
        raise ValueError("the template table is too large to send to every task")
    values = ", ".join(f"({i}, '{t}', '{label}', {str(base).lower()})"
                       for i, (t, label, base) in enumerate(rows))
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, notice, label, base)")
    words = F.split("notice", " ")
    return listed.select(
        "template", "label", "base", F.size(words).alias("length"),
        F.explode(grams(words)).alias("_g"),
    ).select(
        "template", "label", "base", "length", F.col("_g.pos").alias("tpos"),
        F.xxhash64("_g.gram").alias("gram_hash"), F.col("_g.gram").alias("_tgram"))


def votes(docs: DataFrame) -> DataFrame:
    """Hits: document key, template, template place, document place."""
    text = text_of(docs)
    exploded = docs.select(
        "doc_id", F.xxhash64(text).alias("_mark"), words_of(text).alias("_words"),
    ).select("doc_id", "_mark", F.explode(grams(F.col("_words"))).alias("_g")).select(
        "doc_id", "_mark", F.col("_g.pos").alias("pos"), F.col("_g.gram").alias("_gram"),
        F.xxhash64("_g.gram").alias("gram_hash"))
    return exploded.join(F.broadcast(templates(docs.sparkSession)), "gram_hash").filter(
        F.col("_gram") == F.col("_tgram")
    ).select("doc_id", "_mark", "template", "label", "base", "length", "tpos", "pos")


def spans(hits: DataFrame) -> DataFrame:
    """Verified spans: first and last word, base or not, share of the template covered.

    Hits of one diagonal that follow each other are a run; runs on diagonals at most SHIFT
    apart and in template order merge. A run of a base template must hold all its grams.
    Templates of SHIFT words or fewer do not merge: their own repeats are no further apart.
    """
    key = ["doc_id", "_mark", "template", "label", "base", "length"]
    # Repeated rows vote twice for the same places: count a place once.
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(
        *key, "diagonal").agg(
            F.sort_array(F.collect_set("tpos")).alias("tposes"))
    merged = Window.partitionBy(*key).orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(merged) > SHIFT, F.lit(True))
    alone = F.col("base") | (F.col("length") <= SHIFT)
    grouped = diagonals.withColumn(
        "_chain", F.sum(F.when(alone | new, 1).otherwise(0)).over(merged))
    joined = grouped.groupBy(*key, "_chain").agg(
        F.min(F.col("diagonal") + F.element_at("tposes", 1)).alias("first"),
        F.max(F.col("diagonal") + F.element_at("tposes", -1) + GRAM - 1).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "tposes", lambda p: F.sequence(p, p + GRAM - 1)))))
    return joined.withColumn("cover", covered / F.col("length")).filter(
        F.when(F.col("base"), F.col("cover") == 1).otherwise(
            (F.col("cover") >= COVER)
            & (F.col("last") - F.col("first") + 1 <= 2 * F.col("length"))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels and score."""
    found = stored(spans(votes(docs)), "license-spans")
    listed = F.concat_ws(",", F.array_sort(F.collect_set("label")))
    summary = found.groupBy("doc_id", "_mark").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))))
        .alias("base_labels"),
        listed.alias("labels"),
        F.max("cover").alias("score"),
    ).select(F.col("doc_id").alias("_d"), F.col("_mark").alias("_m"), "n_base", "first_word",
             "last_word", "base_labels", "labels", "score")
    text = text_of(docs)
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("_mark"),
        F.regexp_count(lower_ascii(text), F.lit(WORD)).cast("long").alias("n_words"))
    return rows.join(
        summary, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")), "left"
    ).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
