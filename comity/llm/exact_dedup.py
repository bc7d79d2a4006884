"""Operator 10: exact deduplication by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. Three stages group by the
digest and the full content, so two texts that share a digest stay apart:

1. each input task folds its own copies (the partial side of the aggregate);
2. what is left meets by digest and salt, the salt being taken from the row, so the copies
   of a hot text meet in SALTS places;
3. the winners of the salts, SALTS of a text at most, are combined by digest.

Every row then looks up its text's result by digest. Where one digest has several contents
(``shared``, in practice none) their rows look it up by content.

Defined results: null counts as empty; of equal texts the row with the largest doc_id
stays, and a group whose ids are all null keeps id null; ``kept`` compares ids null-safe,
so rows that repeat the largest id are all marked; ``deduplicated`` returns one of them.
Further columns stay in ``deduplicated`` and are not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comity.llm.common import (
    at, lower_ascii, original, renamed, row_hash, stored, text_of,
)

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def classes(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """_digest, keep_id, group_size, _contents, and _text where contents share a digest."""
    text = lower_ascii(text_of(docs))
    rows = docs.select(
        F.col("doc_id"), text.alias("_text"), digest(text).alias("_digest"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_salt", "_digest", "_text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    combined = salted.groupBy("_digest", "_text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return combined


def resolved(docs: DataFrame, digest=sha256, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Results by digest alone, and those of contents that share a digest."""
    found = stored(
        classes(docs, digest, salts).select(
            "_digest", "keep_id", "group_size", F.xxhash64("_text").alias("_mark")),
        "exact-classes")
    shared = found.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents")).filter(
        F.col("_contents") > 1)
    return found, shared


def results(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """Each row of ``docs`` with _digest, keep_id, group_size and kept."""
    found, shared = resolved(docs, digest, salts)
    text = lower_ascii(text_of(docs))
    rows = docs.select("doc_id", digest(text).alias("_digest"), text.alias("_text"))
    if shared.isEmpty():
        joined = rows.drop("_text").join(found.drop("_mark"), "_digest")
    else:
        joined = rows.join(_by_content(docs, digest, salts), ["_digest", "_text"]).drop("_text")
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _by_content(docs: DataFrame, digest, salts: int) -> DataFrame:
    return classes(docs, digest, salts)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    return results(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with the columns of ``docs``.

    Of several rows with the id that stays, the one with the least hash of all its columns.
    """
    found, shared = resolved(docs)
    content = [] if shared.isEmpty() else ["_text"]
    keys = ["_digest", *content]
    plain, names = renamed(docs)
    text = lower_ascii(F.coalesce(at(docs, "text").cast("string"), F.lit("")))
    held = plain.select(*names, at(docs, "doc_id").alias("_id"), sha256(text).alias("_digest"),
                        *[text.alias("_text")] * len(content))
    winners = found if not content else classes(docs)
    winners = winners.select(*keys, F.col("keep_id").alias("_keep"))
    same = [held[k] == winners[k] for k in keys]
    kept = held.join(winners, [*same, held["_id"].eqNullSafe(winners["_keep"])], "left_semi")
    one = kept.groupBy(*keys, "_id").agg(
        F.min_by(F.struct(*names), row_hash(docs, names)).alias("_row"))
    return original(one.select("_row.*"), docs)


ORACLE_SQL = """
WITH rows AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
    sha256(t) AS text_sha256
FROM rows JOIN groups USING (t)
"""
