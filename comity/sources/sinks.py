"""History tables: the rows to append, and writes that can be repeated safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions.values import scores_json
from comity.workspace import new_path


def history_rows(
    scored: DataFrame,
    source: str,
    scores: dict[str, Column] | None = None,
    created_at: Column | None = None,
    may_fail: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Scored texts as prediction-history rows, with the ``keep`` columns.

    Rows whose scorer failed are not kept; a scorer that cannot fail saves the check.
    Needs user_id, text, language, prediction and confidence; labels come from
    ``scores`` or an existing ``labels_json``.
    """
    labels = scores_json(scores) if scores else F.col("labels_json")
    translated = "translated_text" if "translated_text" in scored.columns else "text"
    key = ["id"] if "id" in scored.columns else []
    if may_fail:
        verdict = F.coalesce(F.col("prediction"), F.lit("Unknown"))
        scored = scored.filter(~verdict.isin(list(K.UNSAVED_PREDICTIONS)))
    return scored.select(
        *key,
        *keep,
        "user_id",
        F.col("text").alias("input_text"),
        F.coalesce(F.col("language"), F.lit("en")).alias("language"),
        F.coalesce(F.col(translated), F.lit("")).alias("translated_text"),
        F.coalesce(F.col("prediction"), F.lit("Unknown")).alias("prediction"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).cast("double").alias("confidence"),
        labels.alias("labels_json"),
        F.lit(source).alias("source"),
        (F.col("created_at") if created_at is None else created_at).alias("created_at"),
    )


def comment_rows(scored: DataFrame, scores: dict[str, Column], created_at: Column) -> DataFrame:
    """Scored video comments as table rows. Failed rows are kept here.

    Place, parent and kind of a comment are kept where they are known.
    """
    known = [c for c in ("position", "parent_id", "is_reply", "comment_type")
             if c in scored.columns]
    return scored.select(
        *known,
        "user_id",
        "video_id",
        "comment_id",
        F.coalesce(F.col("author"), F.lit("Unknown")).alias("author"),
        F.col("text").alias("comment_text"),
        "prediction",
        F.col("confidence").cast("double").alias("confidence"),
        scores_json(scores).alias("labels_json"),
        created_at.alias("created_at"),
    )


def analysis_rows(
    summary: DataFrame, created_at: Column, analysis_type: str = "youtube"
) -> DataFrame:
    """One summary row per analysed video; category counts go into ``result_json``."""
    counts = F.struct(*[F.col(f"{label}_count").alias(label) for label in K.LABELS])
    return summary.select(
        "user_id",
        F.lit(analysis_type).alias("analysis_type"),
        F.col("video_id").alias("source"),
        F.col("total_comments").alias("total_items"),
        F.col("toxic_comments").alias("toxic_items"),
        F.col("non_toxic_comments").alias("non_toxic_items"),
        "toxic_percentage",
        F.to_json(F.struct(counts.alias("category_counts"))).alias("result_json"),
        created_at.alias("created_at"),
    )


def titled_analysis_rows(summary: DataFrame, created_at: Column) -> DataFrame:
    """The alternate summary shape: title, majority verdict, JSON list and map."""
    counts = F.struct(*[F.col(f"{label}_count").alias(label) for label in K.LABELS])
    majority = F.col("toxic_comments") > F.col("non_toxic_comments")
    return summary.select(
        "user_id",
        F.lit("YouTube").alias("analysis_type"),
        F.lit("").alias("content"),
        "title",
        F.when(majority, "Toxic").otherwise("Non-Toxic").alias("prediction"),
        F.col("toxic_percentage").alias("confidence"),
        F.lit("[]").alias("categories"),
        F.to_json(counts).alias("category_counts"),
        "video_id",
        "total_comments",
        "toxic_comments",
        "non_toxic_comments",
        created_at.alias("created_at"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Append to a table partitioned by day.

    The rebalance keeps one hot day from becoming one huge task and many small days
    from becoming many small files.
    """
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    dated.hint("rebalance", "created_date").write.mode("append").partitionBy(
        "created_date"
    ).parquet(path)


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Write one analysis run. Repeating a run replaces its own rows and no others."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8") -> None:
    """CSV with a header, which reads back as it was: quotes are doubled, line breaks quoted,
    and blanks around a text kept."""
    df.write.mode("overwrite").options(
        header=True, escape='"', quoteAll=False, encoding=encoding,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def erase(history: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that survive the erasure requests, matched on ``user_id`` or (user_id, id)."""
    return history.join(requests.select(*keys).distinct(), keys, "left_anti")


def erase_to(
    spark: SparkSession, path: str, out_path: str, requests: DataFrame, keys: list[str]
) -> None:
    """Write the surviving history as a new table; the caller then switches to it.

    For requests that touch most days. ``erase_days`` rewrites only the days it must.
    """
    survivors = erase(spark.read.parquet(path), requests, keys)
    survivors.hint("rebalance", "created_date").write.mode("overwrite").partitionBy(
        "created_date"
    ).parquet(out_path)


def erase_days(
    spark: SparkSession, path: str, requests: DataFrame, keys: list[str]
) -> None:
    """Erase in place, rewriting only the day partitions that hold a requested row.

    The survivors of those days are written to the shared folder first, so the rewrite
    never reads what it replaces, and a run that was cut short can simply be repeated.
    Only the names of touched days come to the driver.
    """
    history = spark.read.parquet(path)
    asked = requests.select(*keys).distinct()
    touched = _days(history.join(asked, keys, "left_semi"))
    if not touched:
        return
    staged = new_path(spark, "erase")
    day = F.col("created_date")
    among = day.isin([d for d in touched if d is not None])
    if None in touched:
        among = day.isNull() | among
    erase(history.filter(among), asked, keys).write.parquet(staged)

    survivors = spark.read.schema(history.schema).parquet(staged)
    (
        survivors.hint("rebalance", "created_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("created_date")
        .parquet(path)
    )
    # A day without survivors is not part of the rewrite; its partition is removed.
    for day in set(touched) - set(_days(survivors)):
        name = "__HIVE_DEFAULT_PARTITION__" if day is None else day
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/created_date={name}")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)


def _days(rows: DataFrame) -> list:
    return [r[0] for r in rows.select("created_date").distinct().collect()]
