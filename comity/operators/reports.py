"""Summaries over history and scored comments.

Every report is one conditional aggregate for all owners (or videos) at once: rows fold
map-side, so a hot owner costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions.text import or_empty, strip
from comity.functions.values import (
    is_positive, label_score, parse_label_map, percent, split_list,
)
from comity.operators.history import owner_source
from comity.sources.readers import find_category_column, find_prediction_column

TOXIC = ("toxic",)
NON_TOXIC = ("non-toxic", "non toxic")


def _verdict_in(names) -> Column:
    return F.lower("prediction").isin(list(names))


def _source_in(*names: str) -> Column:
    return F.lower(strip(or_empty("source"))).isin(list(names))


def owner_stats(history: DataFrame, as_of: str) -> DataFrame:
    """Totals per owner. The rate's denominator is all rows, whatever their verdict."""
    return (
        history.groupBy("user_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(_verdict_in(TOXIC)).alias("toxic"),
            F.count_if(_verdict_in(NON_TOXIC)).alias("non_toxic"),
            F.count_if(F.to_date("created_at") == F.lit(as_of).cast("date")).alias("today"),
        )
        .withColumn("toxicity_rate", percent(F.col("toxic"), F.col("total"), 1))
    )


def daily_activity(
    history: DataFrame, days: int | None = None, latest: bool = False
) -> DataFrame:
    """Rows per owner and day, all days; ``days`` keeps each owner's oldest, or ``latest``."""
    daily = history.groupBy(
        "user_id", F.to_date("created_at").alias("activity_date")
    ).agg(F.count("*").alias("total"))
    if days is None:
        return daily
    order = F.desc("activity_date") if latest else F.asc("activity_date")
    ranked = daily.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(order))
    )
    return ranked.filter(F.col("_rank") <= days).drop("_rank")


def source_distribution(history: DataFrame) -> DataFrame:
    """Rows per owner and source, largest first, names in capitals."""
    return (
        history.groupBy("user_id", owner_source().alias("_source"))
        .agg(F.count("*").alias("rows"))
        .select("user_id", F.upper("_source").alias("source"), "rows")
        .orderBy("user_id", F.desc("rows"), "source")
    )


def channel_counts(history: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Rows per owner that came from tweets, files and typed text, plus video analyses."""
    counts = history.groupBy("user_id").agg(
        F.count_if(_source_in("twitter")).alias("twitter"),
        F.count_if(_source_in("csv")).alias("csv"),
        F.count_if(_source_in("text", "api")).alias("text"),
    )
    if analyses is None:
        return counts
    runs = analyses.groupBy("user_id").agg(
        F.count("*").alias("analyses"),
        F.count_if(F.lower("analysis_type") == "youtube").alias("youtube"),
    )
    # Both sides hold one row per owner, so no owner can be hot here.
    return counts.join(runs, "user_id", "full").fillna(0)


def label_counts(history: DataFrame, threshold: float = K.LABEL_THRESHOLD) -> DataFrame:
    """Per owner, rows whose stored label map reaches the threshold, for each label."""
    parsed = history.select("user_id", parse_label_map("labels_json").alias("_labels"))
    return parsed.groupBy("user_id").agg(*[
        F.count_if(label_score(F.col("_labels"), label) >= threshold).alias(label)
        for label in K.LABELS
    ])


def dashboard(history: DataFrame, as_of: str) -> DataFrame:
    """All per-owner dashboard counters from a single scan and a single shuffle."""
    rows = history.withColumn("_labels", parse_label_map("labels_json"))
    return (
        rows.groupBy("user_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(_verdict_in(TOXIC)).alias("toxic"),
            F.count_if(_verdict_in(NON_TOXIC)).alias("non_toxic"),
            F.count_if(F.to_date("created_at") == F.lit(as_of).cast("date")).alias("today"),
            F.count_if(_source_in("twitter")).alias("twitter"),
            F.count_if(_source_in("csv")).alias("csv"),
            F.count_if(_source_in("text", "api")).alias("text"),
            *[
                F.count_if(label_score(F.col("_labels"), label) >= K.LABEL_THRESHOLD)
                .alias(f"{label}_count")
                for label in K.LABELS
            ],
        )
        .withColumn("toxicity_rate", percent(F.col("toxic"), F.col("total"), 1))
    )


def _summary_columns(total: Column, digits: int) -> dict[str, Column]:
    return {
        "toxic_percentage": percent(F.col("toxic_comments"), total, digits),
        "non_toxic_percentage": percent(F.col("non_toxic_comments"), total, digits),
    }


def comment_summary(
    scored: DataFrame,
    flags: Mapping[str, Column],
    *by: str,
) -> DataFrame:
    """Per video (or any keys): verdict totals without failed rows, and label counts."""
    return (
        scored.groupBy(*by)
        .agg(
            F.count_if(F.col("prediction") == "Toxic").alias("toxic_comments"),
            F.count_if(F.col("prediction") == "Non-Toxic").alias("non_toxic_comments"),
            *[F.count_if(flag).alias(f"{label}_count") for label, flag in flags.items()],
        )
        .withColumn("total_comments", F.col("toxic_comments") + F.col("non_toxic_comments"))
        .withColumns(_summary_columns(F.col("total_comments"), 2))
    )


def category_shares(summary: DataFrame, total: str = "total_comments") -> DataFrame:
    """Each label's share of all comments, in percent, as extra columns."""
    return summary.withColumns({
        f"{label}_share": percent(F.col(f"{label}_count"), F.col(total), 2)
        for label in K.LABELS
    })


def scored_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Totals of a stored scored table; labels come from its comma-joined categories.

    Non-toxic is everything that is not toxic; a label named twice counts twice.
    """
    listed = scored.withColumn("_categories", split_list("categories"))

    def named(label: str) -> Column:
        times = F.size(F.filter("_categories", lambda c: c == label))
        return F.coalesce(F.sum(times), F.lit(0)).alias(f"{label}_count")

    return (
        listed.groupBy(*by)
        .agg(
            F.count("*").alias("total_comments"),
            F.count_if(F.lower(or_empty("prediction")) == "toxic").alias("toxic_comments"),
            *[named(label) for label in K.LABELS],
        )
        .withColumn(
            "non_toxic_comments", F.col("total_comments") - F.col("toxic_comments")
        )
        .withColumns(_summary_columns(F.col("total_comments"), 2))
    )


def loose_summary(df: DataFrame) -> DataFrame:
    """Totals of a table with unknown column names and loosely typed verdicts.

    The verdict is the prediction column if there is one, else the toxic column. The
    toxic count is always the verdict count.
    """
    def positives(column: str | None) -> Column:
        if column is None:
            return F.lit(0).cast("bigint")
        return F.count_if(is_positive(F.col(f"`{column}`"), df.schema[column].dataType))

    columns = df.columns
    verdict = find_prediction_column(columns) or find_category_column(columns, "toxic")
    others = [label for label in K.LABELS if label != "toxic"]
    return (
        df.dropna(how="all")
        .agg(
            F.count(F.lit(1)).alias("total_comments"),
            positives(verdict).alias("toxic_comments"),
            *[
                positives(find_category_column(columns, label)).alias(f"{label}_count")
                for label in others
            ],
        )
        .withColumn(
            "non_toxic_comments",
            F.greatest(F.col("total_comments") - F.col("toxic_comments"), F.lit(0)),
        )
        .withColumn("toxic_count", F.col("toxic_comments"))
        .withColumns(_summary_columns(F.col("total_comments"), 1))
    )


def upload_summary(
    results: DataFrame, scores: Mapping[str, Column], *by: str
) -> DataFrame:
    """Totals of a batch upload; failed rows stay in the denominators."""
    return (
        results.groupBy(*by)
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("prediction") == "Toxic").alias("toxic"),
            F.count_if(F.col("prediction") == "Non-Toxic").alias("safe"),
            F.count_if(F.col("prediction").isin(list(K.UNSAVED_PREDICTIONS))).alias("errors"),
            *[
                F.count_if(score >= K.LABEL_THRESHOLD).alias(f"{label}_count")
                for label, score in scores.items()
            ],
        )
        .withColumns({
            "toxic_rate": percent(F.col("toxic"), F.col("total"), 1),
            "safe_rate": percent(F.col("safe"), F.col("total"), 1),
        })
    )


def history_stats(analyses: DataFrame) -> DataFrame:
    """Totals per owner over analysis rows; label totals add up the stored count maps."""
    counts = parse_label_map("category_counts")

    def total_of(label: str) -> Column:
        value = F.try_element_at(F.col("_counts"), F.lit(label)).try_cast("bigint")
        return F.coalesce(F.sum(value), F.lit(0)).alias(label)

    return (
        analyses.withColumn("_counts", counts)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("prediction") == "Toxic").alias("toxic_rows"),
            F.count_if(F.col("analysis_type") == "YouTube").alias("youtube"),
            *[total_of(label) for label in K.LABELS],
        )
        .withColumns({
            "safe_rows": F.col("total") - F.col("toxic_rows"),
            "toxic_rate": percent(F.col("toxic_rows"), F.col("total"), 2),
        })
    )


def page_stats(history: DataFrame) -> DataFrame:
    """Page-level totals per owner; verdicts are matched with their exact case."""
    return (
        history.groupBy("user_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("prediction") == "Toxic").alias("toxic"),
            F.count_if(F.col("prediction") == "Non-Toxic").alias("non_toxic"),
        )
        .withColumn("rate", percent(F.col("toxic"), F.col("total"), 1))
    )
