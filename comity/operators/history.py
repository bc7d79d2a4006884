"""Listings over prediction history and scored comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity.functions.text import or_empty, preview, strip
from comity.functions.values import parse_label_map


def latest_per_owner(history: DataFrame, n: int = 10, owner: str = "user_id") -> DataFrame:
    """The newest ``n`` rows of every owner, with a short preview of the text.

    The rank filter lets Spark cut each owner to ``n`` rows before the shuffle, so an
    owner with a third of all rows sends only a few.
    """
    newest = Window.partitionBy(owner).orderBy(F.desc("id"))
    return (
        history.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= n)
        .withColumn("preview", preview("input_text", 60))
    )


def listing(history: DataFrame, by_time: bool = False) -> DataFrame:
    """Everything, per owner and newest first, with parsed labels (bad JSON → empty)."""
    order = [F.desc("created_at"), F.desc("id")] if by_time else [F.desc("id")]
    return history.withColumn("labels", parse_label_map("labels_json")).orderBy(
        "user_id", *order
    )


def search(
    history: DataFrame,
    text: str | None = None,
    prediction: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Rows that meet all given filters; the text is searched without regard to case."""
    out = history
    if text:
        out = out.filter(F.lower(or_empty("input_text")).contains(text.lower()))
    if prediction:
        out = out.filter(F.lower("prediction") == prediction.lower())
    if source:
        out = out.filter(F.lower(strip(or_empty("source"))) == source.lower())
    return out


def page(history: DataFrame, size: int = 20, before_id: int | None = None) -> DataFrame:
    """One page, newest first, by key: rows older than ``before_id``."""
    rows = history if before_id is None else history.filter(F.col("id") < before_id)
    return rows.orderBy(F.desc("id")).limit(size)


def comments_by_verdict(scored: DataFrame, verdict: str = "Toxic") -> DataFrame:
    """Scored comments with one verdict."""
    return scored.filter(F.col("prediction") == verdict)


def verdict_view(
    scored: DataFrame, verdict: str = "Toxic", videos: DataFrame | None = None
) -> DataFrame:
    """The comments of one verdict with the view's heading and their ``total`` per video.

    ``videos`` (video_id, title) adds ``video_title``. Totals fold before they are joined, so
    no video's comments are gathered; comments without a video are counted together.
    """
    rows = comments_by_verdict(scored, verdict)
    totals = rows.groupBy(F.col("video_id").alias("_video")).agg(F.count("*").alias("total"))
    if videos is not None:
        titles = videos.groupBy(F.col("video_id").alias("_titled")).agg(
            F.min("title").alias("video_title"))
        totals = totals.join(titles, F.col("_video") == F.col("_titled"), "left").drop("_titled")
    return rows.join(totals, F.col("video_id").eqNullSafe(F.col("_video"))).drop(
        "_video").withColumn("heading", F.lit(f"{verdict} Comments"))


def verdict_totals(scored: DataFrame, *by: str) -> DataFrame:
    """How many comments each verdict view lists."""
    return scored.groupBy(*by, "prediction").agg(F.count("*").alias("total"))


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    block_size: int = 200_000,
    name: str = "row_number",
) -> DataFrame:
    """Number the rows of each group from 1, in order of a unique integer position.

    Positions should be dense, such as a comment's place in its thread. Null groups are
    a group; rows without a position come last.

    A plain row_number would sort a whole group in one task. Here positions are cut
    into blocks; blocks are counted, a running sum over the block counts gives each
    block its offset, and rows are ranked inside their block only. Rows and block
    offsets meet on (group, block), the same keys the ranking needs.
    """
    group = list(group)
    blocked = df.withColumn("_block", F.floor(F.col(position) / block_size))
    before = Window.partitionBy(*group).orderBy(F.col("_block").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        blocked.groupBy(*group, "_block").agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in (*group, "_block")], "_offset")
    )
    same = F.lit(True)
    for k in (*group, "_block"):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*group, "_block").orderBy(position)
    return (
        blocked.join(offsets, same)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .select(name, *df.columns)
    )


def numbered_comments(scored: DataFrame, block_size: int = 200_000) -> DataFrame:
    """The comment listing: a number per video, null-free fields.

    A null position stays null, so its row comes last rather than tie with the first.
    """
    filled = scored.fillna("").fillna(0.0, [c for c in scored.columns if c != "position"])
    return number_rows(filled, ["video_id"], "position", block_size)


def owner_source(c: Column | str = "source") -> Column:
    """Source with the default for null and empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("text"))


