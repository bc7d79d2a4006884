"""Landed comment-API responses → flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.functions.text import is_blank, strip

_COMMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", T.StructType([
        T.StructField("parentId", T.StringType()),
        T.StructField("authorDisplayName", T.StringType()),
        T.StructField("textDisplay", T.StringType()),
    ])),
])
PAGE_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("snippet", T.StructType([
            T.StructField("topLevelComment", _COMMENT),
            T.StructField("totalReplyCount", T.LongType()),
        ])),
        T.StructField("replies", T.StructType([
            T.StructField("comments", T.ArrayType(_COMMENT)),
        ])),
    ]))),
    T.StructField("nextPageToken", T.StringType()),
])
VIDEO_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("channelTitle", T.StringType()),
            T.StructField("publishedAt", T.StringType()),
        ])),
        T.StructField("statistics", T.StructType([
            T.StructField("viewCount", T.StringType()),
            T.StructField("likeCount", T.StringType()),
            T.StructField("commentCount", T.StringType()),
        ])),
    ]))),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed thread pages, one JSON object per line."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def parse_pages(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """Thread pages held as JSON text in a column."""
    return df.select(*keep, F.from_json(json_col, PAGE_SCHEMA).alias("_page")).select(
        *keep, "_page.*"
    )


def _row(comment: Column, parent: Column, is_reply: bool) -> Column:
    snippet = comment["snippet"]
    return F.struct(
        comment["id"].alias("comment_id"),
        parent.alias("parent_id"),
        F.coalesce(snippet["authorDisplayName"], F.lit("Unknown")).alias("author"),
        F.coalesce(snippet["textDisplay"], F.lit("")).alias("text"),
        F.lit(is_reply).alias("is_reply"),
    )


def _replies(item: Column, fetched_only: bool) -> Column:
    none = F.array().cast(T.ArrayType(_COMMENT))
    replies = F.coalesce(item["replies"]["comments"], none)
    if fetched_only:
        count = F.coalesce(item["snippet"]["totalReplyCount"], F.lit(0))
        replies = F.when(count > 0, replies).otherwise(none)
    return replies


def flatten_pages(
    pages: DataFrame,
    video: str = "video_id",
    page: str = "page_number",
    *keep: str,
    include_replies: bool = True,
    fetched_only: bool = False,
    block: int = 1000,
) -> DataFrame:
    """``flatten_threads`` with ``position``, a comment's place in its video from 0.

    Comments stand in order of page, item, and reply. A comment's place in its page is known
    where the page is unfolded; where the page starts follows from the sizes of the pages
    before it. Sizes are added up in blocks of ``block`` pages, so no window holds a video.
    ``page`` must be a number of its own for each page of a video.
    """
    def rows_of(item: Column) -> Column:
        top = F.array(_row(item["snippet"]["topLevelComment"], F.lit(None).cast("string"), False))
        if not include_replies:
            return top
        return F.concat(top, F.transform(
            _replies(item, fetched_only), lambda r: _row(r, r["snippet"]["parentId"], True)))

    def size_of(item: Column) -> Column:
        return 1 + (F.size(_replies(item, fetched_only)) if include_replies else 0)

    present = F.filter("items", lambda item: item.isNotNull())
    sizes = pages.select(
        video, page, F.floor(F.col(page) / block).alias("_block"),
        F.aggregate(present, F.lit(0).cast("long"), lambda n, item: n + size_of(item)).alias("_n"))
    before = Window.partitionBy(video).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy(video, "_block").agg(F.sum("_n").alias("_n")).select(
        F.col(video).alias("_v"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(video, "_block").orderBy(page).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(blocks, F.col(video).eqNullSafe(F.col("_v")) & F.col("_block").eqNullSafe(F.col("_b")))
        .select("_v", F.col(page).alias("_p"), (F.col("_base") + F.col("_in")).alias("_from"))
    )
    of = F.col(video).eqNullSafe(F.col("_v")) & F.col(page).eqNullSafe(F.col("_p"))
    names = dict.fromkeys([video, page, *keep])
    unfolded = pages.select(*names, F.posexplode(F.flatten(F.transform(present, rows_of))).alias(
        "_at", "_comment"))
    return unfolded.join(starts, of).select(
        *names, (F.col("_from") + F.col("_at")).alias("position"), "_comment.*")


def flatten_threads(
    pages: DataFrame, *keep: str, include_replies: bool = True, fetched_only: bool = False
) -> DataFrame:
    """One row per comment: each thread's top comment, then its replies.

    A single pass over the pages: every item unfolds into its own rows. ``fetched_only``
    takes replies only where the thread reports a positive reply count.
    """
    # Outer explodes: the plain form adds a filter that parses the page a second time.
    item = F.col("item")
    items = pages.select(*keep, F.explode_outer("items").alias("item")).filter(
        item.isNotNull()
    )
    top = item["snippet"]["topLevelComment"]
    rows = F.array(_row(top, F.lit(None).cast("string"), False))
    if include_replies:
        rows = F.concat(rows, F.transform(
            _replies(item, fetched_only), lambda r: _row(r, r["snippet"]["parentId"], True)))
    return items.select(*keep, F.inline_outer(rows))


def typed_comments(comments: DataFrame, source: str = "youtube") -> DataFrame:
    """The analysis shape: trimmed, non-blank text with a ``comment_type``."""
    kind = F.when(F.col("is_reply"), "reply").otherwise("top_level")
    return (
        comments.filter(~is_blank("text"))
        .withColumns({"text": strip("text"), "source": F.lit(source), "comment_type": kind})
        .drop("is_reply")
    )


def collected_comments(comments: DataFrame, source: str = "youtube") -> DataFrame:
    """The collector shape: replies are told apart by ``<source>_reply``."""
    tag = F.when(F.col("is_reply"), f"{source}_reply").otherwise(source)
    return comments.select("text", tag.alias("source"), "video_id")


def video_info(df: DataFrame, json_col: str, id_col: str = "video_id") -> DataFrame:
    """Flat video rows from landed responses, one for each item.

    A video's id is its item's, or else the request's; no items give no row.
    """
    def count(c: Column) -> Column:
        return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    item = F.col("_item")
    return (
        df.select(id_col, F.from_json(json_col, VIDEO_SCHEMA)["items"].alias("_items"))
        .select(id_col, F.explode_outer("_items").alias("_item"))
        .filter(item.isNotNull())
        .select(
            F.coalesce(item["id"], F.col(id_col)).alias("video_id"),
            text(item["snippet"]["title"]).alias("title"),
            text(item["snippet"]["channelTitle"]).alias("channel"),
            text(item["snippet"]["publishedAt"]).alias("published_at"),
            count(item["statistics"]["viewCount"]).alias("view_count"),
            count(item["statistics"]["likeCount"]).alias("like_count"),
            count(item["statistics"]["commentCount"]).alias("comment_count"),
        )
    )
