"""The moderation tables, derived by Spark from the star-schema test tables.

documents → comments, events → prediction history, conversations → video comments,
labels → truth. The documents lack most of the phrases the rules look for, so
``phrased_documents`` puts one in front of every text, chosen by its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comity.functions import text as tx
from comity.functions.values import score_columns
from comity.operators import verdicts
from comity.operators.scoring import LexiconScorer, score_table
from comity.sources.readers import spread

PHRASES = {
    "src0": "You are stupid.",
    "src1": "You're an idiot!",
    "src2": "I will hurt you",
    "src3": "I hate this person because of their race",
    "src4": "I hate you",
    "src5": "This is disgusting",
    "src6": "You are a terrible person",
    "src7": "I love everyone",
    "src8": "Have a wonderful day",
    "src9": "You are such an idiot.",
    "src10": "Stop being so annoying.",
    "src11": "People of that ethnicity should not be allowed here.",
    "src12": "people from that group should be banned",
    "src13": "RT @ann: look https://t.co/a1 now",
    "src14": "rtx card WWW.shop.example/x &amp;amp; more",
    "src15": "mail @josé\\n and\ttab &lt;b&gt;",
    "src16": "Shut  up @bob",
    "src17": "You're going to die",
    "src18": "immigrants should leave our community",
    "src19": "RT hello I'm going to kill you @x",
}
AS_OF = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    )


def phrased_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [F.lit(x) for item in PHRASES.items() for x in item]
    phrase = F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit("")
    )
    return documents(spark, sf_dir).withColumn("text", F.concat(phrase, F.lit(" "), "text"))


def three_class_truth() -> Column:
    """Toxic and low quality → 0, toxic → 1, else 2."""
    return (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 0)
        .when(F.col("toxic") == 1, 1)
        .otherwise(2)
    )


#: Sources whose phrases make these labels true.
INSULTING = ("src0", "src1", "src6", "src9")
THREATENING = ("src2", "src17", "src19")
EXCLUDING = ("src3", "src18")


def label_truths() -> dict[str, Column]:
    """A truth of its own for every label, from the labels table and the phrases."""
    def among(sources: tuple[str, ...]) -> Column:
        return F.coalesce(F.col("source").isin(list(sources)), F.lit(False)).cast("int")

    rare = F.col("toxic") * (1 - F.col("quality"))
    return {
        "toxic": F.col("toxic"), "insult": among(INSULTING), "obscene": rare,
        "severe_toxic": F.greatest(rare, among(("src17",))), "threat": among(THREATENING),
        "identity_hate": among(EXCLUDING),
    }


def labelled(spark: SparkSession, sf_dir: str, phrased: bool = True) -> DataFrame:
    """Documents with truth; an equi-join whose strategy is left to the optimizer."""
    docs = (phrased_documents if phrased else documents)(spark, sf_dir)
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts as (row_key, class, tweet)."""
    return labelled(spark, sf_dir, phrased=False).select(
        F.col("doc_id").alias("row_key"),
        three_class_truth().alias("class"),
        F.col("text").alias("tweet"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(documents(spark, sf_dir), LexiconScorer())


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.with_verdict(
        scored_documents(spark, sf_dir),
        verdicts.any_label(score_columns(), blank=tx.is_blank("text")),
    )


def video_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comment rows: the first turn is the top comment."""
    first = F.concat_ws("-", F.col("conv_id"), F.lit(0))
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES.values()]), F.col("turn").cast("int"))
    return spread(table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("user_id"),
        F.col("conv_id").cast("string").alias("video_id"),
        F.col("turn").alias("position"),
        F.concat_ws("-", "conv_id", "turn").alias("comment_id"),
        F.when(F.col("turn") > 0, first).alias("parent_id"),
        F.col("role").alias("author"),
        F.concat(F.coalesce(phrase, F.lit("")), F.lit(" "), "text").alias("text"),
        (F.col("turn") > 0).alias("is_reply"),
    )


def scored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.score_and_judge(video_comments(spark, sf_dir))


def thread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a landed thread page: first line on top, other lines replies."""
    lines = F.split("text", "\n")

    def comment(key: Column, author: Column, text: Column, parent: Column) -> Column:
        return F.struct(
            key.alias("id"),
            F.struct(
                parent.alias("parentId"), author.alias("authorDisplayName"),
                text.alias("textDisplay"),
            ).alias("snippet"),
        )

    key = F.col("doc_id").cast("string")
    nobody = F.when(F.col("lang") != "fr", F.col("source"))
    top = comment(key, nobody, F.get(lines, F.lit(0)), F.lit(None).cast("string"))
    replies = F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda line, i: comment(
            F.concat_ws(".", key, (i + 1).cast("string")), nobody, line, key
        ),
    )
    item = F.struct(
        F.struct(
            top.alias("topLevelComment"), (F.size(lines) - 1).alias("totalReplyCount")
        ).alias("snippet"),
        F.struct(replies.alias("comments")).alias("replies"),
    )
    return documents(spark, sf_dir).select(
        key.alias("video_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("page")
    )


def paged_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a video whose lines come in landed pages.

    A thread is a line and the two after it as replies; a page holds four threads.
    """
    key = F.col("doc_id").cast("string")
    lines = F.col("lines")

    def comment(line: Column, number: Column, parent: Column) -> Column:
        return F.struct(
            F.concat_ws(".", key, number.cast("string")).alias("id"),
            F.struct(
                parent.alias("parentId"), F.col("source").alias("authorDisplayName"),
                line.alias("textDisplay"),
            ).alias("snippet"),
        )

    def item(number: Column) -> Column:
        first = number * 3
        parent = F.concat_ws(".", key, first.cast("string"))
        replies = F.transform(
            F.slice(lines, first + 2, F.lit(2)),
            lambda line, i: comment(line, first + i + 1, parent))
        top = comment(F.get(lines, first), first, F.lit(None).cast("string"))
        return F.struct(
            F.struct(
                top.alias("topLevelComment"), F.size(replies).alias("totalReplyCount")
            ).alias("snippet"),
            F.struct(replies.alias("comments")).alias("replies"),
        )

    threads = F.floor((F.size(lines) + 2) / 3).cast("int")
    pages = F.sequence(F.lit(0), F.floor((threads - 1) / 4).cast("int"))
    return (
        documents(spark, sf_dir)
        .select("doc_id", "source", F.split("text", "\n").alias("lines"))
        .select("*", F.explode(pages).alias("page_number"))
        .select(
            key.alias("video_id"), "page_number",
            F.to_json(F.struct(F.transform(
                F.sequence(F.col("page_number") * 4,
                           F.least(F.col("page_number") * 4 + 3, threads - 1)),
                item).alias("items"))).alias("page"))
    )


def video_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a landed video response; some fields are missing."""
    docs = table(spark, sf_dir, "documents")
    body = F.struct(
        F.array(F.struct(
            F.struct(
                F.col("text").alias("title"),
                F.when(F.col("lang") != "de", F.col("source")).alias("channelTitle"),
                F.lit("2024-01-02T03:04:05Z").alias("publishedAt"),
            ).alias("snippet"),
            F.struct(
                F.col("n_chars").cast("string").alias("viewCount"),
                F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("likeCount"),
            ).alias("statistics"),
        )).alias("items")
    )
    empty = F.lit('{"items": []}')
    return docs.select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.when(F.col("source") == "src0", empty).otherwise(F.to_json(body)).alias("response"),
    )


def _events(events: DataFrame) -> DataFrame:
    """Parse the properties once, ahead of everything that uses their number."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _k() -> Column:
    return F.col("k")


def _score_text(factor: int) -> Column:
    """A two-digit score such as 0.07 out of the event's k."""
    return F.concat(F.lit("0."), F.lpad(((_k() * factor) % 100).cast("string"), 2, "0"))


FACTORS = {
    "toxic": 1, "severe_toxic": 7, "obscene": 13, "threat": 29, "insult": 41,
    "identity_hate": 53,
}
ODD_NAMES = {"severe_toxic": "Severe-Toxic", "identity_hate": "identity hate"}


def _label_json(names: dict[str, str], extra: str = "") -> Column:
    parts = []
    for label, factor in FACTORS.items():
        lead = ", " if parts else "{"
        parts += [F.lit(f'{lead}"{names.get(label, label)}": '), _score_text(factor)]
    return F.concat(*parts, F.lit(extra + "}"))


def history_from_events(events: DataFrame) -> DataFrame:
    """Events as prediction history, with odd spellings, bad JSON and failed rows."""
    kind = F.col("event_type")
    value = F.col("value")
    prediction = (
        F.when(value < 2, "Toxic").when(value < 4, "toxic").when(value < 8, "Non-Toxic")
        .when(value < 10, "non toxic").when(value < 14, "Hate Speech")
        .when(value < 16, "Offensive Language").when(value < 18, "Neither")
        .when(value < 19, "Error").when(value < 20, "Model Unavailable")
        .otherwise("Non-Toxic")
    )
    labels = (
        F.when(kind == "view", _label_json({}))
        .when(kind == "click", _label_json(ODD_NAMES))
        .when(kind == "purchase", _label_json({}, ', "hate_category": "threat"'))
        .when(kind == "signup", F.concat(
            F.lit('{"toxic": '), _score_text(1), F.lit(', "insult": "'), _score_text(41),
            F.lit('"}')))
        .when(_k() < 50, '{"toxic": 0.9')
    )
    source = (
        F.when(kind == "view", "text").when(kind == "click", "csv")
        .when(kind == "purchase", "api").when(kind == "signup", " Twitter ").otherwise("")
    )
    return _events(events).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat_ws(
            " ", F.lit("A comment on"), kind, F.lit("with properties"), "props",
            F.when(_k() > 60, "and a longer tail"),
        ).alias("input_text"),
        F.when(_k() < 90, "en").alias("language"),
        prediction.alias("prediction"),
        (_k() / 100).alias("confidence"),
        labels.alias("labels_json"),
        source.alias("source"),
        F.col("ts").alias("created_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_events(spread(table(spark, sf_dir, "events")))


def titled_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alternate analysis rows with a JSON map of label counts."""
    counts = F.concat(
        F.lit('{"toxic": '), _k().cast("string"), F.lit(', "insult": '),
        (_k() % 7).cast("string"), F.lit(', "other": 5}'),
    )
    kind = F.col("event_type")
    return _events(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(kind == "view", "YouTube").otherwise("Text").alias("analysis_type"),
        F.when(F.col("value") < 5, "Toxic").otherwise("Non-Toxic").alias("prediction"),
        F.when(kind != "error", counts).alias("category_counts"),
        F.col("ts").alias("created_at"),
    )
