"""The end-to-end flows: batch upload, video analysis, dataset preparation, tweets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comity.functions.values import score_columns
from comity.operators import dataset, reports, training, verdicts
from comity.operators.scoring import LexiconScorer, may_fail
from comity.sources import readers, sinks, threads
from comity.sources.history_table import HistoryTable
from comity.workspace import new_path


def upload(
    spark: SparkSession,
    csv_path: str,
    history_path: str,
    user_id: int,
    created_at: Column,
    scorer=None,
    run_id: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Score an uploaded CSV once, add it to the history table, and summarise it.

    Each file is read in its own encoding. A column ``lang`` or ``language`` gives the
    language, English without one. An upload is a run of ``HistoryTable``: repeating it adds
    nothing. By default the run is named by user, time and path. Rows that the scorer fails
    on are counted in the summary and kept out of the history.
    """
    scorer = scorer or LexiconScorer()
    sheet = readers.read_comments_csv_any_encoding(
        spark, csv_path, multi_line=multi_line, positions=True, infer=False)
    columns = [c for c in sheet.columns if c not in readers.POSITION]
    named = readers.find_column(columns, ("lang", "language"))
    lang = F.col(f"`{named}`").cast("string") if named else F.lit("en")
    comments = sheet.select(
        *readers.POSITION, lang.alias("_lang"), F.lit(user_id).cast("bigint").alias("user_id"),
        F.col(f"`{readers.pick_text_column(columns)}`").cast("string").alias("text"))
    judged = verdicts.score_and_judge(comments, scorer, lang_col="_lang")
    path = new_path(spark, "upload")
    judged.write.parquet(path)
    scored = spark.read.schema(judged.schema).parquet(path)
    scores = score_columns(scorer.labels)
    if run_id is None:
        time = spark.range(1).select(created_at.cast("string")).first()[0]
        run_id = f"upload:{user_id}:{time}:{csv_path}"
    rows = sinks.history_rows(
        scored, "csv", scores, created_at, may_fail(scorer), keep=readers.POSITION)
    HistoryTable(spark, history_path).add(rows, run_id, position=readers.POSITION)
    return reports.upload_summary(scored, scores)


def analyse_videos(
    pages: DataFrame,
    comments_path: str,
    analyses_path: str,
    run_id: str,
    created_at: Column,
    scorer=None,
) -> DataFrame:
    """Flatten thread pages, score the comments, store them, and summarise per video.

    ``pages`` carries user_id and video_id, and may carry page_number, which gives each
    comment its position. The scored rows are written once; the summary reads them back
    instead of scoring again. Repeating a run replaces it.
    """
    spark = pages.sparkSession
    if "page_number" in pages.columns:
        comments = threads.flatten_pages(pages, "video_id", "page_number", "user_id")
    else:
        comments = threads.flatten_threads(pages, "user_id", "video_id")
    scored = verdicts.score_and_judge(comments, scorer)
    scores = score_columns((scorer or LexiconScorer()).labels)
    sinks.write_run(sinks.comment_rows(scored, scores, created_at), comments_path, run_id)

    stored = spark.read.parquet(comments_path).filter(F.col("run_id") == run_id)
    summary = summarise_stored(stored)
    sinks.write_run(sinks.analysis_rows(summary, created_at), analyses_path, run_id)
    return summary


def summarise_stored(stored: DataFrame) -> DataFrame:
    """Per-video summary of stored comment rows, labels read from their JSON."""
    from comity import constants as K
    from comity.functions.values import label_score, parse_label_map

    parsed = stored.withColumn("_labels", parse_label_map("labels_json"))
    flags = {
        label: label_score(F.col("_labels"), label) >= K.LABEL_THRESHOLD
        for label in K.LABELS
    }
    return reports.comment_summary(parsed, flags, "user_id", "video_id")


def prepare_dataset(labelled: DataFrame, out_path: str | None = None) -> DataFrame:
    """Clean, dedupe and split labelled texts (row_key, class, tweet).

    The deduped table is written before splitting: the split reads it several times,
    and a lost executor then costs a re-read rather than a re-clean.
    """
    spark = labelled.sparkSession
    cleaned = dataset.clean_labelled(labelled)
    deduped = dataset.keep_first(cleaned, "tweet", "row_key")
    path = out_path or new_path(spark, "deduped")
    deduped.write.mode("overwrite").parquet(path)
    return dataset.stratified_split(spark.read.parquet(path))


def train_and_evaluate(split: DataFrame, **options):
    """Fit on train, choose on val, and return the model with its val metrics and the
    confusion counts on test."""
    from comity.operators import evaluate

    parts = {s: split.filter(F.col("split") == s) for s in dataset.SPLITS}
    model, metrics = training.train_classifier(parts["train"], parts["val"], **options)
    predicted = model.transform(parts["test"]).withColumn(
        "prediction", F.col("prediction").cast("int")
    )
    counts = evaluate.confusion_counts(predicted, actual="class")
    return model, metrics, counts


def tweets_to_history(
    tweets: DataFrame, created_at: Column, scorer: LexiconScorer | None = None
) -> DataFrame:
    """Classify tweets (user_id, text) and shape them as rows for ``HistoryTable.add``."""
    rows = verdicts.tweet_history(verdicts.classify_tweets(tweets, scorer))
    return sinks.history_rows(rows, "twitter", None, created_at, False)
