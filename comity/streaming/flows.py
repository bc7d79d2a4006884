"""Streams over landed files. Each run drains what has landed and stops."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from comity.operators.reports import NON_TOXIC, TOXIC
from comity.sources.history_table import HistoryTable, read_or_empty


def landed_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_pattern: str | None = None,
    files_per_batch: int | None = 1000,
) -> DataFrame:
    """A stream of the Parquet files in a folder, ``files_per_batch`` of them at a time.

    The bound keeps a large backlog from becoming one batch; later batches take the rest.
    """
    reader = spark.readStream.schema(schema)
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's rows to a table, exactly once, and stop when drained."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_and_append(
    comments: DataFrame,
    to_history: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Run a stateless scoring plan over the stream and append its history rows.

    ``to_history`` is the same function a batch job applies, so both give equal rows.
    """
    return append_stream(to_history(comments), path, checkpoint)


def stream_into(
    rows: DataFrame,
    to_history: Callable[[DataFrame], DataFrame],
    path: str,
    run_id: str,
    checkpoint: str,
) -> StreamingQuery:
    """Add the stream's rows to a ``HistoryTable``, each micro-batch as a batch of the run.

    A batch that is replayed after a failure finds itself in the table and adds nothing.
    Batches are numbered by the checkpoint, so a new checkpoint needs a new ``run_id``.
    """
    def add(batch: DataFrame, number: int) -> None:
        HistoryTable(batch.sparkSession, path).add(to_history(batch), run_id, number)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _as_instant(c: str) -> Column:
    """Wall-clock time as the instant with that UTC time, whatever the session's zone.

    Watermarks need instants, and day windows are aligned to UTC.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c)))


def daily_partials(
    history: DataFrame, path: str, checkpoint: str, *by: str, time_col: str = "created_at"
) -> StreamingQuery:
    """Write the rows and verdicts per day of every micro-batch; stop when drained.

    ``daily_totals`` adds them up. Days show while they are open, late rows count whenever
    they come, and no state is held. A repeated batch replaces its own counts.
    """
    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.to_date(time_col).alias("activity_date"), *by).agg(*tally())
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        history.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_totals(
    spark: SparkSession, path: str, *by: str, types: Mapping[str, T.DataType] | None = None
) -> DataFrame:
    """Rows and verdicts per day over all batches that ``daily_partials`` has written.

    No rows before the first batch. ``types`` gives the type of each ``by`` that is no long.
    """
    of = types or {}
    schema = T.StructType([
        T.StructField("activity_date", T.DateType()),
        *[T.StructField(c, of.get(c, T.LongType())) for c in by],
        *[T.StructField(c, T.LongType()) for c in ("total", "toxic", "non_toxic")],
    ])
    return read_or_empty(spark, path, schema).groupBy("activity_date", *by).agg(
        *[F.sum(c).alias(c) for c in ("total", "toxic", "non_toxic")]
    )


def tally() -> list[Column]:
    verdict = F.lower("prediction")
    return [
        F.count("*").alias("total"),
        F.count_if(verdict.isin(list(TOXIC))).alias("toxic"),
        F.count_if(verdict.isin(list(NON_TOXIC))).alias("non_toxic"),
    ]


def daily_counts(
    history: DataFrame, *by: str, late: str = "1 day", time_col: str = "created_at"
) -> DataFrame:
    """Rows and verdicts per day, each day once, when the watermark has passed its end.

    Open days are not shown and rows later than ``late`` are dropped; ``daily_partials``
    does neither.
    """
    if isinstance(history.schema[time_col].dataType, T.TimestampNTZType):
        history = history.withColumn(time_col, _as_instant(time_col))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return (
        history.withWatermark(time_col, late)
        .groupBy(F.window(time_col, "1 day"), *by)
        .agg(*tally())
        .select(
            day.alias("activity_date"), *by,
            "total", "toxic", "non_toxic",
        )
    )
