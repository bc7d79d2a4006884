"""Daily counts of a stream in a bounded number of files.

``flows.daily_partials`` writes a folder for every micro-batch, for as long as the stream
runs. Here a batch's counts go to one of ``SLOTS`` folders, and before a slot is written
again all slots are folded into the totals. The totals lie in two folders that take turns:
a fold writes the older one, with the number of the last batch it holds, and a small file
written after it makes it count. So there are never more than ``SLOTS`` + 2 folders, every
row is counted once wherever a run is cut short, and days show while they are open.

A row is late when its day ended before the newest day of the batches before its own; late
rows are counted as any other, and again by themselves. A reader should be done before the
stream has folded twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from comity.sources.history_table import read_or_empty
from comity.streaming.flows import tally

SLOTS = 32
COUNTS = ("total", "toxic", "non_toxic", "late")
MARK_SCHEMA = T.StructType([
    T.StructField("batch", T.LongType()), T.StructField("newest", T.DateType())])


class DailyTable:
    """Rows and verdicts per day and ``by`` columns; ``types`` of those that are no long."""

    def __init__(
        self, spark: SparkSession, path: str, *by: str,
        types: Mapping[str, T.DataType] | None = None, slots: int = SLOTS,
    ):
        self.spark, self.path, self.by, self.slots = spark, path.rstrip("/"), by, slots
        self._schema = T.StructType([
            T.StructField("activity_date", T.DateType()),
            *[T.StructField(c, (types or {}).get(c, T.LongType())) for c in by],
            *[T.StructField(c, T.LongType()) for c in COUNTS],
        ])
        #: A slot's rows name their batch: what a slot held before may have been folded.
        self._slot_schema = T.StructType([
            *self._schema, T.StructField("batch", T.LongType())])

    # --- what counts ---

    def _mark(self) -> tuple[int, int, object]:
        """The turn that counts, the last batch it holds, and the newest day of these.

        The first fold writes turn 1, so turn 0 is empty until there is a mark.
        """
        found = (0, -1, None)
        for turn in (0, 1):
            row = read_or_empty(self.spark, f"{self.path}/mark{turn}", MARK_SCHEMA).first()
            if row is not None and row["batch"] > found[1]:
                found = (turn, row["batch"], row["newest"])
        return found

    def _open(self, mark: int) -> DataFrame:
        """The counts of batches that have not been folded."""
        return read_or_empty(
            self.spark, f"{self.path}/slots", T.StructType([
                *self._slot_schema, T.StructField("slot", T.IntegerType())])
        ).filter(F.col("batch") > mark).select(*self._schema.names, "batch")

    def _all(self, turn: int, mark: int) -> DataFrame:
        totals = read_or_empty(self.spark, f"{self.path}/totals{turn}", self._schema)
        rows = totals.unionByName(self._open(mark).drop("batch"))
        return rows.groupBy("activity_date", *self.by).agg(
            *[F.sum(c).alias(c) for c in COUNTS])

    def totals(self) -> DataFrame:
        """Rows and verdicts per day over all batches; no rows before the first."""
        turn, mark, _ = self._mark()
        return self._all(turn, mark).drop("late")

    def late_rows(self) -> DataFrame:
        """The days that rows came late for, and how many."""
        turn, mark, _ = self._mark()
        return self._all(turn, mark).groupBy("activity_date").agg(
            F.sum("late").alias("late")).filter(F.col("late") > 0)

    # --- changes ---

    def fold(self, before: int) -> None:
        """Add the slots' batches up to ``before`` to the totals.

        Rows are as many as days times owners, kept in order of days.
        """
        turn, mark, newest = self._mark()
        if before <= mark:
            return
        open_now = self._open(mark).filter(F.col("batch") <= before)
        latest = open_now.agg(F.max("activity_date")).first()[0]
        newest = max((d for d in (newest, latest) if d is not None), default=None)
        totals = read_or_empty(self.spark, f"{self.path}/totals{turn}", self._schema)
        both = totals.unionByName(open_now.drop("batch")).groupBy("activity_date", *self.by).agg(
            *[F.sum(c).alias(c) for c in COUNTS])
        other = 1 - turn
        both.repartitionByRange("activity_date", *self.by).sortWithinPartitions(
            "activity_date").write.mode("overwrite").parquet(f"{self.path}/totals{other}")
        self.spark.createDataFrame([(before, newest)], MARK_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/mark{other}")

    def add(self, batch: DataFrame, number: int, time_col: str = "created_at") -> None:
        """Count a micro-batch; a repeated one replaces its own counts."""
        _, mark, newest = self._mark()
        if number <= mark:
            return
        if number > mark + self.slots:
            self.fold(number - 1)
            _, mark, newest = self._mark()
        earlier = self._open(mark).filter(F.col("batch") < number).agg(
            F.max("activity_date")).first()[0]
        newest = max((d for d in (newest, earlier) if d is not None), default=None)
        day = F.to_date(time_col)
        late = F.lit(False) if newest is None else day < F.lit(newest)
        counts = batch.groupBy(day.alias("activity_date"), *self.by).agg(
            *tally(), F.count_if(late).alias("late"))
        counts.withColumn("batch", F.lit(number).cast("long")).select(
            *self._slot_schema.names
        ).write.mode("overwrite").parquet(f"{self.path}/slots/slot={number % self.slots}")

    def stream(
        self, history: DataFrame, checkpoint: str, time_col: str = "created_at"
    ) -> StreamingQuery:
        """Count all that has landed, batch by batch, and stop when drained."""
        def write(batch: DataFrame, number: int) -> None:
            self.add(batch, number, time_col)

        return (
            history.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
