"""The dashboard's counters, kept up to date from the days that changed.

A row of the counters is an owner's share of a day and a source: rows, verdicts, and rows
that reach the threshold of each label. All of them add up, so every report is a sum over
these few rows instead of a scan of the history.

``refresh`` compares the files that make up each day of the ``HistoryTable`` with those the
day's counters were made of, and counts only days whose files differ again: days that an
upload, a stream or an erasure has touched. A day's counters are replaced as a whole by one
file of the log; a refresh that is cut short leaves the counters as they were. One job at a
time may refresh.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity import constants as K
from comity.functions.text import or_empty, strip
from comity.functions.values import label_score, parse_label_map, percent
from comity.operators.history import owner_source
from comity.operators.reports import NON_TOXIC, TOXIC
from comity.sources.history_table import HistoryTable, read_or_empty

MEASURES = ("total", "toxic", "non_toxic", *[f"{label}_count" for label in K.LABELS])
LOG_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("day", T.StringType()),
    T.StructField("made_of", T.StringType()),
    T.StructField("segment", T.StringType()),
])
SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("source", T.StringType()),
    *[T.StructField(m, T.LongType()) for m in MEASURES],
    T.StructField("segment", T.StringType()),
    T.StructField("created_date", T.DateType()),
])


def counted(rows: DataFrame, threshold: float = K.LABEL_THRESHOLD) -> DataFrame:
    """The counters of some rows of the history, per owner, day and source."""
    verdict = F.lower("prediction")
    rows = rows.withColumn("_labels", parse_label_map("labels_json"))
    return rows.groupBy("user_id", "created_date", "source").agg(
        F.count("*").alias("total"),
        F.count_if(verdict.isin(list(TOXIC))).alias("toxic"),
        F.count_if(verdict.isin(list(NON_TOXIC))).alias("non_toxic"),
        *[F.count_if(label_score(F.col("_labels"), label) >= threshold).alias(f"{label}_count")
          for label in K.LABELS],
    )


def _sum(name: str, condition: Column | None = None) -> Column:
    value = F.col(name) if condition is None else F.when(condition, F.col(name)).otherwise(0)
    return F.sum(value)


class DayCounts:
    def __init__(self, history: HistoryTable, path: str):
        self.history, self.path = history, path.rstrip("/")
        self.spark: SparkSession = history.spark

    def _known(self) -> dict[str, tuple[str, str | None]]:
        """What each day's counters were made of, and the segment they lie in."""
        log = read_or_empty(self.spark, f"{self.path}/log", LOG_SCHEMA)
        last = log.groupBy("day").agg(
            F.max_by(F.struct("made_of", "segment"), "version").alias("last"))
        return {r["day"]: tuple(r["last"]) for r in last.collect()}

    def _version(self) -> int:
        log = read_or_empty(self.spark, f"{self.path}/log", LOG_SCHEMA)
        return log.agg(F.max("version")).first()[0] or 0

    def refresh(self) -> list[str]:
        """Count the days that changed again; the names of their folders.

        Names of files and days come to the driver, as in the history table itself.
        """
        files: dict[str, list[str]] = {}
        for name in self.history._files():
            files.setdefault(name.split("/")[1], []).append(name)
        made_of = {day: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()
                   for day, names in files.items()}
        known = self._known()
        changed = sorted(d for d, of in made_of.items() if known.get(d, (None,))[0] != of)
        gone = sorted(d for d, (of, _) in known.items() if of is not None and d not in made_of)
        if not changed and not gone:
            return []
        version, segment = self._version() + 1, uuid.uuid4().hex
        made = set()
        if changed:
            rows = self.history._scan([name for day in changed for name in files[day]])
            path = f"{self.path}/data/segment={segment}"
            counted(rows).hint("rebalance", "created_date").write.partitionBy(
                "created_date").parquet(path)
            written = read_or_empty(self.spark, path, SCHEMA).inputFiles()
            made = {name.split("/")[-2] for name in written}
        entries = [(version, d, made_of[d], segment if d in made else None) for d in changed]
        entries += [(version, d, None, None) for d in gone]
        self.spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/log")
        return changed + gone

    def read(self) -> DataFrame:
        """The counters that hold: user_id, created_date, source and the measures."""
        folders = [f"{self.path}/data/segment={segment}/{day}"
                   for day, (_, segment) in sorted(self._known().items()) if segment]
        if folders:
            rows = self.spark.read.schema(SCHEMA).option(
                "basePath", f"{self.path}/data").parquet(*folders)
        else:
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.drop("segment")

    # --- the reports ---

    def dashboard(self, as_of: str) -> DataFrame:
        """``reports.dashboard`` over the counters."""
        source = F.lower(strip(or_empty("source")))
        return self.read().groupBy("user_id").agg(
            *[_sum(m).alias(m) for m in ("total", "toxic", "non_toxic")],
            _sum("total", F.col("created_date") == F.lit(as_of).cast("date")).alias("today"),
            _sum("total", source == "twitter").alias("twitter"),
            _sum("total", source == "csv").alias("csv"),
            _sum("total", source.isin("text", "api")).alias("text"),
            *[_sum(f"{label}_count").alias(f"{label}_count") for label in K.LABELS],
        ).withColumn("toxicity_rate", percent(F.col("toxic"), F.col("total"), 1))

    def daily_activity(self) -> DataFrame:
        """``reports.daily_activity`` of all days over the counters."""
        return self.read().groupBy("user_id", F.col("created_date").alias("activity_date")).agg(
            _sum("total").alias("total"))

    def source_distribution(self) -> DataFrame:
        """``reports.source_distribution`` over the counters, in no order."""
        return self.read().groupBy("user_id", owner_source().alias("_source")).agg(
            _sum("total").alias("rows")
        ).select("user_id", F.upper("_source").alias("source"), "rows")

    def label_counts(self) -> DataFrame:
        """``reports.label_counts`` over the counters."""
        return self.read().groupBy("user_id").agg(
            *[_sum(f"{label}_count").alias(label) for label in K.LABELS])
