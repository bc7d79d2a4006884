"""The prediction history as one table for uploads, tweets and streams.

Rows come in runs: an upload is a run, a micro-batch of a stream is one of its run's
batches. Data files lie below ``data/``; the small table ``log/`` says which of them count.
Each change of the table adds one file to the log, written by one task, so it is seen whole
or not at all, and a run that is cut short at any step leaves the table as it was.

* A run that has been added stays as it is: adding it again, or replaying its batch, does
  nothing, also after some of its rows were erased.
* Ids are made of the run's number and the row's place in the run. Later runs have larger
  ids, and a run that is repeated after a failure gets the ids it had.
* Erasing reads the table once, rewrites the files that hold a requested row and leaves all
  others alone. ``purge`` then empties the folders of the files that no longer count.

Only names of files and runs come to the driver. One job at a time may add or erase.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.sources.readers import HISTORY_SCHEMA
from comity.workspace import new_path

ROW_BITS = 40
#: Ids a page looks at first, as a multiple of its size: ids have gaps.
NEAR = 8
LOG_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("number", T.LongType()),
    T.StructField("file", T.StringType()),
])
#: What a file holds, and what the names of its folders add.
FILE_SCHEMA = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("run_id", T.StringType())])
ROW_SCHEMA = T.StructType([*FILE_SCHEMA.fields, T.StructField("created_date", T.DateType())])
_STORED = T.StructType([
    *FILE_SCHEMA.fields, T.StructField("segment", T.StringType()), ROW_SCHEMA["created_date"]])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def numbered(rows: DataFrame, block: Sequence[str], row: str, name: str) -> DataFrame:
    """Number rows from 1 by (block, row), with gaps where rows have been left out.

    The rows of a block, such as a split of a file, lie in one task and rise by one in
    ``row``. So one row for each block tells where its numbers start, and no row is sorted.
    These few are broadcast: a shuffle by block would gather all rows of a split in one task.
    """
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    width = F.col("_last") - F.col("_first") + 1
    starts = (
        rows.groupBy(*block).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
        .withColumn("_before", F.coalesce(F.sum(width).over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)], "_first", "_before")
    )
    same = F.lit(True)
    for i, c in enumerate(block):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return rows.join(F.broadcast(starts), same).withColumn(
        name, F.col("_before") + F.col(row) - F.col("_first") + 1).select(*rows.columns, name)


class HistoryTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/log", LOG_SCHEMA)

    def _commit(self, entries: list[tuple]) -> None:
        frame = self.spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{self.path}/log")

    def _known(self) -> dict[str, bool]:
        """Every file that was added, relative to ``data/``, and whether it counts."""
        of_files = self.log().filter(F.col("kind").isin("add", "remove")).groupBy("file").agg(
            F.bool_and(F.col("kind") == "add").alias("live"))
        return {r["file"]: r["live"] for r in of_files.collect()}

    def _files(self) -> list[str]:
        """The files that count."""
        return sorted(name for name, live in self._known().items() if live)

    def runs(self) -> DataFrame:
        """Run, batch and number of everything that was added."""
        return self.log().filter(F.col("kind") == "done").select("run_id", "batch", "number")

    def _number(self, run_id: str, batch: int) -> int:
        """The number of a run's batch; the first call for it sets it down in the log."""
        found = self.log().filter(F.col("kind") == "run").agg(
            F.max(F.when((F.col("run_id") == run_id) & (F.col("batch") == batch), F.col("number"))),
            F.max("number"),
        ).first()
        if found[0] is not None:
            return found[0]
        number = (found[1] or 0) + 1
        self._commit([("run", run_id, batch, number, None)])
        return number

    # --- rows ---

    def _scan(self, files: Collection[str]) -> DataFrame:
        """The rows of some files and their file: whole segments are listed, and the files
        that are not wanted are left out by name, before any of them is opened."""
        if not files:
            return self.spark.createDataFrame([], _STORED).withColumn("_file", F.lit(""))
        files = set(files)
        segments = sorted({name.split("/")[0] for name in files})
        rows = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(
            *[f"{self.path}/data/{name}" for name in segments])
        rows = rows.withColumn("_file", _relative(F.col("_metadata.file_path")))
        others = [name for name in self._known()
                  if name not in files and name.split("/")[0] in set(segments)]
        if len(others) > len(files):
            return rows.filter(F.col("_file").isin(sorted(files)))
        return rows.filter(~F.col("_file").isin(sorted(others))) if others else rows

    def read(self) -> DataFrame:
        """All rows that count, with ``run_id`` and ``created_date``."""
        return self._scan(self._files()).select(*ROW_SCHEMA.names)

    def page(self, size: int = 20, before_id: int | None = None) -> DataFrame:
        """One page, newest first, of rows older than ``before_id``, as ``history.page``.

        Only as many of the newest runs are read as hold a page: within the run of
        ``before_id`` a range of ids just below it, then one more run, two, four, and so on.
        Ranges of ids reach the files, whose rows are sorted by id, as minima and maxima.
        """
        rows = self.read()
        numbers = sorted((r["number"] for r in self.runs().select("number").collect()), reverse=True)
        if before_id is None:
            before_id = (numbers[0] + 1 if numbers else 0) << ROW_BITS
        older = [n << ROW_BITS for n in numbers if n << ROW_BITS < before_id]
        lows = [max(older[0], before_id - NEAR * size)] if older else []
        runs = 1
        while runs < 2 * len(older):
            lows.append(older[min(runs, len(older)) - 1])
            runs *= 2
        for low in lows:
            span = rows.filter((F.col("id") >= low) & (F.col("id") < before_id))
            # Stops reading when the page is full.
            if low == lows[-1] or span.select("id").limit(size).count() == size:
                return span.orderBy(F.desc("id")).limit(size)
        return rows.limit(0)

    def _write(self, rows: DataFrame, segment: str) -> list[str]:
        """Write rows by day, in order of id within each file, and name the files made.

        The rebalance keeps a hot day from becoming one huge task, and many small days from
        becoming many small files; the order lets a page of the listing skip row groups.
        """
        path = f"{self.path}/data/segment={segment}"
        rows.select(*ROW_SCHEMA.names).hint("rebalance", "created_date").sortWithinPartitions(
            "created_date", "id"
        ).write.mode("overwrite").partitionBy("created_date").parquet(path)
        made = read_or_empty(self.spark, path, ROW_SCHEMA).inputFiles()
        return [name[name.index(f"segment={segment}/"):] for name in made]

    def add(
        self, rows: DataFrame, run_id: str, batch: int = 0, position: Sequence[str] | None = None
    ) -> bool:
        """Add a run's rows (``sinks.history_rows``); False if it was added before.

        ``position`` names the columns of the rows' order: those of a block, then the row in
        it (see ``numbered``). Without it rows are numbered as they come.
        """
        same = (F.col("run_id") == run_id) & (F.col("batch") == batch)
        if not self.runs().filter(same).isEmpty():
            return False
        number = self._number(run_id, batch)
        if position is None:
            # Written once: numbers are taken from rows that no longer change.
            rows = rows.withColumn("_row", F.monotonically_increasing_id())
            staged = new_path(self.spark, "history-run")
            rows.write.parquet(staged)
            rows = self.spark.read.schema(rows.schema).parquet(staged).withColumn(
                "_task", F.shiftright("_row", 33))
            position = ("_task", "_row")
        *block, row = position
        placed = numbered(rows, block, row, "_number").withColumns({
            "id": F.lit(number << ROW_BITS) + F.col("_number"),
            "run_id": F.lit(run_id),
            "created_at": F.col("created_at").cast(HISTORY_SCHEMA["created_at"].dataType),
        }).withColumn("created_date", F.to_date("created_at"))
        files = self._write(placed, f"r{number}")
        self._commit([("done", run_id, batch, number, None),
                      *[("add", run_id, batch, number, name) for name in files]])
        return True

    def erase(self, requests: DataFrame, keys: Sequence[str]) -> int:
        """Leave out the rows that match a request on ``keys``; the number of files rewritten.

        ``keys`` are ``user_id``, or ``user_id`` and ``id``.
        """
        keys = list(keys)
        staged = new_path(self.spark, "erasure")
        asked = requests.select(*keys).distinct()
        asked.write.parquet(staged)
        asked = self.spark.read.schema(asked.schema).parquet(staged)
        hit = self._scan(self._files()).join(asked, keys, "left_semi").select("_file").distinct()
        touched = [r["_file"] for r in hit.collect()]
        if touched:
            self._replace(touched, self._scan(touched).join(asked, keys, "left_anti"))
        return len(touched)

    def _replace(self, files: Collection[str], rows: DataFrame) -> None:
        made = self._write(rows, f"e{uuid.uuid4().hex}")
        self._commit([*[("remove", None, None, None, name) for name in files],
                      *[("add", None, None, None, name) for name in made]])

    def purge(self) -> int:
        """Empty the folders of files that no longer count; the number of folders emptied.

        What still counts in such a folder is moved to a new one first. Readers that have
        opened the table before must be done.
        """
        log = self.log()
        emptied = log.filter(F.col("kind") == "purge").select("file")
        folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
        dead = log.filter(F.col("kind") == "remove").select(folder.alias("file")).distinct().join(
            emptied, "file", "left_anti")
        folders = sorted(r["file"] for r in dead.collect())
        among = set(folders)
        live = [name for name in self._files() if name.rsplit("/", 1)[0] in among]
        if live:
            self._replace(live, self._scan(live))
        nothing = self.spark.createDataFrame([], FILE_SCHEMA).coalesce(1)
        for name in folders:
            nothing.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        if folders:
            self._commit([("purge", None, None, None, name) for name in folders])
        return len(folders)


def _relative(path: Column) -> Column:
    return F.regexp_extract(path, "segment=[^/]+/.*$", 0)
