"""A trigram index over the prediction history, for searching texts without a full scan.

The index holds a row (trigram, id) for every distinct run of three characters of a row's
lower-case text, in ranges of (trigram, id): a trigram that a third of all rows hold lies in
many files, and a search opens only the row groups of the few trigrams it asks for. Counts
per trigram, summed as the index grows, tell which trigrams of a needle are the rarest.

A search takes the rows that hold the ``RAREST`` rarest trigrams of the needle, and verifies
each on its text. Needles without a trigram, and rows of runs that are not in the index yet,
are scanned. So the rows found are those of ``history.search``, whatever the needle.

The index follows a ``HistoryTable``: ``update`` takes in the runs added since. Erased rows
are not found any more, as rows come from the table itself; ``rebuild`` also takes their
trigrams out of the index. Its log is written as the table's: one file for each change.
One job at a time may change the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.functions.text import or_empty
from comity.operators import history as listings
from comity.sources.history_table import ROW_BITS, HistoryTable, read_or_empty

#: Trigrams of a needle that are looked up; rarer ones first.
RAREST = 4
#: Candidates that a search broadcasts at most; beyond, the optimizer chooses.
FEW = 100_000
#: Candidates whose ids a search reads to skip row groups of the history, and the ranges made.
FEWEST, SPANS = 1000, 32
LOG_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("segment", T.StringType()),
    T.StructField("number", T.LongType()),
])
POSTING_SCHEMA = T.StructType([
    T.StructField("trigram", T.StringType()), T.StructField("id", T.LongType())])
COUNT_SCHEMA = T.StructType([
    T.StructField("trigram", T.StringType()), T.StructField("rows", T.LongType())])


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, line breaks too."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


class SearchIndex:
    def __init__(self, history: HistoryTable, path: str):
        self.history, self.path = history, path.rstrip("/")
        self.spark: SparkSession = history.spark

    # --- the log ---

    def _log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/log", LOG_SCHEMA)

    def _state(self) -> tuple[int, list[str], list[int]]:
        """The version, its segments, and the numbers of the runs they cover.

        One row for each run of the history, which its own log holds as well.
        """
        log = self._log()
        version = log.agg(F.max("version")).first()[0] or 0
        rows = log.filter(F.col("version") == version).select("segment", "number").collect()
        return (version, sorted({r["segment"] for r in rows}),
                sorted({r["number"] for r in rows if r["number"] is not None}))

    def _commit(self, version: int, segment: str, numbers: list[int]) -> None:
        entries = [(version, segment, n) for n in numbers] or [(version, segment, None)]
        self.spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/log")

    def _runs(self) -> list[int]:
        return sorted(r["number"] for r in self.history.runs().select("number").collect())

    # --- building ---

    def _write(self, rows: DataFrame) -> str:
        segment = uuid.uuid4().hex
        postings = rows.select(
            F.explode(trigrams(or_empty("input_text"))).alias("trigram"), "id")
        # Both keys cut the ranges, so a frequent trigram is spread over many of them.
        postings.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id").write.parquet(
            f"{self.path}/postings/{segment}")
        self._postings([segment]).groupBy("trigram").agg(
            F.count("*").alias("rows")
        ).repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(
            f"{self.path}/counts/{segment}")
        return segment

    def _postings(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(POSTING_SCHEMA).parquet(
            *[f"{self.path}/postings/{s}" for s in segments])

    def _counts(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(COUNT_SCHEMA).parquet(
            *[f"{self.path}/counts/{s}" for s in segments])

    def update(self) -> list[int]:
        """Take in the runs that were added since; their numbers."""
        version, _, covered = self._state()
        new = sorted(set(self._runs()) - set(covered))
        if new:
            segment = self._write(self.history.read().filter(of_runs(new)))
            self._commit(max(version, 1), segment, new)
        return new

    def rebuild(self) -> None:
        """Index all rows anew, as one segment; folders of the old ones are emptied.

        Searches that have begun before must be done.
        """
        version, _, _ = self._state()
        runs = self._runs()
        # Of all versions: an earlier rebuild may have been cut short before it emptied its own.
        old = [r["segment"] for r in self._log().select("segment").distinct().collect()]
        segment = self._write(self.history.read().filter(of_runs(runs)))
        self._commit(version + 1, segment, runs)
        for name in old:
            for kind, schema in (("postings", POSTING_SCHEMA), ("counts", COUNT_SCHEMA)):
                self.spark.createDataFrame([], schema).coalesce(1).write.mode(
                    "overwrite").parquet(f"{self.path}/{kind}/{name}")

    # --- searching ---

    def candidates(self, text: str) -> tuple[DataFrame, int] | None:
        """Ids of rows that hold the rarest trigrams of ``text``, and a bound of their number.

        None where the text has no trigram, or nothing is indexed yet: all rows may hold it.
        """
        _, segments, _ = self._state()
        # A needle's trigrams are as few as its characters.
        wanted = [r[0] for r in self.spark.range(1).select(
            F.explode(trigrams(F.lit(text)))).collect()]
        if not wanted or not segments:
            return None
        known = {r["trigram"]: r["rows"] for r in self._counts(segments).filter(
            F.col("trigram").isin(wanted)).groupBy("trigram").agg(
                F.sum("rows").alias("rows")).collect()}
        rarest = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:RAREST]
        held = self._postings(segments).filter(F.col("trigram").isin(rarest))
        # A segment holds a pair once, and the segments have different rows.
        ids = held.groupBy("id").agg(F.count("*").alias("_n")).filter(
            F.col("_n") == len(rarest)).select("id")
        return ids, known.get(rarest[0], 0)

    def search(
        self, text: str | None = None, prediction: str | None = None, source: str | None = None
    ) -> DataFrame:
        """Rows that meet all given filters, as ``operators.history.search`` gives them."""
        rows = self.history.read()
        found = self.candidates(text) if text else None
        if found is None:
            return listings.search(rows, text, prediction, source)
        ids, bound = found
        _, _, covered = self._state()
        indexed = rows.filter(of_runs(covered))
        if bound <= FEWEST:
            indexed = indexed.filter(_within(ranges(sorted(r["id"] for r in ids.collect()))))
        if bound <= FEW:
            ids = F.broadcast(ids)
        indexed = indexed.join(ids, "id", "left_semi")
        new = sorted(set(self._runs()) - set(covered))
        if new:
            indexed = indexed.unionByName(rows.filter(of_runs(new)))
        return listings.search(indexed, text, prediction, source)


def _within(spans: list[tuple[int, int]]) -> Column:
    """Ids of these ranges, ends included, as Parquet's minima and maxima can skip by."""
    out = F.lit(False)
    for low, high in spans:
        out = out | F.col("id").between(low, high)
    return out


def of_runs(numbers: list[int]) -> Column:
    """Rows of these runs; runs that follow each other are one range."""
    spans: list[list[int]] = []
    for n in sorted(numbers):
        if spans and spans[-1][1] + 1 == n:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return _within([(low << ROW_BITS, ((high + 1) << ROW_BITS) - 1) for low, high in spans])


def ranges(ids: list[int]) -> list[tuple[int, int]]:
    """At most SPANS ranges that hold all of the sorted ``ids``, cut at the largest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[:SPANS - 1]
    starts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(starts, starts[1:]) if a < b]
