"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comity.workspace import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by place, which clash with no name of an operator; and
    those names. ``original`` turns back."""
    names = [f"_{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def original(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``renamed`` made of ``docs``, under their own names."""
    return df.select(*[F.col(f"_{i}_").alias(c) for i, c in enumerate(docs.columns)])


def at(docs: DataFrame, column: str) -> Column:
    """A column of ``docs`` as ``renamed`` names it."""
    return F.col(f"_{docs.columns.index(column)}_")


def row_hash(docs: DataFrame, names: list[str]) -> Column:
    """128 bits of a row, of all its columns that can be hashed."""
    hashed = [n for n, f in zip(names, docs.schema) if "map<" not in f.dataType.simpleString()]
    return F.struct(F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Whatever reads it several times sees the same rows, and a lost executor costs a
    read, not the work that made them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, for long texts; a limit the user has set stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == "67108864b":  # Spark's own default
        spark.conf.set(setting, "4m")


def in_runs(df: DataFrame, keys: list[str], work, schema) -> DataFrame:
    """``work`` on every run of rows with equal ``keys``, many runs to a task.

    ``work(columns, cuts)`` gets whole runs as Arrow columns by name, run i from cuts[i] to
    cuts[i + 1], and returns an Arrow table. The shuffle sorts, so a task holds one run and
    the batch it reads; runs must be bounded.
    """
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            change = np.zeros(table.num_rows, bool)
            for key in keys:
                column = table.column(key)
                change[1:] |= pc.fill_null(
                    pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)), True
                ).to_numpy()
            cuts = np.flatnonzero(change)
            if not len(cuts):
                held = table.to_batches()
                continue
            whole = table.slice(0, cuts[-1])
            held = table.slice(cuts[-1]).to_batches()
            yield from work(_columns(whole), np.concatenate([[0], cuts])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from work(_columns(table), np.array([0, table.num_rows])).to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tasks, schema)


def _columns(table: pa.Table) -> dict[str, pa.Array]:
    table = table.combine_chunks()
    return {name: table.column(name).chunk(0) if table.num_rows else pa.array([])
            for name in table.column_names}


def slice_pairs(df: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows with ``slice``, once for each pair of slices (left, right) of their group.

    A group of ``size`` rows has size / most slices, dealt by ``key``; every two of them,
    and each alone, are a pair, so every two rows of a group meet exactly once.
    """
    of = F.ceil(F.col(size) / most).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_of") - 1),
        lambda s: F.struct(F.least("slice", s).alias("left"), F.greatest("slice", s).alias("right")))
    return (
        df.withColumn("_of", of)
        .withColumn("slice", F.pmod(F.xxhash64(key), F.col("_of")).cast("int"))
        .withColumn("_p", F.explode(pairs))
        .select("*", "_p.left", "_p.right").drop("_p", "_of")
    )
