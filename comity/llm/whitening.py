"""Operator 13: whitening of embeddings, with exact cross-products from bit planes.

Entries become integers x = floor(64 * c) + 1000000. Their covariance is made without any
rounding:

1. One pass finds count, least and greatest x of each dimension. Shifted by the least,
   every dimension needs only as many bits as its range.
2. In the second pass each task packs the bit planes of its rows, 64 rows to a word. The
   cross-product of two dimensions is the sum over pairs of planes of 2^(a + b) times the
   number of rows that have both bits: an AND and a count of bits over words.
3. The sums of the tasks are added up in Spark. On the driver d x d integers (d dimensions)
   are centred as integers, n * sum(xy) - sum(x) * sum(y), and only then divided and given to
   ``eigh``.

A third pass projects every row, from n * x - S, which is exact; a fourth measures how far
the covariance of the result is from the identity.

Memory: a task holds CHUNK rows and d x d sums, the driver d x d sums, whatever the rows.

Defined results: null vectors and those with null, NaN or infinite entries, or entries of 2^50
or more, are left out of fit and result; so are vectors whose length is not the commonest
one (ties: the longest). Repeated or null ids keep a row each; other columns are ignored.
Directions without variance (an eigenvalue of nothing beside the greatest) cannot be scaled:
``whitened`` is null there, and ``explained`` 0; with one vector, or only equal ones, that is
all of them, and ``identity_error`` is null. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from comity.llm.common import bounded_batches, stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
CHUNK = 1 << 14
GREATEST = 2.0 ** 50
SAFE = 1 << 62


def usable(vector: Column) -> Column:
    """Vectors without a null, NaN, infinite or too large entry."""
    return F.coalesce(F.forall(
        vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < GREATEST)), F.lit(False))


def integers(vectors: pa.Array, size: int, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return (np.floor(scale * flat) + offset).astype(np.int64).reshape(-1, size)


def packed_planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bit planes of every dimension in turn, 64 rows to a word: planes x words."""
    rows = -len(shifted) % 64 + len(shifted)
    planes = np.zeros((sum(bits), rows), np.uint8)
    at = 0
    for dimension, count in enumerate(bits):
        for bit in range(count):
            planes[at, :len(shifted)] = (shifted[:, dimension] >> bit) & 1
            at += 1
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


def cross_products(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums over rows of the products of all pairs of dimensions, as exact Python integers
    where int64 might not hold them."""
    planes = packed_planes(shifted, bits)
    starts = np.concatenate([[0], np.cumsum(bits)])
    both = np.zeros((len(planes), len(planes)), np.int64)
    step = max(1, (1 << 21) // max(1, planes.size))
    for i in range(0, len(planes), step):
        some = planes[i:i + step]
        both[i:i + step, i:] = np.bitwise_count(
            some[:, None, :] & planes[None, i:, :]).sum(axis=2, dtype=np.int64)
    both = np.triu(both)
    both += np.triu(both, 1).T
    wide = 2 * max(bits, default=0) + len(shifted).bit_length() + 1 > 62
    kind = object if wide else np.int64
    weight = np.array([1 << b for count in bits for b in range(count)], kind)
    some = np.flatnonzero(bits)
    out = np.zeros((len(bits), len(bits)), kind)
    if len(some):
        weighted = both.astype(kind) * weight[:, None] * weight
        weighted = np.add.reduceat(weighted, starts[some], axis=0)
        out[np.ix_(some, some)] = np.add.reduceat(weighted, starts[some], axis=1)
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit holds: everything is of the size of one vector, or its square."""

    n: int
    sums: list[int]
    least: list[int]
    greatest: list[int]
    vectors: np.ndarray  # dimensions x components, unit length
    values: np.ndarray  # falling; 0 for a direction without variance
    explained: np.ndarray

    @property
    def size(self) -> int:
        return len(self.sums)


def ranges(rows: DataFrame, scale: int, offset: int) -> tuple[int, list, list]:
    """Number of vectors of the commonest length, and the range of x in each dimension."""
    longs = pa.list_(pa.int64())

    def work(batches):
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes):
                x = integers(column.filter(pa.array(sizes == size)), max(1, size), scale, offset)
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([size], pa.int32()),
                    "n": pa.array([int((sizes == size).sum())], pa.int64()),
                    "least": pa.array([x.min(0).tolist() if size else []], longs),
                    "greatest": pa.array([x.max(0).tolist() if size else []], longs)})

    parts = stored(
        rows.mapInArrow(work, "size int, n long, least array<long>, greatest array<long>"),
        "ranges")
    common = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), F.desc("size")).first()
    if common is None or not common["size"]:
        return 0, [], []
    # An entry for each dimension of the commonest length comes to the driver.
    found = (
        parts.filter(F.col("size") == common["size"])
        .select(F.posexplode(F.arrays_zip("least", "greatest")).alias("at", "x"))
        .groupBy("at").agg(F.min("x.least").alias("low"), F.max("x.greatest").alias("high"))
        .orderBy("at").collect())
    return common["n"], [r["low"] for r in found], [r["high"] for r in found]


def fit(
    vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, offset: int = OFFSET,
) -> Whitening:
    """Exact sums and covariance of all usable vectors, and its greatest eigenvectors."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vector)).filter(usable(F.col(vector)))
    n, least, greatest = ranges(rows, scale, offset)
    size = len(least)
    if not n:
        none = np.empty(0)
        return Whitening(0, [], [], [], np.empty((0, 0)), none, none)
    bits = [(high - low).bit_length() for low, high in zip(least, greatest)]
    shift = np.array(least, np.int64)
    upper = np.triu_indices(size)

    def work(batches):
        total, sums = np.zeros((size, size), object), np.zeros(size, object)
        seen = 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                x = integers(batch.column(0).slice(start, CHUNK), size, scale, offset) - shift
                total = total + cross_products(x, bits)
                sums = sums + x.sum(0, dtype=object)
                seen += len(x)
        if seen:
            values = [*total[upper].tolist(), *sums.tolist()]
            # Parts of 48 bits: a product has 113 bits at most, their sums fit a decimal.
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(np.arange(len(values)), pa.int32()),
                "high": pa.array([v >> 96 for v in values], pa.int64()),
                "middle": pa.array([v >> 48 & (1 << 48) - 1 for v in values], pa.int64()),
                "low": pa.array([v & (1 << 48) - 1 for v in values], pa.int64())})

    wide = T.DecimalType(38, 0)
    added = (
        rows.filter(F.size(vector) == size)
        .mapInArrow(work, "at int, high long, middle long, low long").groupBy("at")
        .agg(*[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "middle", "low")])
        .orderBy("at").collect())
    values = [(int(r["high"]) << 96) + (int(r["middle"]) << 48) + int(r["low"]) for r in added]
    shifted = values[len(upper[0]):]
    # Centred as integers: n^2 times the covariance.
    centred = np.zeros((size, size), object)
    for i, j, cross in zip(*upper, values):
        centred[i, j] = centred[j, i] = n * cross - shifted[i] * shifted[j]
    covariance = np.array([[c / (n * n) for c in row] for row in centred], float)
    found, directions = np.linalg.eigh(covariance)
    order = np.argsort(-found, kind="stable")[:components]
    found, directions = found[order], directions[:, order]
    trace = Fraction(int(sum(centred[i, i] for i in range(size))), n * n)
    flat = found <= size * np.finfo(float).eps * max(found.max(initial=0), 0)
    found = np.where(flat, 0.0, found)
    # One sign for all rows: the greatest entry is positive.
    top = np.argmax(np.abs(directions), axis=0)
    directions = directions * np.where(directions[top, np.arange(len(order))] < 0, -1.0, 1.0)
    explained = found / float(trace) if trace else np.zeros(len(found))
    sums = [s + n * low for s, low in zip(shifted, least)]
    return Whitening(n, sums, least, greatest, directions, found, explained)


def project(
    vectors: DataFrame, model: Whitening, ids: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """``ids``, ``deviation`` and ``whitened``, an array by component, of each usable vector."""
    n, size = model.n, max(1, model.size)
    sums = np.array(model.sums, object)
    # The greatest |x| of the fit decides whether n * x fits 64 bits; a deviation may not.
    reach = max([abs(x) for x in (*model.least, *model.greatest)], default=0)
    kind = np.int64 if 2 * max(1, n) * reach < SAFE else object
    deviations = np.where(model.values > 0, np.sqrt(model.values), np.nan)
    basis = model.vectors / deviations if n else model.vectors

    def work(batches):
        for batch in batches:
            x = integers(batch.column(vector), size, scale, offset)
            off = x.astype(kind) * n - sums.astype(kind)
            # Beyond a long the sum is lost; what may be near it is added up exactly.
            about = (off.astype(float) ** 2).sum(1)
            deviation = np.zeros(len(x), np.int64)
            if about.max(initial=0) < SAFE:
                deviation = (off * off).sum(1).astype(np.int64)
                lost = np.zeros(len(x), bool)
            else:
                lost = about > 2.0 ** 64
                for i in np.flatnonzero(~lost):
                    exact = sum(o * o for o in map(int, off[i]))
                    lost[i] = exact >= 1 << 63
                    deviation[i] = 0 if lost[i] else exact
            white = off.astype(float) / n @ basis
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(ids), pa.array(deviation, pa.int64(), mask=lost),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()),
                    pa.array(flat, mask=np.isnan(flat)))], schema=arrow_schema)

    rows = vectors.select(F.col(ids), F.col(vector))
    schema = T.StructType([
        rows.schema[ids], T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    arrow_schema = to_arrow_schema(schema)
    return rows.filter(usable(F.col(vector)) & (F.size(vector) == model.size)).filter(
        F.lit(n > 0)).mapInArrow(work, schema)


def identity_error(projected: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over
    the components that have variance; each task's products are centred on its own mean."""
    def work(batches):
        n, mean, cross = 0, None, None
        for batch in batches:
            column = batch.column(0)
            white = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            if not len(white):
                continue
            centre = white.mean(0)
            own = (white - centre).T @ (white - centre)
            if n:
                step = centre - mean
                own += cross + np.outer(step, step) * (n * len(white) / (n + len(white)))
                centre = mean + step * (len(white) / (n + len(white)))
            n, mean, cross = n + len(white), centre, own
        if n:
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n], pa.int64()), "mean": [mean.tolist()],
                "cross": [cross.ravel().tolist()]})

    parts = projected.select("whitened").mapInArrow(
        work, "n long, mean array<double>, cross array<double>")
    # Sums of n, of means and of products around zero; rows of a task: components squared.
    entries = parts.select(
        "n", "mean", F.posexplode("cross").alias("at", "c"),
    ).select("at", "n", F.col("c").alias("own"),
             F.get("mean", F.floor(F.col("at") / components).cast("int")).alias("a"),
             F.get("mean", F.col("at") % components).alias("b"))
    added = entries.groupBy("at").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("own") + F.col("n") * F.col("a") * F.col("b")).alias("cross"),
        F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"))
    one = F.when(F.floor(F.col("at") / components) == F.col("at") % components, 1.0).otherwise(0.0)
    value = F.col("cross") / F.col("n") - (F.col("a") / F.col("n")) * (F.col("b") / F.col("n"))
    return added.agg(F.max(F.abs(F.nanvl(value - one, F.lit(None).cast("double"))))).first()[0]


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, ids: str = "vec_id",
    vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """One row for each usable vector and component: ids, component, n, deviation, whitened,
    explained and identity_error."""
    model = fit(vectors, vector, components, scale, offset)
    projected = project(vectors, model, ids, vector, scale, offset)
    count = len(model.values)
    error = identity_error(projected, count) if count else None
    explained = F.array(*[F.lit(float(e)) for e in model.explained], F.lit(0.0))
    return projected.select(
        ids, "deviation", F.posexplode("whitened").alias("_at", "_white")
    ).select(
        ids, (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", F.col("_white").alias("whitened"),
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
