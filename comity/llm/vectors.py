"""Operator 4: near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions. Close vectors stay close on every
line: at cosine c two of them differ by a normal variable of deviation sqrt(2 - 2c). Pairs
are sought and tested in three steps.

1. Lines are sorted in TABLES groups of LINES: the cells of a group's lines, all together,
   name the runs of neighbours whose pairs are looked at. Expected recall of a pair at the
   threshold is 1 - (1 - p)^TABLES, p = (1 - E|difference| / CELL)^LINES (``expected_recall``).
2. For each pair of a run, query by query, the collisions are counted: of COUNTED further
   lines, how many hold both within a window of one deviation centred on the query. At the
   threshold the count is binomial; pairs below the count that MISSED of them would miss are
   dropped.
3. The cosine of the rest is computed in double precision.

Equal vectors are folded to one class first, with the number of its rows; so thousands of
copies are one vector, and all pairs below are of classes.

A pair that meets in several tables is handled in the first of them, so links are counted,
never listed. Runs over RUN vectors are cut into slices, and each pair of slices is a task
of its own, so no task grows with a run. Only a spanning forest of each task's links leaves
it, with counts per vector.

Defined results: vectors that are null, zero, or hold null or non-finite components have no
links and are their own component; vectors of another length link among their like only;
equal vectors link (cosine 1). Rows with repeated ids are vectors of their own, and each counts
in the links of the others. A null vec_id counts as a link and names no component but where
all of a component's ids are null; ids are of any ordered type. Other columns are ignored.
Classes are told apart by 128 bits of a hash of their vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.llm.common import bounded_batches, in_runs, slice_pairs, stored
from comity.llm.components import components, forest

THRESHOLD = 0.9
TABLES = 32
LINES = 8
CELL = 1.5
COUNTED = 64
MISSED = 0.0005
RUN = 512
SEED = 11


def expected_recall(cosine: float, tables: int = TABLES, lines: int = LINES) -> float:
    """Chance that a pair at ``cosine`` shares a cell in at least one table."""
    spread = math.sqrt(max(0.0, 2 - 2 * cosine))
    draws = np.abs(np.random.default_rng(0).normal(0, spread, 100_000))
    p = float(np.mean(np.maximum(0, 1 - draws / CELL))) ** lines
    return 1 - (1 - p) ** tables


def least_count(counted: int = COUNTED, missed: float = MISSED) -> int:
    """Collisions that all but ``missed`` of the pairs at the threshold have."""
    p = math.erf(1 / math.sqrt(2))  # within one deviation
    total, k = 0.0, -1
    while total <= missed:
        k += 1
        total += math.comb(counted, k) * p ** k * (1 - p) ** (counted - k)
    return k


def directions(size: int, count: int, part: int) -> np.ndarray:
    return np.random.default_rng([SEED, part, size]).normal(size=(size, count))


def units(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors by length, and those vectors scaled to length one."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        values = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
        with np.errstate(all="ignore"):
            top = np.max(np.abs(values), axis=1)
            scaled = values / top[:, None]
            scaled = scaled / np.sqrt((scaled ** 2).sum(1))[:, None]
        good = np.isfinite(top) & (top > 0) & np.isfinite(scaled).all(1)
        if good.any():
            out.append((rows[good], scaled[good]))
    return out


def cells_of(unit: np.ndarray, tables: int) -> np.ndarray:
    """The cell of each vector in each table, mixed to 64 bits."""
    size = unit.shape[1]
    shift = np.random.default_rng([SEED, 1]).uniform(0, CELL, tables * LINES)
    places = np.floor((unit @ directions(size, tables * LINES, 0) + shift) / CELL).astype(np.int64)
    places = places.reshape(len(unit), tables, LINES).astype(np.uint64)
    mixed = np.full((len(unit), tables), size, np.uint64)
    for line in range(LINES):
        mixed = (mixed ^ places[:, :, line]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def celled(batches):
    """Usable vectors as they came, with the low half of their cells in all tables."""
    for batch in batches:
        for rows, unit in units(batch.column("embedding")):
            cells = cells_of(unit, TABLES).astype(np.int32)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(rows), batch.column("embedding").take(rows),
                 batch.column("weight").take(rows), pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), TABLES)
                 .cast(pa.list_(pa.int32()))],
                ["cid", "embedding", "weight", "cells"])


def linked(threshold: float, needed: int):
    """Links within the slices of runs, or between two slices of a run: for each class
    the rows of the classes it is linked with, and edges that join all that are linked."""
    reach = math.sqrt(2 - 2 * threshold)

    def links(columns: dict, cuts: np.ndarray) -> pa.Table:
        ids, weights = columns["cid"].to_numpy(), columns["weight"].to_numpy()
        tables, side, left, right = (
            columns[c].to_numpy() for c in ("table", "slice", "left", "right"))
        cells = columns["cells"].flatten().to_numpy().reshape(len(ids), -1)
        counts = np.zeros(len(ids), np.int64)
        edges = []
        for rows, unit in units(columns["embedding"]):
            window = unit @ directions(unit.shape[1], COUNTED, 2)
            at = np.searchsorted(rows, cuts)
            for lo, hi in zip(at, at[1:]):
                if hi - lo < 2:
                    continue
                r = rows[lo:hi]
                table, mine, other = tables[r[0]], left[r[0]], right[r[0]]
                a = lo + np.flatnonzero(side[r] == mine)
                b = lo + np.flatnonzero(side[r] == other)
                found = []
                step = max(1, (1 << 16) // max(1, len(b)))
                for i in range(0, len(a), step):
                    # Query by query: further lines that hold both within the window.
                    q = a[i:i + step]
                    hits = np.zeros((len(q), len(b)), np.uint8)
                    for line in range(COUNTED):
                        hits += np.abs(window[q, line][:, None] - window[b, line]) <= reach
                    good = hits >= needed
                    if mine == other:
                        good &= q[:, None] < b
                    if not good.any():
                        continue
                    x, y = np.nonzero(good)
                    x, y = q[x], b[y]
                    if table:  # pairs that met in a table before are done
                        new = np.ones(len(x), bool)
                        for t in range(table):
                            new &= cells[rows[x], t] != cells[rows[y], t]
                        x, y = x[new], y[new]
                    close = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    found.append((rows[x[close]], rows[y[close]]))
                if found:
                    x, y = (np.concatenate(f) for f in zip(*found))
                    np.add.at(counts, x, weights[y])
                    np.add.at(counts, y, weights[x])
                    edges += forest(x, y)
        some = np.flatnonzero(counts)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "cid": pa.array(np.concatenate([ids[some], ids[ends[:, 0]]]), pa.int64()),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(ends), np.int64)])),
            "b": pa.array(np.concatenate([ids[some], ids[ends[:, 1]]]), pa.int64(),
                          mask=np.arange(len(some) + len(ends)) < len(some)),
        })

    return links


def usable(vector: Column) -> Column:
    """Vectors that have a direction: all components finite, and one that is not zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def vector_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows as vec_id and hash, and one stored row for each distinct vector.

    A class has a number ``cid``, its ``weight`` in rows, and the least id of them.
    """
    good = rows.filter(usable(F.col("embedding")))
    keys = {"_h1": F.xxhash64("embedding"), "_h2": F.xxhash64(F.lit(SEED), "embedding")}
    good = good.withColumns(keys)
    classes = good.groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"),
        F.first("embedding").alias("embedding"),
    ).withColumn("cid", F.monotonically_increasing_id())
    return good.select("vec_id", "_h1", "_h2"), stored(classes, "vector-classes")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding")
    hashed, classes = vector_classes(rows)
    placed = stored(
        classes.select("cid", "embedding", "weight").mapInArrow(celled, T.StructType([
            T.StructField("cid", T.LongType()), rows.schema["embedding"],
            T.StructField("weight", T.LongType()),
            T.StructField("cells", T.ArrayType(T.IntegerType()))])),
        "vectors")
    entries = placed.select("cid", F.posexplode("cells").alias("table", "cell"))
    runs = entries.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("size")).filter(
        F.col("size") > 1)
    met = slice_pairs(entries.join(runs, ["table", "cell"]), "cid", "size", RUN).drop("size")
    keys = ["table", "cell", "left", "right"]
    found = stored(
        in_runs(met.join(placed, "cid"), keys, linked(threshold, least_count()),
                "cid long, n long, b long"),
        "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(
        found.filter(F.col("b").isNotNull()).select(F.col("cid").alias("a"), "b"))
    named = (
        classes.select("cid", "weight", "least", "_h1", "_h2")
        .join(counts, "cid", "left")
        .join(groups, F.col("cid") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = named.join(least, "component").select(
        "_h1", "_h2", "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # Rows that cannot link have no class and come without a look-up.
    useless = rows.filter(~usable(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked_rows = hashed.join(resolved, ["_h1", "_h2"]).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked_rows.unionByName(useless).select(
        "*", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
