"""Connected components of an edge table, by alternating stars.

Each round points every node's larger neighbours at its smallest one (large star), then
every node and its smaller neighbours at the smallest of them (small star). Edges stay
about as many as they were, no neighbourhood is gathered, and rounds grow with the logarithm
of the longest chain. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comity.llm.common import stored


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges (x[i], y[i]) that join all that the whole list joins, without circles."""
    roots: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := roots.get(i, i)) != i:
            roots[i] = roots.get(up, up)
            i = up
        return i

    edges = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = root(i), root(j)
        if a != b:
            roots[a] = b
            edges.append((i, j))
    return edges


def merge(part: np.ndarray, i: int, rows: np.ndarray) -> None:
    """Make row ``i`` and ``rows`` one part; ``part`` has a number for each row."""
    others = part[rows]
    if (others != part[i]).any():
        part[np.isin(part, others)] = part[i]


def stars(part: np.ndarray, side: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x[i], y[i]) that join the rows of each part, at most one of them from each row.

    Rows of one side go to the least of them by rank, and that one to that of the first side. So
    a slice says the same of its rows whichever slice it meets: a family of m rows in k slices
    has some m + k * k different edges, not m * k.
    """
    order = np.lexsort((rank, side, part))
    parts, sides = part[order], side[order]
    first = np.ones(len(order), bool)
    first[1:] = parts[1:] != parts[:-1]
    head = first.copy()
    head[1:] |= sides[1:] != sides[:-1]
    of_side = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    of_part = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = head & ~first
    return (np.concatenate([order[~head], order[other]]),
            np.concatenate([of_side[~head], of_part[other]]))


def with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the least neighbour ``b`` of each ``a``.

    Neighbours of a node are dealt to as many parts as a shuffle has; the least of each part,
    then of all parts, goes back to the parts. So the edges of a hub are never in one task.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    some = dealt.groupBy("a", "_part").agg(F.min("b").alias("_own"))
    least = some.groupBy("a").agg(F.min("_own").alias("m"))
    # m is the smaller one anyhow; with _own both readings of ``some`` share a shuffle.
    known = some.join(least, "a").select("a", "_part", F.least("m", "_own").alias("m"))
    return dealt.join(known, ["a", "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all ends of ``edges`` (a, b).

    Loops are ignored; nodes of any ordered type.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b")).distinct(),
        "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large)
        now = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(),
            "edges")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        tops.join(now, tops["node"] == now["a"], "left_anti").select(
            "node", F.col("node").alias("component")))
