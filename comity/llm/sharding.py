"""Operator 9: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at VIRTUAL points of a ring, every document at the point of its hash.
A document belongs to the first shard clockwise. A shard holds a fixed number of rows: as
many as the mean, rounded up for the first shards and down for the others, so that the
whole table just fits; rows that reach a full shard continue clockwise to the next that
has room. Counts then are at most one apart (law ``rows``), and a row moves only if its
shard's room does.

Rows between two ring points form an arc. The walk needs the number of rows of each arc
only: a table of at most shards x VIRTUAL rows, whose size is set by parameters, is
gathered and walked once round; it names the rank ranges of each arc that each shard
takes. Ranks within arcs follow a hash of id and text, so they do not depend on how the
table's files are laid out; rows equal in all that is returned are folded to one with a
count, which stands at as many ranks. An arc is cut into as many buckets, ranges of that hash, as
its own rows need; a rank is the bucket's first plus the place within the bucket.

Defined results: null texts have size 8 (no bytes and the fixed 8); null ids share one
point of the ring and overflow from there like others; repeated rows are rows of their
own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity.llm.common import stored, text_of

SHARDS = 24
VIRTUAL = 64
BUCKET_ROWS = 20_000
CHUNK = 10_000  # copies of a row that one row stands for until the last shuffle
MAX_POINTS = 1 << 20


def point(*columns: Column) -> Column:
    """A place on the ring, from 0 below 2^62."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def order(doc_id: Column, text: Column) -> Column:
    """A row's place among those of its arc, from 0 below 2^63."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), text), 1)


def ring(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes, clockwise."""
    if shards * virtual > MAX_POINTS:
        raise ValueError(f"a ring of {shards * virtual} points is too large to walk at once")
    nodes = spark.range(shards).withColumnRenamed("id", "shard").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    rows = nodes.select(
        point(F.lit("node"), F.col("shard"), F.col("copy")).alias("point"), "shard").collect()
    return sorted((r["point"], r["shard"]) for r in rows)


def walk(
    counts: list[int], owners: list[int], room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): who takes which rows of each arc.

    One walk round the ring serves every arc's own rows, oldest overflow last; a second
    one places what is still carried. The room of all shards together is that of all rows.
    """
    free, slots, carried, taken = list(room), [0] * len(room), [], []
    for lap in range(2):
        for arc, shard in enumerate(owners):
            waiting = ([(arc, 0, counts[arc])] if lap == 0 and counts[arc] else []) + carried
            carried = []
            for home, begin, end in waiting:
                fits = min(free[shard], end - begin)
                if fits:
                    taken.append((home, begin, begin + fits, shard, slots[shard]))
                    free[shard] -= fits
                    slots[shard] += fits
                if begin + fits < end:
                    carried.append((home, begin + fits, end))
    if carried:
        raise ValueError("the shards have no room for all rows")
    return taken


def arc_of(spark_point: Column, nodes: list[tuple[int, int]]) -> Column:
    """The arc a point lies in: the number of the first node clockwise.

    A table of the ring's points, bounded by MAX_POINTS, is cut by the point's leading
    bits; the few nodes of a cut are compared.
    """
    points = [p for p, _ in nodes]
    bits = max(1, len(points).bit_length())
    firsts, cuts = [], 1 << bits
    for c in range(cuts):
        low = bisect.bisect_left(points, c << (62 - bits))
        high = bisect.bisect_left(points, (c + 1) << (62 - bits))
        firsts.append((low, points[low:high]))
    table = F.from_json(
        F.lit(json.dumps([{"n": n, "p": p} for n, p in firsts])),
        "array<struct<n:int,p:array<bigint>>>")
    cut = F.get(table, F.shiftright(spark_point, 62 - bits).cast("int"))
    arc = cut["n"] + F.size(F.filter(cut["p"], lambda p: p < spark_point))
    return F.when(arc >= len(points), 0).otherwise(arc).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    ``slot`` numbers a shard's rows from 0 without gaps. ``grown_shard`` is null: how much
    room a shard has depends on all rows, so this is no law of the key alone.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, virtual)
    text = text_of(docs)
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        order(docs["doc_id"], text).alias("_order"),
        arc_of(point(F.col("doc_id").cast("string")), nodes).alias("_arc"),
    )
    # A row that is repeated by a third of the table folds before the shuffle.
    alike = ["_order", "doc_id", "size", "text_crc32"]
    folded = stored(keyed.groupBy("_arc", *alike).agg(F.count(F.lit(1)).alias("_n")), "shard-keys")
    found = {r["_arc"]: r["n"]
             for r in folded.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(nodes))]
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    ranges = walk(counts, [s for _, s in nodes], room)

    by_arc: dict[int, list] = {}
    for arc, begin, end, shard, slot in ranges:
        by_arc.setdefault(arc, []).append({"b": begin, "e": end, "s": shard, "t": slot})
    taken = F.from_json(
        F.lit(json.dumps([{"a": a, "r": r} for a, r in by_arc.items()])),
        "array<struct<a:int,r:array<struct<b:bigint,e:bigint,s:int,t:bigint>>>>")
    arcs = spark.range(1).select(F.inline(taken).alias("_a", "_ranges"))
    buckets = F.get(
        F.from_json(F.lit(json.dumps([n // BUCKET_ROWS + 1 for n in counts])), "array<bigint>"),
        F.col("_arc"))
    placed = folded.withColumn(
        "_bucket", F.shiftright(F.shiftright("_order", 31) * buckets, 32).cast("int"))
    filled = placed.groupBy("_arc", "_bucket").agg(F.sum("_n").alias("_rows"))
    ahead = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = filled.select("_arc", "_bucket",
                          F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_base"))
    bases = bases.join(F.broadcast(arcs), F.col("_arc") == F.col("_a")).drop("_a")
    inside = Window.partitionBy("_arc", "_bucket").orderBy(*alike).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        bases, ["_arc", "_bucket"])
    first = F.col("_base") + F.col("_in")
    last = first + F.col("_n")
    # The ranks of equal rows may lie in several ranges, and be many.
    parts = F.transform(
        F.filter("_ranges", lambda r: (r["b"] < last) & (first < r["e"])),
        lambda r: F.struct(
            r["s"].alias("shard"), (r["t"] + F.greatest(first, r["b"]) - r["b"]).alias("slot"),
            (F.least(last, r["e"]) - F.greatest(first, r["b"])).alias("many")))
    pieces = ranked.select("doc_id", "size", "text_crc32", F.inline(parts)).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(CHUNK).cast("long")))
        .alias("_from"))
    pieces = pieces.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("_from")).alias("slot"),
        F.least(F.lit(CHUNK), F.col("many") - F.col("_from")).alias("many"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("many") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
