"""Operator 2: mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words, its documents in seeded order, are cut into blocks of BLOCK_WORDS. The
mix has as many blocks as the corpus has. They go to sources one by one by the highest
quotient target / (2k - 1), k the source's next block, and each shard of the mix takes the
next run of them; so shard quotas are whole numbers, and every run of shards from the first
keeps the targets' proportions. Seeded selection then picks each source's blocks: all of
them as often as its quota holds them all, and the rest from a seeded block on, round the
end to the start. As the documents stand in seeded order, that is a random part of them,
and but for the two at its ends they are taken whole.

Nothing is sorted as a whole. Quotas come from the table of sources, one row each, where a
divisor bounds the blocks of every source to within a few: two rows a source and shard at
most are ranked. Places of documents in a source are running sums over buckets of the
seeded order, summed first, so a source with a third of all rows is many buckets.

Defined results: null texts have size 0 and are never taken; null sources are a source of
their own, the last; null or repeated document ids count row by row; an empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity.llm.common import at, original, renamed, row_hash, stored, text_of

BLOCK_WORDS = 64
SHARDS = 24
MOST = 3  # times a document may be taken
SEED = "mix"
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words, and the seeded order as hex digits."""
    return docs.select(
        "doc_id", "source", *keep,
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
        # The text's digest spreads rows that share an id or have none.
        F.md5(F.concat_ws("/", F.lit(SEED), F.col("doc_id").cast("string"),
                          F.md5(text_of(docs)))).alias("_order"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> with rank, weight and target words.

    Weights 1, 2, 3 repeat along the sources by code point, null last. Shares of the total
    stop at MOST times the source; the excess goes to the others by weight. A source stops
    if its limit per unit of weight is below the level of those that don't; taking sources
    by that ratio, the level is what is left over the weight that is left. These windows
    hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ranked = ranked.withColumn("_ratio", F.lit(MOST) * F.col("source_size") / F.col("weight"))
    onward = Window.orderBy("_ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(
        Window.orderBy("_ratio", "rank").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumns({
        "_total": total,
        "_left": total - F.coalesce(
            F.sum(F.lit(MOST) * F.col("source_size")).over(before), F.lit(0)),
        "_weight_left": F.sum("weight").over(onward),
    })
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_weight_left"))
    free = F.col("_ratio") >= F.col("_level")
    # The first source that doesn't stop sets the level for all that follow.
    level = F.min(F.when(free, F.struct("_ratio", "rank", "_level"))).over(
        Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(
        "source", "source_size", "rank", "weight", F.col("_total").alias("total"),
        F.coalesce(
            F.least(level["_level"] * F.col("weight"),
                    (F.lit(MOST) * F.col("source_size")).cast("double")),
            (F.lit(MOST) * F.col("source_size")).cast("double"),
        ).alias("target"),
    )


def shard_quotas(wanted: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rank, shard, quota: blocks of each source in each shard, by highest quotients.

    With h blocks given so far and n sources, every source holds between
    round(target (h - n/2) / total) and round(target (h + n/2) / total) of them, so only
    the quotients between are ranked, about two for each source.
    """
    n = F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    houses = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda j: F.struct(
            j.alias("upto"),
            F.floor(F.ceil(F.col("total") / BLOCK_WORDS) * j / shards).cast("long").alias("h")),
    )
    share = F.col("target") / F.col("total")
    near = (
        wanted.filter(F.col("total") > 0)
        .withColumn("_n", n)
        .withColumn("_house", F.explode(houses))
        .select(
            "rank", "target", F.col("_house.upto").alias("upto"), F.col("_house.h").alias("h"),
            F.greatest(F.floor(share * (F.col("_house.h") - F.col("_n") / 2) + 0.5),
                       F.lit(0)).cast("long").alias("low"),
            F.floor(share * (F.col("_house.h") + F.col("_n") / 2) + 0.5)
            .cast("long").alias("high"),
        )
    )
    left = F.col("h") - F.sum("low").over(Window.partitionBy("upto"))
    seats = F.when(
        F.col("high") > F.col("low"),
        F.transform(F.sequence(F.col("low") + 1, F.col("high")), lambda k: k.cast("long")),
    ).otherwise(F.array().cast("array<bigint>"))
    quotients = (
        near.withColumn("left", left)
        .withColumn("k", F.explode_outer(seats))
        .withColumn("_q", F.col("target") / (2 * F.col("k") - 1))
    )
    place = F.row_number().over(
        Window.partitionBy("upto").orderBy(F.col("_q").desc_nulls_last(), "rank"))
    held = (
        quotients.withColumn("_given", F.col("k").isNotNull() & (place <= F.col("left")))
        .groupBy("upto", "rank")
        .agg((F.max("low") + F.sum(F.col("_given").cast("long"))).alias("held"))
    )
    earlier = F.lag("held", 1, 0).over(Window.partitionBy("rank").orderBy("upto"))
    return held.select("rank", (F.col("upto") - 1).alias("shard"),
                       (F.col("held") - earlier).alias("quota"))


def mix(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken`` words of each row.

    A block counts for a document by the words they share. Of a block taken q times the
    document gives those words q times.
    """
    sized = stored(sizes(docs, keep), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                            F.count(F.lit(1)).alias("_rows"))
    rows = sized.count()
    # Hex digits of the order that leave about BUCKET_ROWS rows of the whole table a bucket.
    digits = max(1, len(f"{rows // BUCKET_ROWS:x}"))
    sized = sized.withColumn("_bucket", F.substring("_order", 1, digits))
    wanted = targets(by_source.drop("_rows"))
    quotas = shard_quotas(wanted, shards).groupBy("rank").agg(F.sum("quota").alias("quota"))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    plan = stored(
        wanted.join(quotas, "rank", "left").select(
            "source", "source_size", "target", blocks.alias("_blocks"),
            F.least(F.coalesce("quota", F.lit(0)), MOST * blocks).alias("_quota"),
            F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), F.lit("turn"), "source")),
                               1, 8), 16, 10).cast("long").alias("_turn"),
        ),
        "mix-plan",
    )
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_bucket").orderBy(
        "_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("_upto", F.sum("size").over(within))
        .join(bases, F.col("source").eqNullSafe(F.col("_s"))
              & (F.col("_bucket") == F.col("_b")))
        .withColumn("_start", F.col("_base") + F.col("_upto") - F.col("size"))
        .select("doc_id", "source", *keep, "size", "_start")
    )
    plan = plan.withColumnRenamed("source", "_s")
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    whole = F.floor(F.col("_quota") / F.greatest("_blocks", F.lit(1)))
    rest = F.col("_quota") - whole * F.col("_blocks")
    end = F.col("_start") + F.col("size")

    def words(total: Column, block: Column) -> Column:
        shared = F.least(end, (block + 1) * BLOCK_WORDS) - F.greatest(
            F.col("_start"), block * BLOCK_WORDS)
        place = (block + F.col("_turn")) % F.greatest("_blocks", F.lit(1))
        return total + shared * F.when(place < rest, 1).otherwise(0)

    spanned = F.sequence(F.floor(F.col("_start") / BLOCK_WORDS),
                         F.floor((end - 1) / BLOCK_WORDS))
    extra = F.when(F.col("size") > 0, F.aggregate(spanned, F.lit(0).cast("long"), words))
    return joined.select(
        "doc_id", "source", *keep, "size", "source_size", "target",
        (whole * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    A document taken in part counts as taken if that is half of it or more. Rows are told
    apart by 128 bits of all their columns; rows that are equal in all of them are one row,
    taken as often as all of them together.
    """
    held, names = renamed(docs)
    keyed = held.withColumn("_mix_key", row_hash(docs, names))
    given = keyed.select(
        at(docs, "doc_id").alias("doc_id"), at(docs, "source").alias("source"),
        at(docs, "text").alias("text"), "_mix_key")
    copies = mix(given, shards, ("_mix_key",)).groupBy("_mix_key").agg(
        F.sum(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5))
              .otherwise(0)).cast("int").alias("_mix_copies"))
    # Equal rows fold in their own task; one of them stands for all.
    once = keyed.dropDuplicates(["_mix_key"]).join(
        copies.filter(F.col("_mix_copies") > 0), "_mix_key")
    return original(once.withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))), docs)


ORACLE_SQL = f"""
WITH sized AS (
    SELECT doc_id, source,
        md5(concat_ws('/', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS o,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
    FROM documents),
by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM by_source),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM ranked),
levels AS (
    SELECT *, {MOST} * source_size / weight AS ratio,
        (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (
            ORDER BY {MOST} * source_size / weight, rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
        / (sum(weight) OVER (ORDER BY {MOST} * source_size / weight, rank
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
    FROM weighed),
free AS (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
wanted AS (
    SELECT source, source_size, rank,
        least(CASE WHEN ratio >= level OR ratio >= (SELECT level FROM free)
                   THEN (SELECT level FROM free) * weight
                   ELSE {MOST}.0 * source_size END, {MOST}.0 * source_size)::DOUBLE AS target,
        (sum(source_size) OVER ())::BIGINT AS total
    FROM levels),
seats AS (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS place
    FROM wanted, unnest(range(1, (target / {BLOCK_WORDS} + 3)::BIGINT)) AS u(k)
    WHERE total > 0),
quotas AS (
    SELECT rank, count(*) AS quota FROM seats
    WHERE place <= (SELECT ceil(max(total) / {BLOCK_WORDS}) FROM wanted) GROUP BY rank),
plan AS (
    SELECT w.source, source_size, target, ceil(source_size / {BLOCK_WORDS})::BIGINT AS blocks,
        least(coalesce(quota, 0), {MOST} * ceil(source_size / {BLOCK_WORDS}))::BIGINT AS quota,
        ('0x' || substr(md5(concat_ws('/', '{SEED}', 'turn', w.source)), 1, 8))::BIGINT AS turn
    FROM wanted w LEFT JOIN quotas q USING (rank)),
placed AS (
    SELECT doc_id, source, size, (sum(size) OVER (
        PARTITION BY source ORDER BY o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
        - size)::BIGINT AS start
    FROM sized),
spans AS (
    SELECT doc_id, p.source, size, start, source_size, target, blocks, turn,
        quota // greatest(blocks, 1) AS whole, quota % greatest(blocks, 1) AS rest
    FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target,
    (whole * size + coalesce(list_sum(list_transform(
        CASE WHEN size > 0
             THEN range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)
             ELSE [] END,
        lambda b: CASE WHEN (b + turn) % blocks < rest
                  THEN least(start + size, (b + 1) * {BLOCK_WORDS})
                       - greatest(start, b * {BLOCK_WORDS})
                  ELSE 0 END)), 0))::BIGINT AS taken
FROM spans
"""
