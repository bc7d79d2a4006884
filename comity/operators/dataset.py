"""Training-set preparation: clean, dedupe, split, verify, weigh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions import text as tx
from comity.operators.verdicts import settled

SPLITS = ("train", "val", "test")
_HEX_DIGITS = 4
MAX_CLASSES = 1_000


def clean_labelled(
    df: DataFrame,
    text_col: str = "tweet",
    label_col: str = "class",
    key_col: str = "row_key",
    entities: str = "full",
) -> DataFrame:
    """Keep key, label and text; drop null texts, clean, drop blanks, cast the label."""
    present = df.select(key_col, label_col, text_col).dropna(subset=[text_col])
    cleaned = present.withColumn(text_col, tx.clean_tweet(text_col, entities))
    return (
        settled(cleaned, text_col)
        .filter(F.col(text_col) != "")
        .withColumn(label_col, F.col(label_col).cast("int"))
    )


def keep_first(df: DataFrame, by: str, key_col: str) -> DataFrame:
    """One whole row per value of ``by``: the one with the smallest key.

    A null key comes last; among equal keys a hash of the other columns decides, so that
    the columns of a row stay together. Null values of ``by`` are one value.

    Two steps: the least key of each value is found by digest, without any text. Then each
    row looks its own (digest, key, hash) up among the winners. Copies that agree in all
    three fold together before the shuffle, and a value that a third of the rows share is
    spread by its keys.
    """
    rest = [c for c in df.columns if c not in (by, key_col)]
    hashed = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    rows = df.withColumns({
        "_digest": F.coalesce(_digest(by), F.lit("")),
        "_none": F.col(key_col).isNull(),
        "_tie": F.xxhash64(*hashed) if hashed else F.lit(0).cast("long"),
    })
    least = F.min(F.struct("_none", F.col(key_col).alias("_key"), "_tie"))
    winners = rows.groupBy("_digest").agg(least.alias("_least")).select(
        F.col("_digest").alias("_d"), "_least._key", F.col("_least._tie").alias("_t"))
    found = (
        (F.col("_digest") == F.col("_d")) & (F.col("_tie") == F.col("_t"))
        & F.col(key_col).eqNullSafe(F.col("_key"))
    )
    return rows.dropDuplicates(["_digest", key_col, "_tie"]).join(winners, found).select(
        *df.columns)


def _digest(text_col: str) -> Column:
    """Stands for a text where only equality counts, so that texts stay out of shuffles."""
    return F.sha2(F.col(text_col).cast("string"), 256)


def dedupe_report(df: DataFrame, by: str) -> DataFrame:
    """Rows before, rows kept and rows removed by ``keep_first``."""
    per_text = df.groupBy(_digest(by)).agg(F.count("*").alias("_n"))
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_kept"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows_removed"),
    )


def split_order(key_col: str, seed: int = 42) -> Column:
    """Hash that orders the rows of a class; unique as long as the key is."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def stratified_split(
    df: DataFrame,
    label_col: str = "class",
    key_col: str = "row_key",
    val_share: float = 0.10,
    test_share: float = 0.10,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per class, exact shares in hash order of the key.

    Ranking a class in one window would put a third of the data into one task. Instead
    each class is counted per hash prefix, the cut positions are located in that small
    table, and only the one or two prefixes that hold a cut are ranked row by row. The
    full table is then labelled by comparing its hash with two cut values per class,
    without any shuffle.

    Every class found is split, null being one of them. The cut table has one row per
    class; more than MAX_CLASSES of them are an error, which bounds the broadcasts. The
    input is read several times, so it should be a stored table rather than an
    expensive plan.
    """
    if df.select(label_col).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"{label_col!r} has more than {MAX_CLASSES} classes")
    order = split_order(key_col, seed)
    keys = df.select(
        F.col(label_col).alias("_class"), order.alias("_order")
    ).withColumn("_prefix", F.substring("_order", 1, _HEX_DIGITS))

    # At most 16**4 prefixes per class: a bounded window.
    running = Window.partitionBy("_class").orderBy("_prefix")
    whole = Window.partitionBy("_class")
    prefixes = (
        keys.groupBy("_class", "_prefix").agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_held", F.ceil(F.col("_total") * (val_share + test_share)))
        .withColumn("_train", F.col("_total") - F.col("_held"))
        .withColumn("_val", F.col("_train") + F.floor(F.col("_held") * _val_part(val_share, test_share)))
    )

    def holds(cut: str) -> Column:
        return (F.col(cut) > F.col("_start")) & (F.col(cut) <= F.col("_end"))

    wanted = prefixes.filter(holds("_train") | holds("_val")).select(
        F.col("_class").alias("_in_class"), F.col("_prefix").alias("_in_prefix"),
        "_start", "_train", "_val",
    )
    inside = F.col("_class").eqNullSafe(F.col("_in_class")) & (
        F.col("_prefix") == F.col("_in_prefix")
    )
    ranked = keys.join(F.broadcast(wanted), inside).withColumn(
        "_rank",
        F.col("_start")
        + F.row_number().over(Window.partitionBy("_class", "_prefix").orderBy("_order")),
    )
    cuts = (
        ranked.filter((F.col("_rank") == F.col("_train")) | (F.col("_rank") == F.col("_val")))
        .groupBy("_class")
        .agg(
            F.max(F.when(F.col("_rank") == F.col("_train"), F.col("_order"))).alias("_train_cut"),
            F.max(F.when(F.col("_rank") == F.col("_val"), F.col("_order"))).alias("_val_cut"),
        )
    )
    labelled = df.withColumn("_order", order).join(
        F.broadcast(cuts), F.col(label_col).eqNullSafe(F.col("_class")), "left"
    )
    split = (
        F.when(F.col("_order") <= F.col("_train_cut"), "train")
        .when(F.col("_order") <= F.col("_val_cut"), "val")
        .otherwise("test")
    )
    return labelled.withColumn("split", split).select(*df.columns, "split")


def _val_part(val_share: float, test_share: float) -> float:
    return val_share / (val_share + test_share)


def split_sizes(df: DataFrame, label_col: str = "class") -> DataFrame:
    return df.groupBy("split", label_col).agg(F.count("*").alias("rows"))


def cleaning_report(df: DataFrame, text_col: str = "tweet") -> DataFrame:
    """Left-over URLs, mentions, retweet marks, blanks and duplicate rows."""
    text = F.col(text_col)
    mark = rf"(?Ui)rt(?<!{tx.WORD}rt)(?!{tx.WORD})"
    return df.agg(
        F.count_if(text.rlike(tx.URL)).alias("urls"),
        F.count_if(text.rlike(tx.MENTION)).alias("mentions"),
        F.count_if(text.rlike(mark)).alias("retweets"),
        F.count_if(tx.is_blank(text_col)).alias("empty"),
        (F.count(text) - F.count_distinct(_digest(text_col))).alias("duplicates"),
    )


def split_overlap(df: DataFrame, text_col: str = "tweet") -> DataFrame:
    """Distinct texts shared by each pair of splits, from one pass with one shuffle."""
    seen = df.groupBy(_digest(text_col)).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    )

    def shared(a: str, b: str) -> Column:
        return F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}")

    return seen.agg(shared("train", "val"), shared("train", "test"), shared("val", "test"))


def class_distribution(
    df: DataFrame, label_col: str = "class", classes: Sequence[int] | None = K.CLASSES
) -> DataFrame:
    """Rows per class. With ``classes`` given, absent ones appear with 0."""
    if classes is None:
        return df.groupBy(label_col).agg(F.count("*").alias("rows"))
    return _class_counts(df, label_col, classes).select(label_col, "rows")


def _class_counts(df: DataFrame, label_col: str, classes: Sequence[int]) -> DataFrame:
    """Rows per listed class and in total, from one global aggregate."""
    counts = df.agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col(label_col) == c).alias(f"_{c}") for c in classes],
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias(label_col), F.col(f"_{c}").alias("rows")) for c in classes
    ])
    return counts.select("_total", F.inline(pairs))


def class_weights(
    df: DataFrame, label_col: str = "class", classes: Sequence[int] = K.CLASSES
) -> DataFrame:
    """``N / (K * count)`` per class; an absent class counts as one row."""
    count = F.greatest(F.col("rows"), F.lit(1))
    return _class_counts(df, label_col, classes).select(
        label_col, "rows", (F.col("_total") / (len(classes) * count)).alias("weight")
    )


def with_class_weight(
    df: DataFrame, label_col: str = "class", classes: Sequence[int] = K.CLASSES
) -> DataFrame:
    """Attach the class weight to every row; the weight table has one row per class."""
    weights = class_weights(df, label_col, classes).select(label_col, "weight")
    return df.join(F.broadcast(weights), label_col, "left")
