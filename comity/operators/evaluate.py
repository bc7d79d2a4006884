"""Classifier evaluation.

Everything starts from counts per (actual, predicted): one aggregate whose result has at
most one row per pair of classes, whatever the size of the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comity import constants as K
from comity.workspace import new_path


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion_counts(
    df: DataFrame, *by: str, actual: str = "label", predicted: str = "prediction"
) -> DataFrame:
    return df.groupBy(
        *by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def per_class(
    counts: DataFrame, *by: str, classes: Sequence[int] = K.CLASSES
) -> DataFrame:
    """Precision, recall, F1 and support for every listed class, 0 where undefined."""
    sums = []
    for c in classes:
        is_actual, is_predicted = F.col("actual") == c, F.col("predicted") == c
        sums += [
            _total(is_actual & is_predicted).alias(f"hit_{c}"),
            _total(is_actual).alias(f"actual_{c}"),
            _total(is_predicted).alias(f"predicted_{c}"),
        ]
    wide = counts.groupBy(*by).agg(*sums)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("class"),
            F.col(f"hit_{c}").alias("hits"),
            F.col(f"actual_{c}").alias("support"),
            F.col(f"predicted_{c}").alias("predicted"),
        )
        for c in classes
    ])
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return (
        wide.select(*by, F.inline(rows))
        .withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def overall(counts: DataFrame, *by: str) -> DataFrame:
    """Accuracy over all rows, and macro averages over all labels seen in truth or
    prediction, listed classes or not. A row without a label is never a hit."""
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    labels = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
        )
    )
    hits = counts.groupBy(*by, F.col("actual").alias("class")).agg(F.sum(hit).alias("hits"))
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*by, "class")]
    joined = labels.alias("l").join(hits.alias("h"), keys, "left").select(
        *[F.col(f"l.{k}").alias(k) for k in (*by, "class")], "support", "predicted",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    scored = joined.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", _f1(F.col("precision"), F.col("recall")))
    named = F.col("class").isNotNull()
    return scored.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(F.when(named, F.col(m))).alias(f"{m}_macro")
          for m in ("precision", "recall", "f1")],
    )


def report(
    counts: DataFrame,
    classes: Sequence[int] = K.CLASSES,
    names: Mapping[int, str] = K.CLASS_NAMES,
) -> DataFrame:
    """Per class, accuracy, macro average and weighted average, as one table.

    The macro row averages over all listed classes here. Accuracy is that of all rows, of
    whatever class; precision and recall are empty on its row.
    """
    table = per_class(counts, classes=classes)
    named = F.lit(None).cast("string")
    for c, name in names.items():
        named = F.when(F.col("class") == c, name).otherwise(named)

    metrics = ("precision", "recall", "f1")
    whole = F.sum("support").alias("support")

    def weighted(m: str) -> Column:
        return _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)

    summary = table.agg(
        F.struct(F.lit("macro avg").alias("name"), *[F.avg(m).alias(m) for m in metrics],
                 whole).alias("m"),
        F.struct(F.lit("weighted avg").alias("name"), *[weighted(m) for m in metrics],
                 whole).alias("w"),
    ).select(F.inline(F.array("m", "w")))
    none = F.lit(None).cast("double")
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    accuracy = counts.agg(
        F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"),
        _ratio(hits, F.sum("n")).alias("f1"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("support"),
    )
    rows = table.select(named.alias("name"), *metrics, "support")
    return rows.unionByName(accuracy).unionByName(summary).select(
        "name", *[F.bround(m, 4).alias(m) for m in metrics], "support"
    )


def confusion_matrix(
    counts: DataFrame, classes: Sequence[int] = K.CLASSES
) -> DataFrame:
    """Rows are actual classes, columns predicted ones; every cell is filled."""
    cells = counts.agg(*[
        _total((F.col("actual") == a) & (F.col("predicted") == p)).alias(f"_{a}_{p}")
        for a in classes for p in classes
    ])
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("actual"),
            *[F.col(f"_{a}_{p}").alias(f"predicted_{p}") for p in classes],
        )
        for a in classes
    ])
    return cells.select(F.inline(rows))


def label_pairs(
    df: DataFrame, truths: Mapping[str, Column], flags: Mapping[str, Column]
) -> DataFrame:
    """Multi-label truth and flags, one row per text and label, inside the row."""
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("label_name"),
            truths[label].cast("int").alias("label"),
            flags[label].cast("int").alias("prediction"),
        )
        for label in truths
    ])
    return df.select(F.inline(rows))


def multilabel(
    counts: DataFrame, threshold: float = K.LABEL_THRESHOLD
) -> DataFrame:
    """Per-label confusion cells and metrics, from counts by label_name."""
    def cell(actual: int, predicted: int) -> Column:
        return _total((F.col("actual") == actual) & (F.col("predicted") == predicted))

    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        counts.groupBy("label_name")
        .agg(
            cell(1, 1).alias("tp"), cell(0, 1).alias("fp"),
            cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        )
        .withColumns({
            "support": F.col("tp") + F.col("fn"),
            "precision": precision,
            "recall": recall,
            "threshold": F.lit(threshold),
        })
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def multilabel_averages(per_label: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1 over the labels."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per_label.agg(
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def ranged_scores(
    df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score"
) -> DataFrame:
    """Positives and negatives per distinct score, stored in ranges of about equal size.

    ``part`` numbers the ranges in order of (by, score). They are cut where the scores are,
    so scores that crowd in one place are spread like any others.
    """
    value = F.col(score).cast("double")
    counted = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(
        *by, value.alias("score")
    ).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"),
        F.count_if(F.col(label) == 0).cast("double").alias("neg"),
    )
    spark = df.sparkSession
    path = new_path(spark, "ranged-scores")
    # Written, since a range would be cut elsewhere if it were worked out again.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, *by, "score").withColumn(
        "part", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def roc_auc(df: DataFrame, *by: str, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the rank-sum formula, ties at half weight.

    Exact: scores are ranked as they are. A window holds one range of ``ranged_scores``;
    the negatives of earlier ranges come from one row a range. Null and NaN scores are left
    out. Null when a class is absent.
    """
    ranged = ranged_scores(df, by, label, score)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "part").agg(F.sum("neg").alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("part").alias("_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_offset"))
    same = F.col("part") == F.col("_part")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    won = F.sum(F.col("pos") * (F.col("_offset") + F.col("_inside") + F.col("neg") / 2))
    return ranked.join(offsets, same).groupBy(*by).agg(
        F.sum("pos").cast("bigint").alias("positives"),
        F.sum("neg").cast("bigint").alias("negatives"),
        F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"),
    )


def slices(
    df: DataFrame,
    slice_col: str,
    actual: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """Metrics per value of a non-sensitive field, and the accuracy gap to the whole."""
    counts = confusion_counts(df, slice_col, actual=actual, predicted=predicted)
    whole = counts.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    accuracy = overall(whole).select("accuracy").scalar()
    return overall(counts, slice_col).withColumn(
        "accuracy_gap", F.col("accuracy") - accuracy
    )


def crossed_slices(
    df: DataFrame,
    fields: Sequence[str],
    actual: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """``slices`` by every field and every combination of fields, from one pass.

    Rows are counted once by all fields, truth and prediction; the other groupings add up
    those counts. ``slice`` names the fields that a row is about, joined by " x "; the
    others are null. Null values of a field are a slice of their own.
    """
    counts = confusion_counts(df, *fields, actual=actual, predicted=predicted)
    sets = [list(c) for n in range(len(fields) + 1) for c in itertools.combinations(fields, n)]
    named = [
        F.when(F.grouping(f) == 0, F.lit(f)) for f in fields
    ]
    added = counts.groupingSets(
        [[*s, "actual", "predicted"] for s in sets], *fields, "actual", "predicted"
    ).agg(F.sum("n").alias("n"), F.concat_ws(" x ", *named).alias("slice"))
    found = overall(added, "slice", *fields)
    whole = F.max(F.when(F.col("slice") == "", F.col("accuracy"))).over(Window.partitionBy())
    return found.withColumn("accuracy_gap", F.col("accuracy") - whole).filter(
        F.col("slice") != "")


def error_examples(
    df: DataFrame,
    key: str,
    n: int = 5,
    label: str = "label",
    predicted: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """The most confident false positives and false negatives of a binary verdict."""
    kind = (
        F.when((F.col(label) == 0) & (F.col(predicted) == 1), "false_positive")
        .when((F.col(label) == 1) & (F.col(predicted) == 0), "false_negative")
    )
    strongest = Window.partitionBy("error_type").orderBy(F.desc(confidence), key)
    return (
        df.withColumn("error_type", kind)
        .filter(F.col("error_type").isNotNull())
        .withColumn("rank", F.row_number().over(strongest))
        .filter(F.col("rank") <= n)
    )
