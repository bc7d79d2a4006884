"""Supervised training with class weights; the best candidate or epoch by macro F1 wins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions.text import NON_WORD_RUN, or_empty
from comity.operators import dataset, evaluate
from comity.operators.scoring import ModelScorer
from comity.workspace import new_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Features written once and read by every fit; a lost executor costs a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def features(text_col: str, buckets: int = 1 << 18) -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="words", pattern=NON_WORD_RUN),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=buckets),
        IDF(inputCol="counts", outputCol="features"),
    ]


def train_classifier(
    train: DataFrame,
    val: DataFrame,
    text_col: str = "tweet",
    label_col: str = "class",
    classes: Sequence[int] = K.CLASSES,
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 30,
    buckets: int = 1 << 18,
) -> tuple[PipelineModel, DataFrame]:
    """Fit one multinomial model per regularisation and keep the best.

    Features are built once and shared by all candidates. Returns the winning pipeline
    and a table of validation metrics with the winner marked.
    """
    prepare = Pipeline(stages=features(text_col, buckets)).fit(train)
    weighted = dataset.with_class_weight(train, label_col, classes)
    ready = _stored(prepare.transform(weighted).select(
        F.col(label_col).cast("double").alias("label"), "weight", "features"
    ), "train-features")
    held = _stored(prepare.transform(val).select(
        F.col(label_col).alias("label"), "features"
    ), "val-features")
    fitted = []
    for reg in reg_params:
        model = LogisticRegression(
            weightCol="weight", family="multinomial", regParam=reg, maxIter=max_iter
        ).fit(ready)
        predicted = model.transform(held).withColumn(
            "prediction", F.col("prediction").cast("int")
        )
        row = evaluate.overall(evaluate.confusion_counts(predicted)).first()
        fitted.append((reg, model, row))
    best = max(range(len(fitted)), key=lambda i: fitted[i][2]["f1_macro"] or 0.0)
    spark = train.sparkSession
    metrics = spark.createDataFrame(
        [
            (float(reg), float(row["accuracy"]), float(row["f1_macro"] or 0.0), i == best)
            for i, (reg, _, row) in enumerate(fitted)
        ],
        "reg_param double, accuracy double, f1_macro double, selected boolean",
    )
    return PipelineModel(stages=prepare.stages + [fitted[best][1]]), metrics


def hashed_words(text_col: str, buckets: int) -> Column:
    """The words of a text as bucket numbers, one for each word."""
    words = F.filter(F.split(F.lower(or_empty(text_col)), NON_WORD_RUN), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


class SoftmaxModel:
    """Class weights per word bucket, and a bias per class; texts are unit count vectors."""

    def __init__(self, weights: np.ndarray, classes: Sequence[int]):
        self.weights, self.classes = weights, tuple(classes)  # (buckets + 1) x classes

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1

    def logits(self, words: pa.Array) -> tuple[np.ndarray, tuple]:
        """Logits of each text, and its vector as (row, bucket, value) entries."""
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), counts)
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        entry, times = np.unique(row * self.buckets + flat, return_counts=True)
        row, bucket = np.divmod(entry, self.buckets)
        norm = np.sqrt(np.bincount(row, times.astype(float) ** 2, minlength=len(words)))
        value = times / np.where(norm > 0, norm, 1.0)[row]
        out = np.tile(self.weights[-1], (len(words), 1))
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(
                row, value * self.weights[bucket, k], minlength=len(words))
        return out, (row, bucket, value)

    def transform(self, df: DataFrame, text_col: str = "tweet") -> DataFrame:
        """``df`` with ``prediction``, the first class of the greatest logit."""
        predict, classes = self.logits, np.array(self.classes)
        # One value serves all tasks of the query.
        @F.pandas_udf("int")
        def best(words: pd.Series) -> pd.Series:
            logits, _ = predict(pa.array(words, pa.list_(pa.int32())))
            return pd.Series(classes[logits.argmax(1)], dtype="int32")

        return df.withColumn("prediction", best(hashed_words(text_col, self.buckets)))


def epoch_sums(ready: DataFrame, model: SoftmaxModel) -> tuple[np.ndarray, float, float]:
    """Gradient of the weighted log loss at ``model``, the loss, and the sum of weights.

    Each task adds up its own rows and sends one number per bucket and class it has met;
    what reaches the driver is bounded by the size of the model.
    """
    classes, shape = np.array(model.classes), model.weights.shape

    def work(batches):
        total, loss, mass = np.zeros(shape), 0.0, 0.0
        for batch in batches:
            logits, (row, bucket, value) = model.logits(batch.column("words"))
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            truth = batch.column("label").to_numpy(zero_copy_only=False)
            logits = logits - logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            hit = truth[:, None] == classes
            loss -= float((logits * hit).sum(1) @ weight)
            mass += float(weight.sum())
            slope = (np.exp(logits) - hit) * weight[:, None]
            for k in range(shape[1]):
                total[:-1, k] += np.bincount(
                    bucket, value * slope[row, k], minlength=shape[0] - 1)
            total[-1] += slope.sum(0)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(np.concatenate([at, [flat.size, flat.size + 1]]), pa.int32()),
            "value": pa.array(np.concatenate([flat[at], [loss, mass]]), pa.float64())})

    added = ready.mapInArrow(work, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")).toArrow()
    flat = np.zeros(shape[0] * shape[1] + 2)
    flat[added.column("at").to_numpy()] = added.column("value").to_numpy()
    return flat[:-2].reshape(shape), flat[-2], flat[-1]


def train_epochs(
    train: DataFrame,
    val: DataFrame,
    text_col: str = "tweet",
    label_col: str = "class",
    classes: Sequence[int] = K.CLASSES,
    epochs: int = 10,
    learning_rate: float = 4.0,
    momentum: float = 0.9,
    weight_decay: float = 1e-5,
    buckets: int = 1 << 16,
) -> tuple[SoftmaxModel, DataFrame]:
    """Weighted softmax regression by gradient epochs; the best epoch by macro F1 is kept.

    Every epoch is one pass over the stored features: a gradient aggregate, a step on the
    driver (momentum, decay of the weights but not of the bias), and the validation metrics
    of the new weights. Of equal epochs the first wins. Returns the best model and a row per
    epoch: loss before the step, accuracy and macro F1 after it. Rows whose label is not
    among ``classes`` do not take part.
    """
    def ready(df: DataFrame, name: str) -> DataFrame:
        of_class = df.filter(F.col(label_col).isin(list(classes)))
        return _stored(dataset.with_class_weight(of_class, label_col, classes).select(
            F.col(label_col).cast("int").alias("label"), "weight",
            hashed_words(text_col, buckets).alias("words")), name)

    rows, held = ready(train, "epoch-train"), ready(val, "epoch-val")
    weights = np.zeros((buckets + 1, len(classes)))
    speed, best, log = np.zeros_like(weights), None, []
    for epoch in range(1, epochs + 1):
        slope, loss, mass = epoch_sums(rows, SoftmaxModel(weights, classes))
        if not mass:
            raise ValueError("no training rows with a listed class")
        slope /= mass
        slope[:-1] += weight_decay * weights[:-1]
        speed = momentum * speed - learning_rate * slope
        weights = weights + speed
        model = SoftmaxModel(weights, classes)
        metrics = evaluate.overall(evaluate.confusion_counts(_judged(held, model))).first()
        f1 = float(metrics["f1_macro"] or 0.0)
        log.append((epoch, float(loss / mass), float(metrics["accuracy"] or 0.0), f1,
                    int(metrics["rows"] or 0)))
        if best is None or f1 > best[0]:
            best = f1, epoch, model
    table = train.sparkSession.createDataFrame(
        [(*row, row[0] == best[1]) for row in log],
        "epoch int, train_loss double, accuracy double, f1_macro double, val_rows long, "
        "selected boolean")
    return best[2], table


def _judged(held: DataFrame, model: SoftmaxModel) -> DataFrame:
    classes = np.array(model.classes, np.int32)

    def work(batches):
        for batch in batches:
            logits, _ = model.logits(batch.column("words"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(classes[logits.argmax(1)])],
                ["label", "prediction"])

    return held.mapInArrow(work, "label int, prediction int")


def train_label_models(
    train: DataFrame,
    text_col: str,
    labels: Sequence[str],
    max_iter: int = 30,
    buckets: int = 1 << 18,
) -> ModelScorer:
    """A scorer with one weighted binary model per 0/1 label column.

    Features are built once and kept for all labels.
    """
    prepare = Pipeline(stages=features(text_col, buckets)).fit(train)
    prepared = _stored(prepare.transform(train).select("features", *labels), "label-features")
    models = {}
    for label in labels:
        weighted = dataset.with_class_weight(prepared, label, (0, 1))
        ready = weighted.select(
            F.col(label).cast("double").alias("label"), "weight", "features"
        )
        models[label] = LogisticRegression(weightCol="weight", maxIter=max_iter).fit(ready)
    return ModelScorer(prepare, models, text_col)
