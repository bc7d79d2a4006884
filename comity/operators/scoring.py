"""Bulk scoring: a scorer adds one probability per label to every row.

A scorer is anything with ``labels`` and ``raw_scores(df, text_col) -> df`` that adds a
``raw_scores`` struct with one double field per label. Three are built in: a lexicon
(pure expressions), fitted Spark ML models, and a user function over Arrow batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity import constants as K
from comity.functions import text as tx
from comity.functions.values import round_half_even, sigmoid

RAW = "raw_scores"


class Scorer(Protocol):
    labels: Sequence[str]

    def raw_scores(self, df: DataFrame, text_col: str) -> DataFrame: ...


def may_fail(scorer: Scorer) -> bool:
    """Whether rows can come back without a score; a scorer that cannot fail saves checks."""
    return getattr(scorer, "may_fail", True)


class LexiconScorer:
    """Sum of token weights plus a bias, through a sigmoid, for every label.

    The whole text is split once, cut down to the lexicon's tokens, and each label sums
    over what is left. No join and no shuffle: the lexicon is part of the plan.
    """

    ignores_spacing = True
    may_fail = False

    def __init__(
        self,
        weights: Mapping[str, Mapping[str, float]] = K.LEXICON,
        bias: Mapping[str, float] = K.LEXICON_BIAS,
    ):
        self.weights, self.bias = weights, bias
        self.labels = tuple(weights)
        self.vocabulary = frozenset(w for table in weights.values() for w in table)

    def hits(self, text: Column | str) -> Column:
        return tx.words_in(text, self.vocabulary)

    def weight_of(self, label: str, token: Column) -> Column:
        table = self.weights[label]
        pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), token), F.lit(0.0))

    def weight_sum(self, label: str, hits: Column) -> Column:
        return F.aggregate(
            hits, F.lit(0.0), lambda total, token: total + self.weight_of(label, token)
        )

    def raw_scores(
        self, df: DataFrame, text_col: str = "text", hits_col: str | None = None
    ) -> DataFrame:
        source = df if hits_col else df.withColumn("_hits", self.hits(text_col))
        hits = F.col(hits_col or "_hits")
        fields = [
            sigmoid(self.weight_sum(label, hits) + self.bias[label]).alias(label)
            for label in self.labels
        ]
        return source.withColumn(RAW, F.struct(*fields)).drop("_hits")

    def class_logits(self, hits: Column) -> tuple[Column, Column, Column]:
        """Hate, offensive and neither logits for the three-class policy."""
        def group(labels: Sequence[str]) -> Column:
            total = F.lit(0.0)
            for label in labels:
                total = total + self.weight_sum(label, hits)
            return total

        return group(K.HATE_LABELS), group(K.OFFENSIVE_LABELS), F.lit(K.NEITHER_LOGIT)


class ModelScorer:
    """Fitted binary Spark ML models, one per label, over one shared feature pipeline.

    The text is tokenized and hashed once, whatever the number of labels.
    """

    may_fail = False

    def __init__(self, features, models: Mapping[str, object], text_col: str = "text"):
        self.features, self.models, self.text_col = features, models, text_col
        self.labels = tuple(models)

    def raw_scores(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        kept = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        out = self.features.transform(
            kept.select("_row", tx.or_empty(text_col).alias(self.text_col))
        ).select("_row", "features")
        fields = []
        for label, model in self.models.items():
            model = model.copy()
            model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p_{label}")
            out = model.transform(out)
            fields.append(vector_to_array(f"_p_{label}")[1].alias(label))
        return out.select("_row.*", F.struct(*fields).alias(RAW))


class PandasScorer:
    """A user function ``Series of texts -> DataFrame of probabilities``.

    ``load`` runs once per Python worker and returns that function, so a model is read
    once and then used for every Arrow batch of the worker's partitions. A batch that it
    fails on is halved until the texts that it cannot score stand alone; those, and texts
    it gives no usable number for, have no scores, and the other rows keep theirs.
    """

    may_fail = True

    def __init__(
        self, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], labels=K.LABELS
    ):
        self.load, self.labels = load, tuple(labels)

    def raw_scores(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        load, labels = self.load, list(self.labels)
        schema = T.StructType([T.StructField(label, T.DoubleType()) for label in labels])

        @F.pandas_udf(schema)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            predict = load()
            for texts in batches:
                out = pd.DataFrame(0.0, index=texts.index, columns=labels)
                filled = texts.notna()
                if filled.any():
                    out.loc[filled, labels] = scored_in_halves(predict, texts[filled], labels)
                yield out

        # A blank text is sent as null and never reaches the model.
        text = F.when(~tx.is_blank(text_col), F.col(text_col))
        return df.withColumn(RAW, score(text))


def scored_in_halves(
    predict: Callable[[pd.Series], pd.DataFrame], texts: pd.Series, labels: list[str]
) -> np.ndarray:
    """Probabilities of all texts, NaN for those that ``predict`` fails on."""
    out = np.full((len(texts), len(labels)), np.nan)
    parts = [(0, len(texts))]
    while parts:
        start, end = parts.pop()
        try:
            found = predict(texts.iloc[start:end])[labels].to_numpy(float)
            if len(found) != end - start:
                raise ValueError("the scorer returned another number of rows")
            out[start:end] = found
        except Exception:  # whatever a user's model raises
            if end - start > 1:
                middle = (start + end) // 2
                parts += [(start, middle), (middle, end)]
    return out


def failed(scores: Sequence[Column]) -> Column:
    """Whether a row has no usable score: all are null or NaN."""
    usable = [~F.isnan(c) & c.isNotNull() for c in scores]
    return ~functools.reduce(lambda a, b: a | b, usable)


def score_table(
    df: DataFrame,
    scorer: Scorer,
    text_col: str = "text",
    threshold: float = K.LABEL_THRESHOLD,
    keep_raw: bool = False,
) -> DataFrame:
    """Append ``<label>_score`` (4 digits) and ``<label>_flagged`` for every label.

    The flag compares the unrounded probability. Blank texts score 0. A scorer that
    ``may_fail`` leaves a null score, unflagged, where it gave no number; ``failed`` tells
    the rows without any.
    """
    if text_col not in df.columns:
        raise ValueError(f"the table has no column {text_col!r}")
    scored = scorer.raw_scores(df.withColumn("_blank", tx.is_blank(text_col)), text_col)
    blank = F.col("_blank")
    columns = {}
    for label in scorer.labels:
        raw = F.col(RAW)[label]
        if may_fail(scorer):
            raw = F.nullif(raw, F.lit(float("nan")))
        columns[f"{label}_score"] = F.when(blank, 0.0).otherwise(round_half_even(raw, 4))
        flag = raw >= threshold
        if may_fail(scorer):
            flag = F.coalesce(flag, F.lit(False))
        columns[f"{label}_flagged"] = (~blank & flag).cast("int")
    out = scored.withColumns(columns).drop("_blank")
    return out if keep_raw else out.drop(RAW)


def token_weights(
    df: DataFrame,
    scorer: LexiconScorer,
    label: str = "toxic",
    key_col: str = "doc_id",
    text_col: str = "text",
    special_tokens: Sequence[str] = (),
    top: int = 25,
) -> DataFrame:
    """The strongest tokens of each text: (key, rank, token, weight).

    Negative weights count as 0 and the weights of a text add up to 1 before special
    tokens are dropped. Ties keep text order. Everything happens inside the row, and
    only tokens that carry weight are sorted; the others fill up in text order.
    """
    special = list(special_tokens)
    positive = sorted(t for t, w in scorer.weights[label].items() if w > 0)
    ignored = positive + special + [""]
    words, heavy, kept = F.col("_words"), F.col("_heavy"), F.col("_kept")
    # The first unweighted words lie within this many words from the start.
    reach = F.size("_set_aside") + top
    share = F.when(F.col("_total") > 0, F.col("_token.weight") / F.col("_total"))
    return (
        df.select(
            key_col,
            F.split(F.lower(tx.or_empty(text_col)), tx.NON_WORD_RUN).alias("_words"),
        )
        .withColumn("_set_aside", F.filter(words, lambda w: w.isin(ignored)))
        .withColumns({
            "_heavy": F.filter("_set_aside", lambda w: w.isin(positive)),
            "_light": F.slice(
                F.filter(F.slice(words, F.lit(1), reach), lambda w: ~w.isin(ignored)), 1, top
            ),
        })
        .withColumns({
            "_total": scorer.weight_sum(label, heavy),
            "_kept": F.filter(heavy, lambda w: ~w.isin(special)) if special else heavy,
        })
        .withColumn(
            "_ranked",
            F.array_sort(F.transform(kept, lambda w, i: F.struct(
                (-scorer.weight_of(label, w)).alias("order"), i.alias("at"), w.alias("token"),
            ))),
        )
        .withColumn("_tokens", F.slice(F.concat(
            F.transform("_ranked", lambda t: F.struct(
                t["token"].alias("token"), (-t["order"]).alias("weight"))),
            F.transform("_light", lambda w: F.struct(
                w.alias("token"), F.lit(0.0).alias("weight"))),
        ), 1, top))
        # The outer form: a plain explode adds a filter that repeats all of the above.
        .select(key_col, "_total", F.posexplode_outer("_tokens").alias("_pos", "_token"))
        .filter(F.col("_token").isNotNull())
        .select(
            key_col,
            (F.col("_pos") + 1).alias("rank"),
            F.col("_token.token").alias("token"),
            round_half_even(F.coalesce(share, F.lit(0.0)), 6).alias("weight"),
        )
    )
