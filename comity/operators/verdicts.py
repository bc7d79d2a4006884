"""Verdict policies: scores in, one struct column out. No policy needs a shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions import rules
from comity.functions import text as tx
from comity.functions.values import clamp, round_half_even, score_columns
from comity.operators.scoring import LexiconScorer, failed, may_fail, score_table

Scores = Mapping[str, Column]


def highest(scores: Scores, labels=None) -> Column:
    """Largest score; missing and NaN scores do not count, and none at all gives 0."""
    picked = [F.nullif(scores[label].cast("double"), F.lit(float("nan")))
              for label in (labels or scores)]
    top = picked[0] if len(picked) == 1 else F.greatest(*picked)
    return F.coalesce(top, F.lit(0.0))


def strongest_label(scores: Scores, labels) -> Column:
    """Label with the largest score; ties go to the first in the given order."""
    top = highest(scores, labels)
    chain = F.when(scores[labels[0]] == top, labels[0])
    for label in labels[1:]:
        chain = chain.when(scores[label] == top, label)
    return F.coalesce(chain, F.lit(labels[0]))


def any_label(
    scores: Scores,
    threshold: float = K.LABEL_THRESHOLD,
    blank: Column | None = None,
    failed: Column | None = None,
) -> Column:
    """Toxic when any label reaches the threshold. A blank text is Non-Toxic with 0.

    Rows that ``failed`` to be scored are "Error" with confidence 0.
    """
    top = highest(scores)
    toxic = top >= threshold
    prediction = F.when(toxic, "Toxic").otherwise("Non-Toxic")
    confidence = round_half_even(F.when(toxic, top).otherwise(1.0 - top), 4)
    if failed is not None:
        prediction = F.when(failed, K.FAILED).otherwise(prediction)
        confidence = F.when(failed, 0.0).otherwise(confidence)
    if blank is not None:
        if failed is not None:
            prediction = F.when(blank, "Non-Toxic").otherwise(prediction)
        confidence = F.when(blank, 0.0).otherwise(confidence)
    return F.struct(prediction.alias("prediction"), confidence.alias("confidence"))


def any_label_percent(raw: Scores, threshold: float = K.LABEL_THRESHOLD) -> Column:
    """Percentages per label plus an overall flag, from unrounded probabilities."""
    fields = [round_half_even(c * 100, 2).alias(f"{label}_percent") for label, c in raw.items()]
    return F.struct((highest(raw) >= threshold).alias("overall_toxic"), *fields)


def primary_label(
    scores: Scores, flagged: Mapping[str, Column], primary: str = "toxic"
) -> Column:
    """Only one label decides; the flagged labels are listed in label order."""
    score, toxic = scores[primary], flagged[primary] == 1
    names = F.array(*[F.when(flag == 1, F.lit(label)) for label, flag in flagged.items()])
    percent = round_half_even(score * 100, 2)
    return F.struct(
        F.when(toxic, "Toxic").otherwise("Non-Toxic").alias("prediction"),
        F.when(toxic, percent)
        .otherwise(round_half_even((1 - score) * 100, 2)).alias("confidence"),
        percent.alias("toxic_score"),
        F.array_compact(names).alias("categories"),
    )


def priority(
    scores: Scores,
    exclusion_rule: Column | None = None,
    hate_threshold: float = K.HATE_THRESHOLD,
    offensive_threshold: float = K.OFFENSIVE_THRESHOLD,
) -> Column:
    """Hate labels first, in fixed order and at a low threshold; then offensive ones.

    A firing group-exclusion rule lifts the identity score to at least 0.95.
    """
    identity = scores["identity_hate"]
    if exclusion_rule is not None:
        lifted = F.greatest(identity, F.lit(K.EXCLUSION_RULE_SCORE))
        identity = F.when(exclusion_rule, lifted).otherwise(identity)
    ordered = {**scores, "identity_hate": identity}
    offensive = highest(scores, K.OFFENSIVE_LABELS)

    category, confidence = None, None
    for label in K.HATE_LABELS:
        hit = ordered[label] >= hate_threshold
        category = F.when(hit, label) if category is None else category.when(hit, label)
        confidence = (
            F.when(hit, ordered[label]) if confidence is None
            else confidence.when(hit, ordered[label])
        )
    toxic = offensive >= offensive_threshold
    return F.struct(
        F.when(category.isNotNull(), "Hate Speech")
        .when(toxic, "Toxic").otherwise("Non-Toxic").alias("prediction"),
        round_half_even(
            confidence.when(toxic, offensive).otherwise(1.0 - highest(scores)), 4
        ).alias("confidence"),
        category.alias("hate_category"),
        round_half_even(identity, 4).alias("identity_hate_score"),
        round_half_even(highest(ordered, K.HATE_LABELS), 4).alias("hate_speech_score"),
        round_half_even(offensive, 4).alias("offensive_score"),
    )


def _neither(hate: Column, offensive: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.greatest(hate, offensive))


def three_class(scores: Scores, overall: Column | None = None) -> Column:
    """Six labels → three classes; hate must also beat the offensive group.

    ``overall`` is the largest score of all labels given, known or not.
    """
    hate, offensive = highest(scores, K.HATE_LABELS), highest(scores, K.OFFENSIVE_LABELS)
    overall = highest(scores) if overall is None else overall
    hate_on, offensive_on = hate >= K.LABEL_THRESHOLD, offensive >= K.LABEL_THRESHOLD
    is_hate = hate_on & (hate >= offensive)
    confidence = (
        F.when(is_hate, hate).when(offensive_on, offensive)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - overall))
    )
    return F.struct(
        _by_class(is_hate, offensive_on, K.CLASS_NAMES).alias("category"),
        _by_class(is_hate, offensive_on, K.CLASS_IDS).alias("classification_id"),
        round_half_even(confidence, 4).alias("confidence"),
        hate_on.alias("hate_speech"),
        offensive_on.alias("offensive_language"),
        (~hate_on & ~offensive_on).alias("neither"),
        round_half_even(hate, 4).alias("hate_score"),
        round_half_even(offensive, 4).alias("offensive_score"),
        round_half_even(_neither(hate, offensive), 4).alias("neither_score"),
    )


def three_class_from_base(
    scores: Scores,
    base_prediction: Column,
    base_confidence: Column,
    base_category: Column,
    base_hate: Column | None = None,
    offensive_threshold: float = K.OFFENSIVE_THRESHOLD,
) -> Column:
    """Three classes where an earlier hate verdict is authoritative."""
    hate_verdict = F.lower(tx.strip(tx.or_empty(base_prediction))) == "hate speech"
    if base_hate is not None:
        hate_verdict = hate_verdict | F.coalesce(base_hate, F.lit(False))
    named = F.nullif(F.lower(tx.strip(base_category)), F.lit(""))
    named = F.when(hate_verdict, named)

    hate = highest(scores, K.HATE_LABELS)
    for label in K.HATE_LABELS:
        hate = F.when(named == label, scores[label]).otherwise(hate)
    hate_label = F.coalesce(named, strongest_label(scores, K.HATE_LABELS))
    offensive = highest(scores, K.OFFENSIVE_LABELS)
    is_offensive = ~hate_verdict & (offensive >= offensive_threshold)
    confidence = (
        F.when(hate_verdict, F.greatest(hate, F.coalesce(base_confidence, F.lit(0.0))))
        .when(is_offensive, offensive)
        .otherwise(_neither(hate, offensive))
    )
    return F.struct(
        _by_class(hate_verdict, is_offensive, K.CLASS_NAMES).alias("category"),
        _by_class(hate_verdict, is_offensive, K.CLASS_IDS).alias("classification_id"),
        round_half_even(confidence, 4).alias("confidence"),
        hate_verdict.alias("hate_speech"),
        is_offensive.alias("offensive_language"),
        (~hate_verdict & ~is_offensive).alias("neither"),
        round_half_even(hate, 4).alias("hate_score"),
        round_half_even(offensive, 4).alias("offensive_score"),
        round_half_even(_neither(hate, offensive), 4).alias("neither_score"),
        hate_label.alias("hate_label"),
        strongest_label(scores, K.OFFENSIVE_LABELS).alias("offensive_label"),
    )


def _by_class(hate: Column, offensive: Column, names: Mapping[int, str]) -> Column:
    return F.when(hate, names[0]).when(offensive, names[1]).otherwise(names[2])


def softmax(logits: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    top = F.greatest(*logits)
    parts = [F.exp(logit - top) for logit in logits]
    total = parts[0] + parts[1] + parts[2]
    return tuple(p / total for p in parts)


def argmax_class(probabilities: tuple[Column, Column, Column]) -> Column:
    """0, 1 or 2; ties go to the lowest class."""
    hate, offensive, neither = probabilities
    return (
        F.when((hate >= offensive) & (hate >= neither), 0)
        .when(offensive >= neither, 1)
        .otherwise(2)
    )


def renormalised(probabilities: tuple[Column, Column, Column]):
    """Scale to a sum of 1; an all-zero vector becomes (0, 0, 1)."""
    total = probabilities[0] + probabilities[1] + probabilities[2]
    return tuple(
        F.when(total > 0, p / total).otherwise(float(cls == 2))
        for cls, p in enumerate(probabilities)
    )


def class_value(cls: Column, values) -> Column:
    return F.when(cls == 0, values[0]).when(cls == 1, values[1]).otherwise(values[2])


def classify_three(
    probabilities: tuple[Column, Column, Column], blank: Column
) -> Column:
    """Plain arg-max over class probabilities; blank texts are Invalid with zeros."""
    cls = F.when(~blank, argmax_class(probabilities))
    scores = [F.when(blank, 0.0).otherwise(p) for p in probabilities]
    names = class_value(cls, [F.lit(K.CLASS_NAMES[c]) for c in K.CLASSES])
    confidence = F.when(blank, 0.0).otherwise(class_value(cls, scores))
    return F.struct(
        cls.alias("class_id"),
        F.when(blank, "Invalid").otherwise(names).alias("label"),
        round_half_even(confidence, 6).alias("confidence"),
        *[
            round_half_even(s, 6).alias(name)
            for s, name in zip(scores, ("hate_score", "offensive_score", "neither_score"))
        ],
    )


def classify_tweets(
    df: DataFrame,
    scorer: LexiconScorer | None = None,
    text_col: str = "text",
    probabilities: tuple[str, str, str] | None = None,
    method_name: str = "Classifier model",
) -> DataFrame:
    """Model class plus ordered linguistic rules, for every usable text.

    Texts that are blank after normalisation get no result, so they are left out. The
    class probabilities come from the scorer, or from three columns already present.
    One split of the text serves the scorer and all rules.
    """
    scorer = scorer or LexiconScorer()
    vocabulary = rules.RULE_VOCABULARY | scorer.vocabulary
    base = (
        df.filter(~tx.is_blank_normalized(text_col))
        .withColumn("cleaned_text", tx.normalize_text(text_col))
        .withColumn("_words", tx.words_in("cleaned_text", vocabulary))
    )
    if probabilities is None:
        base = base.withColumn(
            "_logits", F.struct(*[
                logit.alias(name)
                for logit, name in zip(scorer.class_logits(F.col("_words")), "hon")
            ])
        )
        p = softmax(tuple(F.col("_logits")[name] for name in "hon"))
    else:
        p = tuple(F.col(name) for name in probabilities)
    scored = base.withColumn(
        "_p", F.struct(*[c.alias(name) for c, name in zip(p, "hon")])
    ).withColumn("_rule", rules.first_rule("cleaned_text", F.col("_words")))

    p = tuple(F.col("_p")[name] for name in "hon")
    rule, model_class, final_class = (F.col(c) for c in ("_rule", "model_class", "final_class"))
    classed = scored.withColumn("model_class", argmax_class(p)).withColumn(
        "final_class",
        F.when(rule == K.RULE_IDENTITY, 0).when(rule.isNotNull(), 1).otherwise(model_class),
    )
    refined = final_class != model_class
    floor = F.lit(K.REFINED_CONFIDENCE_FLOOR)
    judged = classed.withColumn(
        "_confidence",
        F.when(refined, F.greatest(class_value(final_class, p), floor))
        .otherwise(class_value(model_class, p)),
    )
    confidence = F.when(F.isnan("_confidence"), 0.0).otherwise(F.col("_confidence"))
    confidence = clamp(confidence, 0.0, 1.0)
    hate, offensive, neither = renormalised(p)
    names = [F.lit(K.CLASS_NAMES[c]) for c in K.CLASSES]
    ids = [F.lit(K.CLASS_IDS[c]) for c in K.CLASSES]
    return judged.withColumns({
        "model_prediction": class_value(model_class, names),
        "prediction": class_value(final_class, names),
        "classification_id": class_value(final_class, ids),
        "toxicity": F.when(final_class < 2, "Toxic").otherwise("Non-Toxic"),
        "confidence": round_half_even(confidence, 6),
        "confidence_percentage": round_half_even(confidence * 100, 2),
        "model_confidence": round_half_even(class_value(model_class, p), 6),
        "hate_score": round_half_even(hate, 6),
        "offensive_score": round_half_even(offensive, 6),
        "neither_score": round_half_even(neither, 6),
        "refinement_applied": refined,
        "classification_method": F.coalesce(rule, F.lit(method_name)),
    }).drop("_words", "_logits", "_p", "_rule", "_confidence")


def tweet_history(classified: DataFrame, text_col: str = "text") -> DataFrame:
    """Classified tweets in the shape of history rows, source ``twitter``."""
    labels = F.to_json(F.struct(
        F.col("hate_score").alias("twitter_hate_speech"),
        F.col("offensive_score").alias("twitter_offensive_language"),
        F.col("neither_score").alias("twitter_neither"),
    ))
    model_score = class_value(
        F.col("model_class"),
        [F.col("hate_score"), F.col("offensive_score"), F.col("neither_score")],
    )
    return classified.withColumns({
        "input_text": F.col(text_col),
        "language": F.lit("en"),
        "translated_text": F.col(text_col),
        "labels_json": labels,
        "source": F.lit("twitter"),
        "model_confidence": model_score,
    })


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Compute these columns at this point of the plan.

    A filter on a computed column is otherwise pushed below it, with the whole
    computation copied into the filter and run a second time. Use this where freshly
    scored rows are filtered by their result; a stored table needs no such mark.
    """
    here = F.spark_partition_id() >= 0
    return df.withColumns({name: F.when(here, F.col(name)) for name in names})


def with_verdict(df: DataFrame, verdict: Column) -> DataFrame:
    """Unpack a policy's struct into columns, replacing columns of the same name."""
    staged = df.withColumn("_verdict", verdict)
    names = staged.schema["_verdict"].dataType.fieldNames()
    return staged.withColumns({n: F.col("_verdict")[n] for n in names}).drop("_verdict")


def score_and_judge(
    df: DataFrame,
    scorer=None,
    text_col: str = "text",
    lang_col: str | None = None,
    translated_col: str | None = None,
) -> DataFrame:
    """The bulk path: drop blanks, clean, score the labels, apply the any-label policy.

    With ``translated_col`` the translation is scored where there is one. A scorer that
    does not care about spacing reads the text as it came, so a plan that drops the
    text never cleans it. Rows that the scorer failed on are judged "Error".
    """
    scorer = scorer or LexiconScorer()
    rows = df.filter(~tx.is_blank(text_col))
    if lang_col:
        rows = rows.withColumn("language", tx.resolve_language(text_col, lang_col))
    cleaned = tx.clean_text(text_col)
    source = F.col(text_col) if getattr(scorer, "ignores_spacing", False) else cleaned
    if translated_col:
        translated = F.nullif(tx.clean_text(translated_col), F.lit(""))
        source = F.coalesce(translated, source)
    scored = score_table(rows.withColumn("_scored_text", source), scorer, "_scored_text")
    unscored = None
    if may_fail(scorer):
        unscored = failed([F.col(f"{label}_score") for label in scorer.labels])
    judged = with_verdict(scored, any_label(score_columns(scorer.labels), failed=unscored))
    return judged.withColumn(text_col, cleaned).drop("_scored_text")
