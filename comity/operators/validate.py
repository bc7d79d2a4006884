"""Validation of training tables and of texts sent for prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions.text import strip


def validation_report(
    df: DataFrame, text_col: str = "text", labels: Sequence[str] = K.TRAINING_LABELS
) -> DataFrame:
    """One row of counts: missing texts, and values other than 0/1 per label."""
    missing = [c for c in (text_col, *labels) if c not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    bad = [
        F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(f"bad_{c}")
        for c in labels
    ]
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(text_col).isNull()).alias("null_text"),
        *bad,
    )


def validate_training(
    df: DataFrame, text_col: str = "text", labels: Sequence[str] = K.TRAINING_LABELS
) -> None:
    """Raise on the first problem found: null texts, then bad labels in order."""
    report = validation_report(df, text_col, labels).first()
    if report["null_text"]:
        raise ValueError(f"column {text_col!r} holds {report['null_text']} nulls")
    for label in labels:
        if report[f"bad_{label}"]:
            raise ValueError(f"column {label!r} must hold only 0 and 1")


def check_texts(
    df: DataFrame, text_col: str = "text", max_chars: int = K.MAX_PREDICTION_CHARS
) -> DataFrame:
    """Strip the text and add ``reject_reason``: null for texts that may be scored."""
    stripped = strip(text_col)
    reason = (
        F.when(F.col(text_col).isNull(), "not a string")
        .when(stripped == "", "empty")
        .when(F.length(stripped) > max_chars, "too long")
    )
    return df.withColumns({"reject_reason": reason, "valid_text": stripped})


def valid_texts(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected_texts(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())
