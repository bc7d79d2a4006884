"""Casts, rounding, label maps and other value-level helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity import constants as K
from comity.functions.text import or_empty, strip

_INTEGER = r"^[+-]?\d+$"
_NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)$"


def round_half_even(c: Column, digits: int) -> Column:
    """Round the way the results were rounded before: ties go to the even digit."""
    return F.bround(c, digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole * 100``, zero for an empty whole."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(round_half_even(ratio, digits), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_int(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Integer value, 0 for anything that is not one. Fractions are cut, not rounded."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    stripped = strip(c.cast("string"))
    value = F.when(stripped.rlike(_INTEGER), stripped.try_cast("bigint"))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def safe_float(c: Column | str, default: float = 0.0, finite: bool = False) -> Column:
    """Double value or ``default``; ``finite`` also maps NaN and infinities to it."""
    c = F.col(c) if isinstance(c, str) else c
    stripped = strip(c.cast("string"))
    value = F.when(stripped.rlike(_NUMBER), stripped.try_cast("double"))
    if finite:
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        value = F.when(~odd, value)
    return F.coalesce(value, F.lit(float(default)))


def is_positive(c: Column | str, dtype: T.DataType) -> Column:
    """Loose truthiness by declared type: numbers from 0.5 up, or one of a few words."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        present = c.isNotNull() & ~F.isnan(c.cast("double"))
        return F.coalesce(present & (c >= 0.5), F.lit(False))
    return F.lower(strip(or_empty(c))).isin(list(K.POSITIVE_WORDS))


def parse_label_map(labels_json: Column | str) -> Column:
    """JSON text → map of raw strings; malformed text becomes an empty map.

    Values stay strings because one non-numeric value would null a map of doubles.
    """
    c = F.col(labels_json) if isinstance(labels_json, str) else labels_json
    empty = F.create_map().cast("map<string,string>")
    parsed = F.coalesce(F.from_json(c, "map<string,string>"), empty)
    # Of entries with the same key the last one counts, as in other JSON readers.
    entries = F.map_entries(parsed)
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.when(
        F.size(F.array_distinct(F.map_keys(parsed))) == F.size(entries), parsed
    ).otherwise(F.map_from_entries(last))


def label_score(labels: Column, label: str) -> Column:
    """Score of one label in a parsed map, null when absent or not a number."""
    return F.try_element_at(labels, F.lit(label)).try_cast("double")


def canonical_key(key: Column) -> Column:
    """Lower-case, trimmed, with known aliases resolved."""
    plain = F.lower(strip(key))
    chain = F.when(key.isin(list(K.LABELS)), key)
    for alias, label in K.LABEL_ALIASES.items():
        chain = chain.when(plain == alias, label)
    return chain.otherwise(plain)


def underscored_key(key: Column) -> Column:
    """Lower-case, trimmed, with "-" and blanks turned to "_"."""
    odd = F.translate(F.lower(strip(key)), "- ", "__")
    return F.when(key.isin(list(K.LABELS)), key).otherwise(odd)


def with_rekeyed_labels(
    df: DataFrame, name: str, labels: Column, key: Callable[[Column], Column]
) -> DataFrame:
    """Add a map whose keys went through ``key``; of keys that then agree the last wins.

    Built in steps, so that each step is computed once per row.
    """
    entries, keys = F.col("_entries"), F.col("_keys")

    def is_last(_: Column, i: Column) -> Column:
        later = F.slice(keys, i + 2, F.size(keys))
        return ~F.array_contains(later, F.get(keys, i))

    clash = F.size(F.array_distinct(keys)) < F.size(keys)
    return (
        df.withColumn("_entries", F.map_entries(labels))
        .withColumn("_keys", F.transform(entries, lambda e: key(e["key"])))
        .withColumn(
            "_entries",
            F.zip_with(keys, entries, lambda k, e: F.struct(k.alias("key"), e["value"].alias("value"))),
        )
        .withColumn("_entries", F.when(clash, F.filter(entries, is_last)).otherwise(entries))
        .withColumn(name, F.map_from_entries(entries))
        .drop("_entries", "_keys")
    )


def numeric_values(labels: Column) -> Column:
    """All values of a map as doubles, 0 where not numeric."""
    return F.transform(
        F.map_values(labels), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
    )


def six_scores(labels: Column) -> dict[str, Column]:
    """Double scores of the six labels from a map column, 0 when missing."""
    return {
        label: F.coalesce(label_score(labels, label), F.lit(0.0)) for label in K.LABELS
    }


def score_columns(labels=K.LABELS) -> dict[str, Column]:
    """The ``<label>_score`` columns of a scored table."""
    return {label: F.coalesce(F.col(f"{label}_score"), F.lit(0.0)) for label in labels}


def scores_json(scores: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(label) for label, c in scores.items()]))


def split_list(c: Column | str, separator: str = ",") -> Column:
    """Comma-joined text → trimmed, non-empty items."""
    parts = F.split(or_empty(c), separator)
    return F.filter(F.transform(parts, strip), lambda item: item != "")
