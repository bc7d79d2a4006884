import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.functions import values


def apply(spark, fn, rows, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_casts(spark):
    texts = ["12", " 7 ", "12.5", "x", None, "-3", "1.0d", "1e3", "nan", "inf"]
    assert apply(spark, values.safe_int, texts) == [12, 7, 0, 0, 0, -3, 0, 0, 0, 0]
    floats = apply(spark, lambda c: values.safe_float(c, finite=True), texts)
    assert floats == [12.0, 7.0, 12.5, 0.0, 0.0, -3.0, 0.0, 1000.0, 0.0, 0.0]
    loose = apply(spark, values.safe_float, ["inf", "NaN"])
    assert loose[0] == float("inf") and loose[1] != loose[1]
    assert apply(spark, lambda c: values.safe_int(c, T.DoubleType()), [2.9, None], "double") == [2, 0]


def test_positive_goes_by_declared_type(spark):
    assert apply(spark, lambda c: values.is_positive(c, T.StringType()),
                 ["Toxic", " yes ", "0.9", "1", "no", None]) == [True, True, False, True, False, False]
    assert apply(spark, lambda c: values.is_positive(c, T.DoubleType()),
                 [0.5, 0.49, None, float("nan")], "double") == [True, False, False, False]
    assert apply(spark, lambda c: values.is_positive(c, T.BooleanType()),
                 [True, False, None], "boolean") == [True, False, False]


def test_rounding_goes_to_the_even_digit(spark):
    got = apply(spark, lambda c: values.round_half_even(c, 1), [12.25, 12.35, 0.5], "double")
    assert got == [12.2, 12.4, 0.5]


def test_label_maps(spark):
    rows = [
        '{"toxic": 0.5, "hate_category": "threat"}', '{"toxic": "0.7"}', '{"toxic": 0.9', None,
        '{"toxic": "x"}', '{"toxic": null}',
    ]
    score = lambda c: values.label_score(values.parse_label_map(c), "toxic")
    assert apply(spark, score, rows) == [0.5, 0.7, None, None, None, None]


@pytest.mark.parametrize("key,expected", [
    (values.canonical_key, {"identity_hate": "0.2", "severe_toxic": "0.3", "other key": "1"}),
    (values.underscored_key, {"identity_hate": "0.2", "severe_toxic": "0.3", "other_key": "1"}),
])
def test_rekeyed_labels_last_wins(spark, key, expected):
    text = '{"identity-hate": 0.1, "Severe Toxic": 0.3, " Identity Hate ": 0.2, "other key": 1}'
    df = spark.createDataFrame([(text,)], "j string")
    out = values.with_rekeyed_labels(df, "m", values.parse_label_map("j"), key)
    assert out.columns == ["j", "m"]
    assert out.first()["m"] == expected


def test_split_list_and_percent(spark):
    assert apply(spark, values.split_list, ["toxic, insult,,  ", None]) == [["toxic", "insult"], []]
    row = spark.range(1).select(
        values.percent(F.lit(1), F.lit(3), 2), values.percent(F.lit(1), F.lit(0), 2)
    ).first()
    assert tuple(row) == (33.33, 0.0)
