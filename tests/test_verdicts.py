import pytest
from pyspark.sql import functions as F

from comity import constants as K
from comity.operators import verdicts
from comity.operators.scoring import LexiconScorer, ModelScorer, PandasScorer, score_table, token_weights


def judge(spark, policy, *score_rows):
    """Run a policy over rows of six scores given as dicts."""
    rows = [tuple(float(r.get(label, 0.0)) for label in K.LABELS) for r in score_rows]
    df = spark.createDataFrame(rows, ", ".join(f"{label} double" for label in K.LABELS)).coalesce(1)
    scores = {label: F.col(label) for label in K.LABELS}
    return [r[0] for r in df.select(policy(scores).alias("v")).collect()]


def test_any_label_boundary(spark):
    at, below, none = judge(spark, verdicts.any_label, {"insult": 0.5}, {"toxic": 0.4999}, {})
    assert (at["prediction"], at["confidence"]) == ("Toxic", 0.5)
    assert (below["prediction"], below["confidence"]) == ("Non-Toxic", 0.5001)
    assert (none["prediction"], none["confidence"]) == ("Non-Toxic", 1.0)


def test_priority_order_and_thresholds(spark):
    rows = judge(
        spark, verdicts.priority,
        {"threat": 0.9, "identity_hate": 0.3}, {"threat": 0.3, "severe_toxic": 0.8},
        {"severe_toxic": 0.3, "toxic": 0.9}, {"toxic": 0.5, "threat": 0.2999}, {"obscene": 0.49},
    )
    assert [(r["prediction"], r["hate_category"], r["confidence"]) for r in rows] == [
        ("Hate Speech", "identity_hate", 0.3), ("Hate Speech", "threat", 0.3),
        ("Hate Speech", "severe_toxic", 0.3), ("Toxic", None, 0.5), ("Non-Toxic", None, 0.51),
    ]


def test_exclusion_rule_lifts_identity(spark):
    policy = lambda s: verdicts.priority(s, F.lit(True))
    low, high = judge(spark, policy, {"identity_hate": 0.1}, {"identity_hate": 0.99})
    assert (low["prediction"], low["confidence"]) == ("Hate Speech", 0.95)
    assert high["confidence"] == 0.99 and high["identity_hate_score"] == 0.99


def test_three_class(spark):
    rows = judge(
        spark, verdicts.three_class,
        {"threat": 0.6, "toxic": 0.6}, {"threat": 0.6, "toxic": 0.7}, {"toxic": 0.2},
    )
    assert [(r["category"], r["classification_id"], r["confidence"]) for r in rows] == [
        ("Hate Speech", "01", 0.6), ("Offensive Language", "02", 0.7), ("Neither", "03", 0.8),
    ]
    # Flags are independent of the chosen category.
    assert rows[1]["hate_speech"] and rows[1]["offensive_language"] and not rows[1]["neither"]


def test_three_class_from_base(spark):
    def policy(prediction, confidence, category):
        return lambda s: verdicts.three_class_from_base(
            s, F.lit(prediction), F.lit(confidence), F.lit(category).cast("string")
        )

    (hate,) = judge(spark, policy("Hate Speech ", 0.4, "threat"), {"identity_hate": 0.9, "threat": 0.35})
    assert (hate["category"], hate["hate_label"], hate["hate_score"], hate["confidence"]) == (
        "Hate Speech", "threat", 0.35, 0.4)
    (off,) = judge(spark, policy("Toxic", 0.9, None), {"toxic": 0.5, "insult": 0.5, "threat": 0.9})
    assert (off["category"], off["offensive_label"], off["hate_label"]) == (
        "Offensive Language", "toxic", "threat")
    assert not off["hate_speech"]


def test_argmax_ties_and_renormalising(spark):
    df = spark.createDataFrame(
        [(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.0, 0.0, 0.0), (1.0, 1.0, 2.0)],
        "h double, o double, n double",
    ).coalesce(1)
    p = (F.col("h"), F.col("o"), F.col("n"))
    rows = df.select(verdicts.argmax_class(p), *verdicts.renormalised(p)).collect()
    assert [tuple(r) for r in rows] == [
        (0, 0.4, 0.4, 0.2), (1, 0.2, 0.4, 0.4), (0, 0.0, 0.0, 1.0), (2, 0.25, 0.25, 0.5),
    ]


def test_blank_text_is_invalid(spark):
    p = (F.lit(0.2), F.lit(0.3), F.lit(0.5))
    row = spark.range(1).select(verdicts.classify_three(p, F.lit(True)).alias("v")).first()["v"]
    assert row["label"] == "Invalid" and row["class_id"] is None and row["hate_score"] == 0.0


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def test_lexicon_scores_whole_text(spark):
    df = texts(spark, "filler " * 30000 + "IDIOT", "fine", "  ", None)
    rows = score_table(df, LexiconScorer()).orderBy("doc_id").collect()
    assert rows[0]["toxic_flagged"] == 1 and rows[0]["toxic_score"] == 0.6225
    assert rows[1]["toxic_score"] == 0.1192
    for row in rows[2:]:
        assert all(row[f"{label}_score"] == 0.0 for label in K.LABELS)
    with pytest.raises(ValueError):
        score_table(df, LexiconScorer(), "missing")


def test_pandas_scorer_skips_blanks(spark):
    def load():
        import pandas as pd

        def predict(batch):
            assert batch.str.strip().ne("").all()
            return pd.DataFrame({"toxic": batch.str.len() / 100.0})

        return predict

    df = texts(spark, "x" * 50, " ", None, "x" * 49)
    rows = score_table(df, PandasScorer(load, ["toxic"])).orderBy("doc_id").collect()
    assert [(r["toxic_score"], r["toxic_flagged"]) for r in rows] == [
        (0.5, 1), (0.0, 0), (0.0, 0), (0.49, 0)]


def test_model_scorer(spark):
    from comity.operators.training import train_label_models

    rows = [(i, t, y, 1 - y) for i, (t, y) in enumerate([("bad awful word", 1), ("nice kind word", 0)] * 10)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, calm int")
    scorer = train_label_models(df, "text", ["toxic", "calm"], max_iter=5, buckets=256)
    assert isinstance(scorer, ModelScorer)
    scored = score_table(df.drop("toxic", "calm"), scorer).orderBy("doc_id").collect()
    assert [(r["toxic_flagged"], r["calm_flagged"]) for r in scored[:2]] == [(1, 0), (0, 1)]
    assert set(scored[0].asDict()) == {
        "doc_id", "text", "toxic_score", "toxic_flagged", "calm_score", "calm_flagged"}


def test_token_weights_against_brute_force(spark):
    text = "you idiot A stupid b trash you idiot " + " ".join(f"w{i}" for i in range(40))
    got = token_weights(texts(spark, text, "..."), LexiconScorer(), special_tokens=("you", "trash"))
    rows = sorted((r["rank"], r["token"], r["weight"]) for r in got.collect())
    table = K.LEXICON["toxic"]
    words = [w.lower() for w in text.split()]
    total = sum(table.get(w, 0.0) for w in words)
    kept = [(w, table.get(w, 0.0) / total) for w in words if w not in ("you", "trash")]
    want = sorted(kept, key=lambda x: -x[1])[:25]
    assert rows == [(i + 1, w, round(x, 6)) for i, (w, x) in enumerate(want)]


def test_bulk_path_scores_translations(spark):
    rows = [(1, " du  idiot ", "de", None), (2, "tu es bête toi", "fr", "you moron"),
            (3, "  ", "en", "moron"), (4, "all is well here", None, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, en string")
    got = verdicts.score_and_judge(df, lang_col="lang", translated_col="en").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["language"], r["prediction"]) for r in got] == [
        (1, "du idiot", "en", "Toxic"), (2, "tu es bête toi", "fr", "Toxic"),
        (4, "all is well here", "en", "Non-Toxic")]
    assert "_scored_text" not in got[0].asDict()
