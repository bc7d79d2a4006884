import duckdb
import pytest
from pyspark.sql import functions as F

from comity import constants as K
from comity.operators import evaluate, history, reports
from comity.plans.catalog import QUERIES
from tests.compare import difference


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, 1, "first", "Toxic", "text", '{"toxic": 0.5, "threat": 0.9}', "2024-01-01 10:00:00"),
        (2, 1, "second", "toxic", " CSV", '{"toxic": 0.49}', "2024-01-02 10:00:00"),
        (3, 1, "x" * 70, "Non Toxic", None, "{broken", "2024-01-02 11:00:00"),
        (4, 1, "fourth", "Hate Speech", "", '{"toxic": "0.8", "hate_category": "threat"}', "2024-01-03 00:00:00"),
        (5, 2, "other", "Error", "Twitter ", None, "2024-01-03 09:00:00"),
    ]
    return spark.createDataFrame(
        data, "id long, user_id long, input_text string, prediction string, source string, "
        "labels_json string, created_at string",
    ).withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"), "confidence": F.lit(0.9)})


def one(df, user=1):
    return df.filter(F.col("user_id") == user).first().asDict()


def test_owner_stats(rows):
    got = one(reports.owner_stats(rows, "2024-01-02"))
    assert got == {"user_id": 1, "total": 4, "toxic": 2, "non_toxic": 1, "today": 2, "toxicity_rate": 50.0}
    assert one(reports.owner_stats(rows, "2024-01-02"), 2)["toxicity_rate"] == 0.0
    page = one(reports.page_stats(rows))
    assert (page["toxic"], page["non_toxic"]) == (1, 0)


def test_daily_activity_oldest_and_latest(rows):
    def days(**options):
        got = reports.daily_activity(rows.filter("user_id = 1"), **options).collect()
        return sorted((str(r["activity_date"]), r["total"]) for r in got)

    assert days() == [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 1)]
    assert days(days=1) == [("2024-01-01", 1)]
    assert days(days=1, latest=True) == [("2024-01-03", 1)]
    assert days(days=None) == days()


def test_daily_activity_keeps_every_day(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = F.col("ts") + F.make_dt_interval((F.col("event_id") % 70).cast("int"))
    events = events.withColumns({"user_id": F.col("user_id") % 3, "ts": late})
    # One file of that name, for both engines.
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("daily_activity", "daily_activity_all"):
        assert difference(spark, con, str(tmp_path), name) is None
    most = QUERIES["daily_activity_all"](spark, str(tmp_path)).groupBy("user_id").count()
    assert most.agg(F.min("count")).first()[0] > 30


def test_sources_and_channels(rows):
    got = [(r["source"], r["rows"]) for r in reports.source_distribution(rows.filter("user_id = 1")).collect()]
    assert got == [("TEXT", 3), (" CSV", 1)]
    channels = one(reports.channel_counts(rows))
    assert (channels["twitter"], channels["csv"], channels["text"]) == (0, 1, 1)
    assert one(reports.channel_counts(rows), 2)["twitter"] == 1


def test_label_counts_skip_bad_json(rows):
    got = one(reports.label_counts(rows))
    assert (got["toxic"], got["threat"], got["insult"]) == (2, 1, 0)
    assert one(reports.dashboard(rows, "2024-01-02"))["toxic_count"] == 2


def test_listings(rows):
    latest = history.latest_per_owner(rows, 2).filter("user_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in latest] == [4, 3]
    assert latest[1]["preview"] == "x" * 60 + "..."
    assert [r["id"] for r in history.listing(rows).filter("user_id = 1").collect()] == [4, 3, 2, 1]
    assert history.listing(rows).filter("id = 3").first()["labels"] == {}
    assert [r["id"] for r in history.search(rows, text="SEC").collect()] == [2]
    assert [r["id"] for r in history.search(rows, prediction="Toxic", source="csv").collect()] == [2]
    assert history.search(rows).count() == 5
    assert [r["id"] for r in history.page(rows, 2, before_id=4).collect()] == [3, 2]
    assert [r["id"] for r in history.page(rows, 2).collect()] == [5, 4]


def test_summaries(spark):
    scored = spark.createDataFrame(
        [("v", "Toxic", 0.9, "toxic, insult,toxic"), ("v", "Non-Toxic", 0.1, None), ("v", "Error", 0.0, "other")],
        "video_id string, prediction string, toxic double, categories string")
    flags = {"toxic": F.col("toxic") >= 0.5}
    got = reports.comment_summary(scored, flags, "video_id").first()
    assert (got["total_comments"], got["toxic_percentage"], got["toxic_count"]) == (2, 50.0, 1)
    stored = reports.scored_summary(scored).first()
    assert (stored["total_comments"], stored["non_toxic_comments"], stored["toxic_count"],
            stored["insult_count"]) == (3, 2, 2, 1)
    upload = reports.upload_summary(scored, {"toxic": F.col("toxic")}).first()
    assert (upload["errors"], upload["toxic_rate"], upload["toxic_count"]) == (1, 33.3, 1)


def test_empty_tables_give_zero_rates(spark):
    empty = spark.createDataFrame([], "prediction string, categories string, toxic double")
    assert reports.scored_summary(empty).first()["toxic_percentage"] == 0.0
    got = reports.comment_summary(empty, {"toxic": F.col("toxic") >= 0.5}).first()
    assert (got["total_comments"], got["toxic_percentage"]) == (0, 0.0)


def test_loose_summary(spark):
    df = spark.createDataFrame(
        [("toxic", 1.0, "yes"), ("no", 0.2, "0.9"), (None, None, None)],
        "Result string, Obscenity double, `Identity Hate` string")
    got = reports.loose_summary(df).first()
    assert (got["total_comments"], got["toxic_comments"], got["toxic_percentage"]) == (2, 1, 50.0)
    assert (got["obscene_count"], got["identity_hate_count"], got["threat_count"], got["toxic_count"]) == (1, 1, 0, 1)
    by_category = reports.loose_summary(df.select(F.col("Obscenity").alias("Toxicity_x")))
    assert by_category.first()["toxic_comments"] == 0


def test_history_stats(spark):
    df = spark.createDataFrame(
        [(1, "YouTube", "Toxic", '{"toxic": 3, "other": 9}'), (1, "Text", "toxic", None), (1, "Text", "Neither", "bad")],
        "user_id long, analysis_type string, prediction string, category_counts string")
    got = reports.history_stats(df).first()
    assert (got["total"], got["toxic_rows"], got["safe_rows"], got["youtube"], got["toxic"], got["toxic_rate"]) == (
        3, 1, 2, 1, 3, 33.33)


PAIRS = [(0, 0)] * 3 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(1, 0)] * 1


def pairs(spark, data=PAIRS):
    return evaluate.confusion_counts(spark.createDataFrame(data, "label int, prediction int"))


def test_metrics_with_an_absent_class(spark):
    table = {r["class"]: r for r in evaluate.per_class(pairs(spark)).collect()}
    assert (table[0]["precision"], table[0]["recall"]) == (0.75, 0.6)
    assert (table[2]["precision"], table[2]["recall"], table[2]["f1"], table[2]["support"]) == (0, 0, 0, 0)
    got = evaluate.overall(pairs(spark)).first()
    f1 = [2 * 0.75 * 0.6 / 1.35, 2 * (4 / 6) * 0.8 / (4 / 6 + 0.8)]
    assert got["accuracy"] == 0.7
    # Only the two classes that occur enter the macro average here ...
    assert got["f1_macro"] == pytest.approx(sum(f1) / 2)
    report = {r["name"]: r for r in evaluate.report(pairs(spark)).collect()}
    # ... while the report averages over all listed classes.
    assert report["macro avg"]["f1"] == pytest.approx(sum(f1) / 3, abs=1e-4)
    assert report["weighted avg"]["recall"] == 0.7
    assert report["accuracy"]["f1"] == 0.7 and report["accuracy"]["precision"] is None
    matrix = evaluate.confusion_matrix(pairs(spark)).orderBy("actual").collect()
    assert [tuple(r) for r in matrix] == [(0, 3, 2, 0), (1, 1, 4, 0), (2, 0, 0, 0)]
    assert sum(sum(r[1:]) for r in matrix) == len(PAIRS)


def test_auc_against_brute_force(spark):
    data = [(i % 2 if i % 5 else 1, (i * 37 % 11) / 10) for i in range(60)]
    df = spark.createDataFrame(data, "label int, score double")
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluate.roc_auc(df).first()
    assert got["auc"] == pytest.approx(want) and got["positives"] == len(pos)
    assert evaluate.roc_auc(df.filter("label = 1")).first()["auc"] is None


def test_slices_and_examples(spark):
    data = [("a", 1, 1, 0.9), ("a", 0, 1, 0.8), ("b", 0, 0, 0.7), ("b", 1, 0, 0.6), ("b", 1, 0, 0.9)]
    df = spark.createDataFrame(
        [(i, *d) for i, d in enumerate(data)], "doc_id int, lang string, label int, prediction int, confidence double")
    got = {r["lang"]: r for r in evaluate.slices(df, "lang").collect()}
    assert got["a"]["accuracy"] == 0.5 and got["a"]["accuracy_gap"] == pytest.approx(0.1)
    errors = evaluate.error_examples(df, "doc_id", 1).collect()
    assert sorted((r["error_type"], r["doc_id"]) for r in errors) == [
        ("false_negative", 4), ("false_positive", 1)]


def test_multilabel(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, f int")
    table = evaluate.label_pairs(df, {"toxic": F.col("t"), "threat": F.lit(0)},
                                 {"toxic": F.col("f"), "threat": F.col("f")})
    per_label = evaluate.multilabel(evaluate.confusion_counts(table, "label_name"))
    rows = {r["label_name"]: r for r in per_label.collect()}
    assert (rows["toxic"]["tp"], rows["toxic"]["fp"], rows["toxic"]["fn"], rows["toxic"]["tn"]) == (1, 1, 1, 1)
    assert rows["threat"]["precision"] == 0.0 and rows["threat"]["f1"] == 0.0
    averages = evaluate.multilabel_averages(per_label).first()
    assert averages["f1_micro"] == pytest.approx(2 / 6) and averages["f1_macro"] == 0.25
    assert averages["f1_weighted"] == 0.5


def test_auc_of_crowded_scores(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    score = rng.random(20_000) / 5000
    label = (rng.random(20_000) < 0.3 + 500 * score).astype(int)
    score[:50] = score[50:100]
    rows = [("a" if i % 3 else None, int(b), float(s)) for i, (b, s) in enumerate(zip(label, score))]
    rows += [("a", 1, None), ("a", 0, float("nan")), ("b", 1, 0.5)]
    df = spark.createDataFrame(rows, "who string, label int, score double")
    sizes = [r["n"] for r in evaluate.ranged_scores(df, ["who"]).groupBy("who", "part").agg(
        F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 20_000 / 8
    got = {r["who"]: r["auc"] for r in evaluate.roc_auc(df, "who").collect()}
    assert got["b"] is None
    for who in ("a", None):
        mine = [(b, s) for w, b, s in rows if w == who and s is not None and s == s]
        neg = np.sort([s for b, s in mine if not b])
        pos = np.array([s for b, s in mine if b])
        won = (np.searchsorted(neg, pos) + np.searchsorted(neg, pos, "right")).sum() / 2
        assert abs(got[who] - won / len(neg) / len(pos)) < 1e-12


def test_report_counts_every_row_in_its_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (3, 2), (3, 2), (3, 2)], "label int, prediction int")
    rows = {r["name"]: r for r in evaluate.report(evaluate.confusion_counts(df)).collect()}
    assert (rows["accuracy"]["f1"], rows["accuracy"]["support"]) == (0.25, 4)


def test_crossed_slices_are_slices(spark):
    rows = [(i % 2, i % 3 % 2, "x" if i % 4 else None, str(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, prediction int, a string, b string")
    got = evaluate.crossed_slices(df, ["a", "b"]).collect()
    assert {r["slice"] for r in got} == {"a", "b", "a x b"} and len(got) == 2 + 3 + 6
    for r in evaluate.slices(df, "a").collect():
        same = next(g for g in got if g["slice"] == "a" and g["a"] == r["a"])
        assert (same["rows"], same["accuracy"], same["accuracy_gap"]) == (
            r["rows"], r["accuracy"], r["accuracy_gap"])


def test_a_verdict_view_counts_per_video_and_without_one(spark):
    scored = spark.createDataFrame(
        [("v", "a", "Toxic"), ("v", "b", "Toxic"), ("w", "c", "Non-Toxic"), (None, "d", "Toxic")],
        "video_id string, text string, prediction string")
    videos = spark.createDataFrame([("v", "V"), ("v", "W"), (None, "N")], "video_id string, title string")
    got = history.verdict_view(scored, "Toxic", videos).collect()
    assert sorted((r.text, r.total, r.video_title, r.heading) for r in got) == [
        ("a", 2, "V", "Toxic Comments"), ("b", 2, "V", "Toxic Comments"), ("d", 1, None, "Toxic Comments")]
    assert history.verdict_view(scored, "Neither").count() == 0
