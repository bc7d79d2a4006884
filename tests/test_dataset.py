import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from comity.operators import dataset, history
from comity.plans import flows


def labelled(spark, n=400):
    rows = [(i, 0 if i % 9 == 0 else 1 if i % 3 == 0 else 2, f"text {i % 350}") for i in range(n)]
    return spark.createDataFrame(rows, "row_key long, class int, tweet string")


def test_keep_first_with_a_hot_text(spark):
    rows = [(i, i % 3, "hot") for i in range(300)] + [(1000 - i, i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "row_key long, class int, tweet string").repartition(7)
    kept = {r["tweet"]: (r["row_key"], r["class"]) for r in dataset.keep_first(df, "tweet", "row_key").collect()}
    assert kept["hot"] == (0, 0) and len(kept) == 51
    report = dataset.dedupe_report(df, "tweet").first()
    assert tuple(report) == (350, 51, 299)


def brute_split(rows):
    by_class = defaultdict(list)
    for key, cls in rows:
        by_class[cls].append((hashlib.md5(f"42:{key}".encode()).hexdigest(), key))
    out = {}
    for members in by_class.values():
        members.sort()
        n = len(members)
        held = math.ceil(n * 0.2)
        for i, (_, key) in enumerate(members):
            out[key] = "train" if i < n - held else "val" if i < n - held + held // 2 else "test"
    return out


@pytest.mark.parametrize("n", [1, 2, 11, 400, 3000])
def test_split_equals_brute_force(spark, n):
    df = labelled(spark, n)
    want = brute_split([(r["row_key"], r["class"]) for r in df.collect()])
    got = {r["row_key"]: r["split"] for r in dataset.stratified_split(df).collect()}
    assert got == want


def test_split_is_disjoint_and_leak_free_after_dedupe(spark):
    split = dataset.stratified_split(dataset.keep_first(labelled(spark), "tweet", "row_key"))
    assert tuple(dataset.split_overlap(split).first()) == (0, 0, 0)
    assert sum(r["rows"] for r in dataset.split_sizes(split).collect()) == 350


def test_overlap_counts_distinct_texts(spark):
    df = spark.createDataFrame(
        [("a", "train"), ("a", "train"), ("a", "val"), ("a", "test"), ("b", "train"), ("b", "test"), ("c", "val")],
        "tweet string, split string")
    assert dataset.split_overlap(df).first().asDict() == {"train_val": 1, "train_test": 2, "val_test": 1}


def test_cleaning_report(spark):
    texts = ["see http://a.b", "www.x", "@me", "RT x", "art", "", " ", "dup", "dup", None]
    df = spark.createDataFrame([(t,) for t in texts], "tweet string")
    assert dataset.cleaning_report(df).first().asDict() == {
        "urls": 2, "mentions": 1, "retweets": 1, "empty": 3, "duplicates": 1}


def test_clean_labelled(spark):
    df = spark.createDataFrame(
        [(1, "2", "RT @a: hi"), (2, "1", None), (3, "0", "@b"), (4, "1", "a&amp;b")],
        "row_key long, class string, tweet string")
    rows = dataset.clean_labelled(df).orderBy("row_key").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "hi"), (4, 1, "a&b")]


def test_weights_count_absent_classes_as_one(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(2,)] * 6, "class int")
    rows = {r["class"]: (r["rows"], r["weight"]) for r in dataset.class_weights(df).collect()}
    assert rows == {0: (3, 1.0), 1: (0, 3.0), 2: (6, 0.5)}
    dist = {r["class"]: r["rows"] for r in dataset.class_distribution(df).collect()}
    assert dist == {0: 3, 1: 0, 2: 6}
    assert {r["class"]: r["rows"] for r in dataset.class_distribution(df, classes=None).collect()} == {0: 3, 2: 6}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_numbering_does_not_depend_on_the_block_size(spark, block):
    rows = [("hot", p * 2 + 1) for p in range(40)] + [("b", 5), ("b", -2), ("c", 7)]
    df = spark.createDataFrame(rows, "video_id string, position long").repartition(5)
    got = {(r["video_id"], r["position"]): r["row_number"]
           for r in history.number_rows(df, ["video_id"], "position", block).collect()}
    want = {}
    for video in ("hot", "b", "c"):
        for i, p in enumerate(sorted(p for v, p in rows if v == video)):
            want[(video, p)] = i + 1
    assert got == want


def test_preparation_and_training_flow(spark, tmp_path):
    words = {0: "awful scum words", 1: "silly idiot talk", 2: "lovely calm day"}
    rows = [(i, i % 3, f"RT @u{i}: {words[i % 3]} number{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "row_key long, class int, tweet string")
    split = flows.prepare_dataset(df, str(tmp_path / "deduped"))
    assert Counter(r["split"] for r in split.collect()) == {"train": 120, "val": 15, "test": 15}
    model, metrics, counts = flows.train_and_evaluate(
        split, reg_params=(0.01, 0.1), max_iter=5, buckets=1 << 10)
    assert metrics.filter("selected").count() == 1
    assert counts.filter("actual = predicted").agg(F.sum("n")).first()[0] == 15


def test_split_keeps_rows_of_every_class_and_null(spark):
    rows = [(i, [0, 1, 2, 3, None][i % 5], f"t{i}") for i in range(200)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "row_key long, class int, tweet string")
    got = dataset.stratified_split(df).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, rows))
    for c in (0, 2, 3, None):
        parts = [r["split"] for r in got if r["class"] == c]
        assert [parts.count(s) for s in dataset.SPLITS] == [32, 4, 4]
    with pytest.raises(ValueError):
        dataset.stratified_split(spark.range(1001).selectExpr("id AS class", "id AS row_key"))


def test_keep_first_keeps_whole_rows(spark):
    rows = [(None, "t", "A", 1), (None, "u", "B", 2), (5, "u", "C", 3), (5, "u", "D", None),
            (7, "u", "E", 5), (1, None, "F", 6), (0, None, "G", 7), (9, "", "H", 8),
            *[(3, "copy", "I", 9)] * 5]
    df = spark.createDataFrame(rows, "row_key long, tweet string, x string, y int")
    kept = {r["tweet"]: tuple(r) for r in dataset.keep_first(df.repartition(4), "tweet", "row_key").collect()}
    assert len(kept) == 5 and all(r in rows for r in kept.values())
    assert kept["t"] == (None, "t", "A", 1) and kept[None] == (0, None, "G", 7)
    assert kept["u"][0] == 5 and kept["copy"] == (3, "copy", "I", 9)
    # No text takes part in the search for the least key.
    plan = dataset.keep_first(df, "tweet", "row_key")._jdf.queryExecution().executedPlan().toString()
    least = [line for line in plan.splitlines() if "min(" in line]
    assert least and not any("tweet" in line for line in least)
    only = dataset.keep_first(df.select("tweet", "row_key"), "tweet", "row_key")
    assert only.count() == 5 and only.columns == ["tweet", "row_key"]
    assert dataset.keep_first(df.limit(0), "tweet", "row_key").count() == 0
