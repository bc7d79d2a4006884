import json

import pytest
from pyspark.sql import functions as F

from comity import constants as K
from comity.operators import history, validate
from comity.plans import flows
from comity.sources import readers, sinks, threads
from comity.sources.history_table import HistoryTable


def test_csv_round_trip_keeps_quotes_and_lines(spark, tmp_path):
    rows = [("a \"quoted\" word", 1), ("two\nlines, comma", 2), ("plain", 3)]
    df = spark.createDataFrame(rows, "text string, n int")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = readers.read_comments_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_empty_csv_gives_no_rows(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("text,class\n")
    assert readers.read_comments_csv(spark, str(path)).count() == 0


def test_encoding_fallback(spark, tmp_path):
    latin, utf8 = tmp_path / "latin.csv", tmp_path / "utf8.csv"
    latin.write_bytes("text\ncafé\n".encode("latin-1"))
    utf8.write_bytes("text\ncafé\n".encode("utf-8"))
    for path in (latin, utf8):
        df = readers.read_comments_csv_any_encoding(spark, str(path))
        assert [r["text"] for r in df.collect()] == ["café"]


def test_column_resolution():
    assert readers.pick_text_column(["id", "Comment", "comment"]) == "comment"
    assert readers.pick_text_column(["id", "TEXT"]) == "id"
    assert readers.find_column([" Label ", "x"], ["prediction", "label"]) == " Label "
    assert readers.find_prediction_column(["Classification", "Result"]) == "Result"
    assert readers.find_category_column(["Identity Hate"], "identity_hate") == "Identity Hate"
    assert readers.find_category_column(["x"], "toxic") is None


def test_normalize_export_never_invents_labels(spark):
    df = spark.createDataFrame([("a", "1", 0.0)], "body string, tox string, ins double")
    out = readers.normalize_export(df, "body", {"toxicity": "tox", "insult": "ins"}, "youtube")
    assert tuple(out.first()) == ("a", 1, 0, "youtube")
    with pytest.raises(ValueError, match="threat"):
        readers.normalize_export(df, "body", {"threat": "threat"})
    with pytest.raises(Exception):
        readers.merge_sources(out, out.drop("insult")).collect()


def comment(key, text=None, author=None, parent=None):
    snippet = {"textDisplay": text, "authorDisplayName": author, "parentId": parent}
    return {"id": key, "snippet": {k: v for k, v in snippet.items() if v is not None}}


PAGES = [
    {"items": [
        {"snippet": {"topLevelComment": comment("c1", " top ", "ann"), "totalReplyCount": 2},
         "replies": {"comments": [comment("r1", "one", "bob", "c1"), comment("r2", parent="c1")]}},
        {"snippet": {"topLevelComment": comment("c2"), "totalReplyCount": 0},
         "replies": {"comments": [comment("r3", "hidden", "cy", "c2")]}},
    ], "nextPageToken": "t"},
    {"items": []},
    {},
]


@pytest.fixture
def pages(spark, tmp_path):
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(p) for p in PAGES))
    return threads.read_pages(spark, str(path)).withColumn("video_id", F.lit("v"))


def test_flatten_threads(pages):
    rows = {r["comment_id"]: r for r in threads.flatten_threads(pages, "video_id").collect()}
    assert set(rows) == {"c1", "r1", "r2", "c2", "r3"}
    assert rows["c1"]["parent_id"] is None and not rows["c1"]["is_reply"]
    assert rows["r1"]["parent_id"] == "c1" and rows["r1"]["is_reply"]
    assert (rows["r2"]["author"], rows["r2"]["text"]) == ("Unknown", "")
    assert (rows["c2"]["author"], rows["c2"]["text"]) == ("Unknown", "")


def test_thread_shapes(pages):
    flat = threads.flatten_threads(pages, "video_id")
    typed = {r["comment_id"]: r for r in threads.typed_comments(flat).collect()}
    assert set(typed) == {"c1", "r1", "r3"}
    assert typed["c1"]["text"] == "top" and typed["c1"]["comment_type"] == "top_level"
    assert typed["r1"]["comment_type"] == "reply"
    fetched = threads.flatten_threads(pages, "video_id", fetched_only=True)
    sources = [r["source"] for r in threads.collected_comments(fetched).collect()]
    assert sorted(sources) == ["youtube", "youtube", "youtube_reply", "youtube_reply"]
    assert threads.flatten_threads(pages, include_replies=False).count() == 2


def test_video_info(spark):
    body = {"items": [{"snippet": {"title": "T"}, "statistics": {"viewCount": "12"}}]}
    df = spark.createDataFrame(
        [("a", json.dumps(body)), ("b", '{"items": []}'), ("c", "{}")], "video_id string, j string"
    )
    assert [tuple(r) for r in threads.video_info(df, "j").collect()] == [
        ("a", "T", "", "", 12, 0, 0)]


def history_frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, user_id long, text string, prediction string, day string")
    return df.withColumns({
        "language": F.lit(None).cast("string"), "confidence": F.lit(0.5),
        "labels_json": F.lit("{}"), "created_at": F.col("day").cast("timestamp_ntz"),
    })


def test_history_sink_drops_failed_rows_and_partitions_by_day(spark, tmp_path):
    rows = [(1, 1, "a", "Toxic", "2024-01-01"), (2, 1, "b", "Error", "2024-01-01"),
            (3, 2, "c", "Model Unavailable", "2024-01-02"), (4, 2, "d", None, "2024-01-02")]
    kept = sinks.history_rows(history_frame(spark, rows), "csv")
    path = str(tmp_path / "history")
    sinks.append_history(kept, path)
    sinks.append_history(kept, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert {(r["id"], r["prediction"], r["language"]) for r in back.collect()} == {
        (1, "Toxic", "en"), (4, "Unknown", "en")}
    assert {str(r["created_date"]) for r in back.collect()} == {"2024-01-01", "2024-01-02"}


def test_rerunning_a_run_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([(1,), (2,)], "n int")
    sinks.write_run(first, path, "r1")
    sinks.write_run(first, path, "r2")
    sinks.write_run(first.filter("n = 1"), path, "r1")
    rows = sorted((r["run_id"], r["n"]) for r in spark.read.parquet(path).collect())
    assert rows == [("r1", 1), ("r2", 1), ("r2", 2)]


def test_erasure_is_limited_to_the_owner(spark, tmp_path):
    rows = [(1, 1, "a", "Toxic", "2024-01-01"), (1, 2, "b", "Toxic", "2024-01-01"),
            (2, 1, "c", "Toxic", "2024-01-02")]
    path, out = str(tmp_path / "h"), str(tmp_path / "h2")
    sinks.append_history(sinks.history_rows(history_frame(spark, rows), "text"), path)
    item = spark.createDataFrame([(1, 1), (1, 1)], "user_id long, id long")
    sinks.erase_to(spark, path, out, item, ["user_id", "id"])
    left = {(r["id"], r["user_id"]) for r in spark.read.parquet(out).collect()}
    assert left == {(1, 2), (2, 1)}
    user = spark.createDataFrame([(1,)], "user_id long")
    gone = sinks.erase(spark.read.parquet(path), user, ["user_id"])
    assert [(r["id"], r["user_id"]) for r in gone.collect()] == [(1, 2)]


def test_erasure_in_place_rewrites_only_touched_days(spark, tmp_path):
    rows = [(1, 1, "a", "Toxic", "2024-01-01"), (2, 2, "b", "Toxic", "2024-01-01"),
            (3, 1, "c", "Toxic", "2024-01-02"), (4, 2, "d", "Toxic", "2024-01-03")]
    path = str(tmp_path / "h")
    sinks.append_history(sinks.history_rows(history_frame(spark, rows), "text"), path)

    def files(day):
        return {f.name for f in (tmp_path / "h" / f"created_date={day}").glob("*.parquet")}

    untouched = files("2024-01-03")
    user = spark.createDataFrame([(1,)], "user_id long")
    for _ in range(2):
        sinks.erase_days(spark, path, user, ["user_id"])
        left = spark.read.parquet(path).collect()
        assert {(r["id"], r["user_id"], str(r["created_date"])) for r in left} == {
            (2, 2, "2024-01-01"), (4, 2, "2024-01-03")}
    assert files("2024-01-03") == untouched and not files("2024-01-02")


def test_validators(spark):
    good = spark.createDataFrame([("a", 0, 1, 0, 1)], "text string, " + ", ".join(
        f"{c} int" for c in K.TRAINING_LABELS))
    validate.validate_training(good)
    with pytest.raises(ValueError, match="missing required columns: threat"):
        validate.validate_training(good.drop("threat"))
    with pytest.raises(ValueError, match="nulls"):
        validate.validate_training(good.withColumn("text", F.lit(None).cast("string")))
    for bad in (F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(ValueError, match="insult"):
            validate.validate_training(good.withColumn("insult", bad))
    texts = spark.createDataFrame(
        [("  x ",), (None,), (" \n",), ("y" * 10001,), ("z" * 10000 + " ",)], "text string")
    checked = validate.check_texts(texts)
    assert [r["reject_reason"] for r in checked.collect()] == [
        None, "not a string", "empty", "too long", None]
    assert validate.valid_texts(checked).count() == 2
    assert validate.rejected_texts(checked).count() == 3


def test_upload_flow(spark, tmp_path):
    csv = tmp_path / "up.csv"
    csv.write_text('id,comment\n1,you idiot\n2,lovely day\n3,"  "\n')
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    summary = flows.upload(spark, str(csv), str(tmp_path / "h"), 7, stamp).first()
    assert (summary["total"], summary["toxic"], summary["safe"]) == (2, 1, 1)
    assert summary["toxic_rate"] == 50.0
    table = HistoryTable(spark, str(tmp_path / "h"))
    rows = table.read().collect()
    assert len({r["id"] for r in rows}) == 2
    # The history's own reports read it, newest upload first.
    later = F.lit("2024-01-30 10:00:01").cast("timestamp_ntz")
    for _ in range(2):
        flows.upload(spark, str(csv), str(tmp_path / "h"), 7, later)
    assert table.read().count() == 4
    newest = history.latest_per_owner(table.read(), 2).collect()
    assert {r["created_at"].second for r in newest} == {1}
    first = min(r["id"] for r in rows)
    table.erase(spark.createDataFrame([(7, first)], "user_id long, id long"), ["user_id", "id"])
    flows.upload(spark, str(csv), str(tmp_path / "h"), 7, stamp)
    assert table.read().count() == 3
    assert {(r["user_id"], r["input_text"], r["source"]) for r in rows} == {
        (7, "you idiot", "csv"), (7, "lovely day", "csv")}


def test_video_flow_is_repeatable(spark, pages, tmp_path):
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    owned = pages.withColumn("user_id", F.lit(5).cast("bigint"))
    where = str(tmp_path / "comments"), str(tmp_path / "analyses")
    for _ in range(2):
        summary = flows.analyse_videos(owned, *where, "run-1", stamp).first()
    assert (summary["total_comments"], summary["toxic_comments"]) == (3, 0)
    assert spark.read.parquet(where[0]).count() == 3
    assert spark.read.parquet(where[1]).count() == 1


def test_tweet_flow(spark):
    tweets = spark.createDataFrame(
        [(1, "You are an idiot"), (2, "hello there"), (3, "@a")], "user_id long, text string")
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    rows = flows.tweets_to_history(tweets, stamp).orderBy("user_id").collect()
    assert [(r["user_id"], r["prediction"], r["source"]) for r in rows] == [
        (1, "Offensive Language", "twitter"), (2, "Neither", "twitter")]
    assert set(json.loads(rows[0]["labels_json"])) == {
        "twitter_hate_speech", "twitter_offensive_language", "twitter_neither"}


def test_encoding_is_chosen_for_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text,n\n\"café\n�\",1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("text,n\nnaïf,2\n".encode("latin-1"))
    for schema in (None, "text string, n int"):
        got = readers.read_comments_csv_any_encoding(spark, str(tmp_path), schema).collect()
        assert sorted(map(tuple, got)) == [("café\n�", 1), ("naïf", 2)]


def test_upload_keeps_the_language_column(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text("text,lang\nvous êtes tous des idiots,fr\nidiot,fr\n", encoding="utf-8")
    stamp = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    flows.upload(spark, str(csv), str(tmp_path / "h"), 7, stamp)
    table = HistoryTable(spark, str(tmp_path / "h"))
    got = {r["input_text"]: r["language"] for r in table.read().collect()}
    assert got == {"vous êtes tous des idiots": "fr", "idiot": "en"}


def test_uploads_keep_the_order_and_encoding_of_their_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    lines = [f"comment number {i} of many" for i in range(40)]
    (tmp_path / "up" / "a.csv").write_text("text\n" + "\n".join(lines[:25]), encoding="utf-8")
    (tmp_path / "up" / "b.csv").write_bytes(("text\n" + "\n".join(["caf\xe9", *lines[25:]])).encode("latin-1"))
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    flows.upload(spark, str(tmp_path / "up"), str(tmp_path / "h"), 7, stamp)
    rows = HistoryTable(spark, str(tmp_path / "h")).read().orderBy("id").collect()
    assert [r["input_text"] for r in rows] == [*lines[:25], "caf\xe9", *lines[25:]]


def test_failing_scorers_mark_only_their_rows(spark, tmp_path):
    from comity.operators.scoring import PandasScorer, scored_in_halves

    def load():
        import pandas as pd

        def predict(texts):
            if texts.str.contains("poison").any():
                raise RuntimeError("cannot score this batch")
            out = pd.DataFrame(0.25, index=texts.index, columns=list(K.LABELS))
            out.loc[texts.str.contains("nan"), :] = float("nan")
            out.loc[texts.str.contains("half"), "toxic"] = float("nan")
            out.loc[texts.str.contains("bad"), "insult"] = 0.75
            return out
        return predict

    texts = ["fine"] * 300 + ["poison a"] + ["bad one"] * 50 + ["nan b", "half c", "poison d"]
    csv = tmp_path / "up.csv"
    csv.write_text("text\n" + "\n".join(texts) + "\n")
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    scorer = PandasScorer(load)
    summary = flows.upload(spark, str(csv), str(tmp_path / "h"), 7, stamp, scorer).first()
    assert (summary["total"], summary["toxic"], summary["safe"], summary["errors"]) == (354, 50, 301, 3)
    assert summary["insult_count"] == 50 and summary["toxic_rate"] == 14.1
    kept = HistoryTable(spark, str(tmp_path / "h")).read().collect()
    assert len(kept) == 351 and not [r for r in kept if "poison" in r["input_text"] or "nan" in r["input_text"]]
    half = next(r for r in kept if r["input_text"] == "half c")
    assert (half["prediction"], half["confidence"]) == ("Non-Toxic", 0.75)

    import pandas as pd
    calls = []

    def fails_on(texts):
        calls.append(len(texts))
        if (texts == "x").any():
            raise ValueError
        return pd.DataFrame({"toxic": 0.5}, index=texts.index)

    found = scored_in_halves(fails_on, pd.Series(["a"] * 500 + ["x"] + ["a"] * 523), ["toxic"])
    assert pd.isna(found[500, 0]) and pd.isna(found).sum() == 1 and len(calls) < 30


def test_positions_follow_pages_items_and_replies(spark):
    pages, want = [], []
    for video in ("v", "w", None):
        at = 0
        for page in range(7):
            items = []
            for item in range((page * 3) % 4):
                top = f"{video}-{page}-{item}"
                replies = [comment(f"{top}-{r}", f"reply {r}", "bob", top) for r in range(item)]
                items.append({"snippet": {"topLevelComment": comment(top, "top", "ann")},
                              "replies": {"comments": replies}} if replies else
                             {"snippet": {"topLevelComment": comment(top, "top", "ann")}})
                for key in (top, *[r["id"] for r in replies]):
                    want.append((video, at, key))
                    at += 1
            pages.append((video, page, json.dumps({"items": items} if items else {})))
    df = spark.createDataFrame(pages, "video_id string, page_number int, page string").repartition(5)
    parsed = threads.parse_pages(df, "page", "video_id", "page_number")
    for block in (1, 2, 1000):
        got = threads.flatten_pages(parsed, block=block)
        assert sorted(map(repr, [(r["video_id"], r["position"], r["comment_id"]) for r in got.collect()])) \
            == sorted(map(repr, want))
    alone = threads.flatten_pages(parsed, include_replies=False)
    assert alone.filter("is_reply").count() == 0
    assert alone.groupBy("video_id", "position").count().filter("count > 1").count() == 0


def test_analysed_videos_keep_positions(spark, pages, tmp_path):
    stamp = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    owned = pages.withColumns({"user_id": F.lit(5).cast("bigint"),
                               "page_number": F.monotonically_increasing_id()})
    where = str(tmp_path / "comments"), str(tmp_path / "analyses")
    flows.analyse_videos(owned, *where, "run-1", stamp)
    rows = {r["comment_id"]: r for r in spark.read.parquet(where[0]).collect()}
    assert {k: r["position"] for k, r in rows.items()} == {"c1": 0, "r1": 1, "r3": 4}
    assert rows["r1"]["parent_id"] == "c1" and rows["r1"]["is_reply"]


def test_a_sheet_reads_back_as_it_was(spark, tmp_path):
    rows = [(1, "  blanks around\t"), (2, 'quo"ted, with\nbreaks'), (3, "é ü"), (4, "x"), (5, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    for encoding in ("utf-8", "ISO-8859-1"):
        path = str(tmp_path / encoding)
        sinks.write_csv(df, path, encoding)
        got = readers.read_comments_csv_any_encoding(spark, path, infer=False).collect()
        assert sorted((int(r["id"]), r["text"]) for r in got) == rows
