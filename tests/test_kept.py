"""What is kept beside the history: the trigram index, counters by day, folded stream counts."""

import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from comity.operators import history, reports
from comity.sources import search_index
from comity.sources.day_counts import DayCounts
from comity.sources.history_table import HistoryTable
from comity.sources.search_index import SearchIndex
from comity.streaming.daily_table import DailyTable
from tests.test_streaming import land, stream

TEXTS = ["", "a", "ab", "abc", "ABCD", "xabcx", "line\nbreak", "ÄÖÜ straße", "😀😁😂 ok", "a b c",
         None, "aaaa", "needle in hay", "NEEDLE", "need le", "%_\\ '\"", "日本語です。", "abc"]


def rows_of(spark, texts, user=lambda i: i % 3, day="2024-01-01", verdict="Toxic"):
    at = datetime.datetime.fromisoformat(day) if day else None
    return spark.createDataFrame(
        [(user(i), t, "en", "", verdict, 0.5, '{"toxic": 0.9, "insult": 0.1}', (None, "csv", " API ")[i % 3], at)
         for i, t in enumerate(texts)],
        "user_id long, input_text string, language string, translated_text string, "
        "prediction string, confidence double, labels_json string, source string, "
        "created_at timestamp_ntz")


@pytest.fixture
def table(spark, tmp_path):
    return HistoryTable(spark, str(tmp_path / "h"))


@pytest.fixture
def index(table, tmp_path):
    return SearchIndex(table, str(tmp_path / "i"))


def same(index, needle, **other):
    got = sorted(r["id"] for r in index.search(needle, **other).collect())
    rows = history.search(index.history.read(), None, **other).collect()
    want = sorted(r["id"] for r in rows if (needle or "").lower() in (r["input_text"] or "").lower())
    assert got == want, needle
    return len(got)


NEEDLES = ["ABC", None, "nowhere", "a", "bcd", "e\nb", "ÖÜ s", "😁😂", "😀😁😂", "%_\\", "aaaaa"]


def test_a_search_finds_what_a_scan_finds(spark, table, index):
    assert same(index, "abc") == 0
    table.add(rows_of(spark, TEXTS), "r1")
    assert index.update() and index.update() == []
    counts = [same(index, needle) for needle in NEEDLES]
    assert counts[:3] == [4, len(TEXTS), 0]
    assert same(index, "abc", source="api") and same(index, "abc", prediction="neither") == 0


def test_new_runs_are_scanned_and_then_indexed_and_erased_rows_are_gone(spark, table, index):
    table.add(rows_of(spark, TEXTS), "r1")
    index.update()
    table.add(rows_of(spark, ["more abc", "none"], day=None), "r2")
    assert same(index, "abc") == 5
    assert len(index.update()) == 1
    assert same(index, "abc") == 5
    table.erase(spark.createDataFrame([(0,)], "user_id long"), ["user_id"])
    left = same(index, "abc")
    assert left < 5
    table.purge()
    assert same(index, "abc") == left
    before = index._postings(index._state()[1]).count()
    index.rebuild()
    assert same(index, "abc") == left and index._postings(index._state()[1]).count() < before
    ids = {r["id"] for r in table.read().select("id").collect()}
    assert {r["id"] for r in index._postings(index._state()[1]).collect()} <= ids
    assert index.update() == []


def test_many_candidates_are_not_collected_or_broadcast(spark, table, index, monkeypatch):
    table.add(rows_of(spark, TEXTS * 3), "r1")
    index.update()
    for few, fewest in ((100, 2), (2, 1)):
        monkeypatch.setattr(search_index, "FEW", few)
        monkeypatch.setattr(search_index, "FEWEST", fewest)
        assert same(index, "abc") == 12


def test_an_index_cut_short_is_not_seen(spark, table, index, monkeypatch):
    table.add(rows_of(spark, TEXTS), "r1")

    def dies(*args):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(SearchIndex, "_commit", dies)
        with pytest.raises(RuntimeError):
            index.update()
    assert same(index, "abc") == 4 and index._state()[1] == []
    index.update()
    assert same(index, "abc") == 4


def test_an_index_of_no_rows(spark, table, index):
    table.add(rows_of(spark, ["abc"]).limit(0), "none")
    index.update()
    index.rebuild()
    assert same(index, "abc") == 0


def test_a_search_opens_the_asked_trigrams_only(spark, table, index):
    table.add(rows_of(spark, TEXTS), "r1")
    index.update()
    ids, _ = index.candidates("abc")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "trigram" in plan.split("PushedFilters")[1][:200]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=200, unique=True))
def test_ranges_hold_all_ids_and_leave_the_largest_gaps(ids):
    ids = sorted(ids)
    spans = search_index.ranges(ids)
    assert len(spans) == min(len(ids), search_index.SPANS)
    assert all(sum(low <= i <= high for low, high in spans) == 1 for i in ids)
    inside = [b - a for a, b in zip(ids, ids[1:]) if any(low <= a and b <= high for low, high in spans)]
    between = [b - a for (_, a), (b, _) in zip(spans, spans[1:])]
    assert not inside or not between or max(inside) <= min(between)


def unordered(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def equal_reports(kept, table):
    rows = table.read()
    for got, want in (
        (kept.dashboard("2024-01-02"), reports.dashboard(rows, "2024-01-02")),
        (kept.daily_activity(), reports.daily_activity(rows)),
        (kept.source_distribution(), reports.source_distribution(rows)),
        (kept.label_counts(), reports.label_counts(rows)),
    ):
        assert unordered(got) == unordered(want)


def test_counters_follow_runs_and_erasures(spark, table, tmp_path):
    kept = DayCounts(table, str(tmp_path / "k"))
    assert kept.refresh() == []
    equal_reports(kept, table)
    table.add(rows_of(spark, TEXTS), "r1")
    table.add(rows_of(spark, TEXTS[:5], day="2024-01-02", verdict="non toxic"), "r2")
    assert len(kept.refresh()) == 2 and kept.refresh() == []
    equal_reports(kept, table)
    # A run of one day, and one without a day.
    table.add(rows_of(spark, TEXTS[:4], day="2024-01-02"), "r3")
    table.add(rows_of(spark, TEXTS[:4], user=lambda i: 9, day=None), "r4")
    assert kept.refresh() == ["created_date=2024-01-02", "created_date=__HIVE_DEFAULT_PARTITION__"]
    equal_reports(kept, table)
    # All rows of a day go, some of the others.
    table.erase(spark.createDataFrame([(9,), (1,)], "user_id long"), ["user_id"])
    assert len(kept.refresh()) == 3
    equal_reports(kept, table)
    table.purge()
    kept.refresh()
    equal_reports(kept, table)


def test_a_refresh_cut_short_changes_nothing(spark, table, tmp_path, monkeypatch):
    kept = DayCounts(table, str(tmp_path / "k"))
    table.add(rows_of(spark, TEXTS), "r1")
    kept.refresh()
    before = unordered(kept.read())
    table.add(rows_of(spark, TEXTS), "r2")

    def dies(*args, **kwargs):
        raise RuntimeError

    with monkeypatch.context() as m:
        # The counters are written by then; the log is not.
        m.setattr("comity.sources.day_counts.LOG_SCHEMA", None)
        with pytest.raises(Exception):
            kept.refresh()
    assert unordered(kept.read()) == before
    assert kept.refresh()
    equal_reports(kept, table)


def batch_of(spark, path):
    return spark.read.parquet(path).groupBy(
        F.to_date("created_at").alias("activity_date"), "user_id").agg(
        F.count("*").alias("total"), F.count_if(F.lower("prediction") == "toxic").alias("toxic"),
        F.count_if(F.lower("prediction") == "non toxic").alias("non_toxic"))


def test_folded_counts_equal_a_batch_job_in_few_folders(spark, tmp_path):
    landed = str(tmp_path / "in")
    daily = DailyTable(spark, str(tmp_path / "t"), "user_id", slots=2)
    assert daily.totals().count() == 0 and daily.late_rows().count() == 0
    for i in range(7):
        day = (5, 6, 5, 7, 1, 8, 8)[i]
        land(spark, landed, [(i, "Toxic", f"2024-01-0{day} 01:00:00"), (50 + i, "non toxic", None)])
        daily.stream(stream(spark, landed), str(tmp_path / "cp")).awaitTermination()
        assert unordered(daily.totals()) == unordered(batch_of(spark, landed))
    assert {str(r[0]): r[1] for r in daily.late_rows().collect()} == {"2024-01-05": 1, "2024-01-01": 1}
    assert len(list((tmp_path / "t" / "slots").glob("slot=*"))) == 2
    assert len(list((tmp_path / "t").iterdir())) <= 5


@pytest.mark.parametrize("step", ["totals", "mark"])
def test_a_fold_cut_short_counts_every_row_once(spark, tmp_path, monkeypatch, step):
    landed = str(tmp_path / "in")
    for i in range(6):
        land(spark, landed + f"/{i}", [(i, "Toxic", f"2024-01-0{1 + i} 01:00:00")])
    part = [spark.read.parquet(landed + f"/{i}") for i in range(6)]
    daily = DailyTable(spark, str(tmp_path / "t"), "user_id", slots=2)
    for i in range(5):
        daily.add(part[i], i)
    want = unordered(daily.totals())
    write = DataFrameWriter.parquet

    def dies(self, path, *args, **kwargs):
        if step in path:
            raise RuntimeError
        write(self, path, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(RuntimeError):
            daily.fold(4)
    assert unordered(daily.totals()) == want
    # A batch is repeated, also one that has been folded.
    for i in (1, 4, 5, 5):
        daily.add(part[i], i)
    assert daily.totals().agg(F.sum("total")).first()[0] == 6
