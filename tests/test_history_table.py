"""The history table: repeats, replays, erasure by file, and runs cut short at any step."""

import datetime

import pytest
from pyspark.sql import functions as F

from comity.operators import history, reports
from comity.sources.history_table import ROW_BITS, HistoryTable, numbered
from tests.test_streaming import SCHEMA, land, stream
from comity.sources import sinks
from comity.streaming import flows as streams


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, text string, prediction string, day string")
    return sinks.history_rows(df.withColumns({
        "language": F.lit(None).cast("string"), "confidence": F.lit(0.5),
        "labels_json": F.lit("{}"), "created_at": F.col("day").cast("timestamp_ntz"),
    }), "text")


def content(table):
    return sorted((r["user_id"], r["input_text"]) for r in table.read().collect())


ROWS = [(1, "a", "Toxic", "2024-01-01"), (2, "b", "Toxic", "2024-01-01"),
        (1, "c", "Toxic", "2024-01-02"), (2, "d", "Error", "2024-01-03"),
        (2, "e", "Toxic", "2024-01-03"), (3, "f", "Toxic", None)]


@pytest.fixture
def table(spark, tmp_path):
    return HistoryTable(spark, str(tmp_path / "h"))


def test_an_empty_table(spark, table):
    assert table.read().count() == 0 and table.runs().count() == 0 and table.purge() == 0
    assert table.erase(spark.createDataFrame([(1,)], "user_id long"), ["user_id"]) == 0
    assert table.add(rows_of(spark, ROWS).limit(0), "none")
    assert table.read().count() == 0


def test_runs_are_added_once(spark, table):
    assert table.add(rows_of(spark, ROWS), "r1")
    assert not table.add(rows_of(spark, ROWS), "r1")
    assert table.add(rows_of(spark, ROWS[:1]), "r1", batch=1)
    assert content(table) == [(1, "a"), (1, "a"), (1, "c"), (2, "b"), (2, "e"), (3, "f")]
    got = table.read().collect()
    assert len({r["id"] for r in got}) == 6 and {r["run_id"] for r in got} == {"r1"}
    assert {r["created_date"] for r in got} == {
        None, *[datetime.date(2024, 1, d) for d in (1, 2, 3)]}
    newest = max(got, key=lambda r: r["id"])
    assert newest["id"] >> ROW_BITS == 2 and newest["input_text"] == "a"


def test_a_run_that_is_cut_short_is_not_seen(spark, table, monkeypatch):
    table.add(rows_of(spark, ROWS), "r1")
    before = content(table)
    commit = HistoryTable._commit

    def dies(self, entries):
        if entries[0][0] in ("done", "remove"):
            raise RuntimeError("lost")
        commit(self, entries)

    monkeypatch.setattr(HistoryTable, "_commit", dies)
    asked = spark.createDataFrame([(1,)], "user_id long")
    for step in (lambda: table.add(rows_of(spark, ROWS[:2]), "r2"), lambda: table.erase(asked, ["user_id"])):
        with pytest.raises(RuntimeError):
            step()
        assert content(table) == before
    monkeypatch.undo()
    table.add(rows_of(spark, ROWS[:2]), "r2")
    assert content(table) == sorted(before + [(1, "a"), (2, "b")])
    assert {r["id"] >> ROW_BITS for r in table.read().filter("run_id = 'r2'").collect()} == {2}


def test_erasure_rewrites_only_files_that_hold_a_row(spark, table):
    table.add(rows_of(spark, ROWS), "r1")
    table.add(rows_of(spark, [(4, "g", "Toxic", "2024-01-01")]), "r2")
    files = set(table._files())
    user = spark.createDataFrame([(1,), (1,), (9,), (None,)], "user_id long")
    assert table.erase(user, ["user_id"]) > 0
    assert content(table) == [(2, "b"), (2, "e"), (3, "f"), (4, "g")]
    kept = {f for f in files if "2024-01-03" in f or "DEFAULT" in f or "segment=r2/" in f}
    assert kept and kept <= set(table._files())
    assert table.erase(user, ["user_id"]) == 0
    assert not table.add(rows_of(spark, ROWS), "r1")  # a replay does not bring rows back
    item = table.read().filter("input_text = 'e'").select("user_id", "id")
    other = item.withColumn("user_id", F.lit(3).cast("long"))
    assert table.erase(other, ["user_id", "id"]) == 0
    assert table.erase(item, ["user_id", "id"]) == 1
    assert content(table) == [(2, "b"), (3, "f"), (4, "g")]


def test_purge_leaves_no_erased_row_on_disk(spark, table):
    table.add(rows_of(spark, ROWS), "r1")
    table.erase(spark.createDataFrame([(1,)], "user_id long"), ["user_id"])
    data = f"{table.path}/data"
    assert spark.read.parquet(data).filter("user_id = 1").count() == 2
    assert table.purge() == 2 and table.purge() == 0
    assert spark.read.parquet(data).filter("user_id = 1").count() == 0
    assert content(table) == [(2, "b"), (2, "e"), (3, "f")]


def test_a_page_reads_few_row_groups(spark, table):
    table.add(rows_of(spark, [(1, f"t{i}", "Toxic", "2024-01-01") for i in range(2000)]), "r1")
    table.add(rows_of(spark, [(1, f"u{i}", "Toxic", "2024-01-01") for i in range(2000)]), "r2")
    last = table.read().agg(F.min(F.when(F.col("run_id") == "r2", F.col("id")))).first()[0]
    page = history.page(table.read(), 20, last)
    assert {r["run_id"] for r in page.collect()} == {"r1"}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert f"LessThan(id,{last})" in plan


def test_streamed_rows_can_be_erased_and_replayed(spark, table, tmp_path):
    landed, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [(i, "Error" if i % 5 == 0 else "Toxic", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(20)]
    to_history = lambda df: sinks.history_rows(df.drop("id"), "text")

    def drain(at):
        streams.stream_into(
            stream(spark, landed, files_per_batch=1), to_history, table.path, "s", at
        ).awaitTermination()

    land(spark, landed, rows[:8])
    drain(checkpoint)
    land(spark, landed, rows[8:])
    drain(checkpoint)
    assert len(content(table)) == 16
    # Another checkpoint numbers batches anew: as after a failure, both are in the table.
    drain(str(tmp_path / "cp2"))
    assert len(content(table)) == 16
    table.erase(spark.createDataFrame([(1,)], "user_id long"), ["user_id"])
    drain(checkpoint)
    left = table.read()
    assert {r["user_id"] for r in left.collect()} == {0} and left.count() == 8
    days = reports.daily_activity(left).collect()
    assert sum(r["total"] for r in days) == 8
    assert spark.createDataFrame([], SCHEMA).schema  # the landed schema is the tests' own


def test_pages_read_the_newest_runs_only(spark, table):
    assert table.page().count() == 0 and table.page(5, 100).count() == 0
    for run in range(5):
        table.add(rows_of(spark, ROWS[:(3, 1, 0, 2, 6)[run]]), f"r{run}")
    table.erase(spark.createDataFrame([(3,)], "user_id long"), ["user_id"])
    ids = sorted((r["id"] for r in table.read().select("id").collect()), reverse=True)
    for before in (None, ids[0], ids[2], ids[4] + 5, ids[-1], 3 << ROW_BITS, 9 << ROW_BITS):
        for size in (1, 4, 50):
            want = [i for i in ids if before is None or i < before][:size]
            assert [r["id"] for r in table.page(size, before).collect()] == want
    plan = table.page(2, ids[0])._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(id,{5 << ROW_BITS})" in plan


def test_numbering_moves_no_rows_by_block(spark):
    """A shuffle by block would bring all rows of a split, however large, to one task."""
    rows = spark.range(0, 1000, 1, 4).select(
        F.expr("id div 250").alias("block"), F.col("id").alias("row"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, -1)
    try:
        out = numbered(rows, ["block"], "row", "n")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.n for r in out.collect()) == list(range(1, 1001))
    finally:
        spark.conf.unset(threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
