from pyspark.sql import functions as F

from comity.plans.catalog import QUERIES
from comity.sources import sinks
from comity.streaming import flows as streams

SCHEMA = ("id long, user_id long, text string, language string, prediction string, "
          "confidence double, labels_json string, created_at timestamp_ntz")


def land(spark, path, rows):
    df = spark.createDataFrame(rows, "id long, prediction string, at string")
    df.select(
        "id", (F.col("id") % 2).alias("user_id"), F.concat(F.lit("t"), "id").alias("text"),
        F.lit("en").alias("language"), "prediction", F.lit(0.5).alias("confidence"),
        F.lit("{}").alias("labels_json"), F.col("at").cast("timestamp_ntz").alias("created_at"),
    ).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **options):
    return streams.landed_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, **options)


def test_score_and_append_equals_batch_and_resumes(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    to_history = lambda df: sinks.history_rows(df, "text")
    rows = [(i, "Error" if i % 5 == 0 else "Toxic", "2024-01-01 00:00:00") for i in range(20)]
    land(spark, landed, rows[:8])
    streams.score_and_append(stream(spark, landed, files_per_batch=1), to_history, out, checkpoint).awaitTermination()
    land(spark, landed, rows[8:])
    for _ in range(2):
        streams.score_and_append(stream(spark, landed), to_history, out, checkpoint).awaitTermination()
    batch = to_history(spark.read.parquet(landed))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() == 16


def test_daily_counts_close_days_and_drop_late_rows(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        counts = streams.daily_counts(stream(spark, landed))
        streams.append_stream(counts, out, checkpoint).awaitTermination()
        got = spark.read.schema(counts.schema).parquet(out).collect()
        return sorted((str(r["activity_date"]), r["total"], r["toxic"], r["non_toxic"]) for r in got)

    land(spark, landed, [(1, "Toxic", "2024-01-01 01:00:00"), (2, "non toxic", "2024-01-01 23:00:00"),
                         (3, "Toxic", "2024-01-03 02:00:00")])
    assert run() == [("2024-01-01", 2, 1, 1)]
    # The first day is closed: a row for it is late. The second day is still open.
    land(spark, landed, [(4, "Toxic", "2024-01-01 05:00:00"), (5, "Toxic", "2024-01-02 05:00:00")])
    assert run() == [("2024-01-01", 2, 1, 1)]
    land(spark, landed, [(6, "Neither", "2024-01-06 00:00:00")])
    assert run() == [("2024-01-01", 2, 1, 1), ("2024-01-02", 1, 1, 0), ("2024-01-03", 1, 1, 0)]


def test_daily_partials_show_open_days_and_late_rows(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        rows = stream(spark, landed, files_per_batch=1)
        streams.daily_partials(rows, out, checkpoint, "user_id").awaitTermination()
        return sorted(map(str, map(tuple, streams.daily_totals(spark, out, "user_id").collect())))

    land(spark, landed, [(1, "Toxic", "2024-01-05 01:00:00"), (3, "non toxic", "2024-01-05 23:00:00")])
    run()
    land(spark, landed, [(5, "Toxic", "2024-01-01 05:00:00"), (7, None, None)])
    got = run()
    assert got == run()
    batch = spark.read.parquet(landed).groupBy(F.to_date("created_at"), "user_id").agg(
        F.count("*"), F.count_if(F.lower("prediction") == "toxic"),
        F.count_if(F.lower("prediction") == "non toxic"))
    assert got == sorted(map(str, map(tuple, batch.collect()))) and len(got) == 3


def test_daily_totals_before_a_first_batch(spark, tmp_path):
    assert streams.daily_totals(spark, str(tmp_path / "none"), "user_id").count() == 0


def test_tables_of_one_file_and_of_many_stream_alike(spark, tmp_path):
    docs = spark.range(40).selectExpr(
        "id AS doc_id", "concat('you are stupid ', id) AS text", "'en' AS lang",
        "concat('src', id % 3) AS source", "5L AS n_chars")
    events = spark.range(40).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, id) AS ts",
        "id % 4 AS user_id", "'view' AS event_type", "double(id) AS value", "'{\"k\":3}' AS props")
    for name, df in (("documents", docs), ("events", events)):
        df.repartition(3).write.parquet(f"{tmp_path}/many/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
        (tmp_path / "one").mkdir(exist_ok=True)
        df.toPandas().to_parquet(f"{tmp_path}/one/{name}.parquet", coerce_timestamps="us")
    for name, n in (("stream_scores", 40), ("stream_history", 38)):
        many, one, none = (
            sorted(map(str, QUERIES[name](spark, f"{tmp_path}/{of}").collect()))
            for of in ("many", "one", "none"))
        assert many == one and len(many) == n and none == []
    assert QUERIES["stream_then_erase"](spark, f"{tmp_path}/many").count() > 0
