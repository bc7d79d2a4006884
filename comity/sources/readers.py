"""CSV and export readers, and column resolution for loosely named inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity import constants as K

TWEET_SCHEMA = T.StructType([
    T.StructField("class", T.IntegerType()),
    T.StructField("tweet", T.StringType()),
])
TRAINING_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    *[T.StructField(label, T.IntegerType()) for label in K.TRAINING_LABELS],
    T.StructField("source", T.StringType()),
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("translated_text", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("labels_json", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


#: File, split of the file, and row: the order of a sheet's rows.
POSITION = ("_file", "_start", "_row")


def read_comments_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    encoding: str = "utf-8",
    multi_line: bool = True,
    infer: bool = True,
) -> DataFrame:
    """CSV with a header and quoted, possibly multi-line text. Empty files give no rows.

    Without a schema the types are inferred, which reads the data twice, or all columns are
    strings (``infer=False``). Multi-line
    files cannot be split: large inputs should come as many files, or be read with
    ``multi_line=False`` where no field holds a line break.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
    )
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    return reader.csv(path)


def read_comments_csv_any_encoding(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = True,
    positions: bool = False,
    infer: bool = True,
) -> DataFrame:
    """Each file as UTF-8 if all its text is valid UTF-8, and as Latin-1 otherwise.

    Latin-1 keeps every byte, so the text is read that way and turned back into bytes.
    ``positions`` adds the columns POSITION, which order rows by file and place in it.
    """
    df = read_comments_csv(spark, path, schema, "ISO-8859-1", multi_line, infer)
    if schema is None:
        df = df.toDF(*[_header(c) for c in df.columns])
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    places = list(POSITION) if positions else []
    rows = df.withColumn("_file", F.col("_metadata.file_path"))
    if positions:
        rows = rows.withColumns({
            "_start": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id()})
    if not texts:
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], *places)
    valid = F.lit(True)
    for name in texts:
        of = F.is_valid_utf8(F.encode(F.col(f"`{name}`"), "ISO-8859-1").cast("string"))
        valid = valid & F.coalesce(of, F.lit(True))
    files = rows.groupBy("_file").agg(F.bool_and(valid).alias("_utf8"))

    def decoded(name: str) -> Column:
        c = F.col(f"`{name}`")
        utf8 = F.encode(c, "ISO-8859-1").cast("string")
        return F.when(F.col("_utf8"), utf8).otherwise(c).alias(name)

    return rows.join(files, "_file").select(
        *[decoded(c) if c in texts else F.col(f"`{c}`") for c in df.columns], *places
    )


def _header(name: str) -> str:
    """A column name that was read as Latin-1, without a byte-order mark."""
    try:
        return name.encode("latin-1").decode("utf-8-sig")
    except UnicodeError:
        return name


def spread(df: DataFrame) -> DataFrame:
    """Give an input with fewer splits than cores one task per core.

    Scoring and cleaning cost far more than moving a few splits. An input that already
    fills the cluster is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pick_text_column(columns: Sequence[str]) -> str:
    """First known text column, case-sensitive; otherwise the first column."""
    return next((c for c in K.TEXT_COLUMNS if c in columns), columns[0])


def with_text(df: DataFrame, *keep: str) -> DataFrame:
    """The resolved text column under the name ``text``, next to the columns to keep."""
    return df.select(*keep, F.col(f"`{pick_text_column(df.columns)}`").alias("text"))


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First of ``names`` present, whatever its case and surrounding blanks."""
    present = {c.strip().lower(): c for c in columns}
    return next((present[n.lower()] for n in names if n.lower() in present), None)


def find_prediction_column(columns: Sequence[str]) -> str | None:
    return find_column(columns, K.PREDICTION_COLUMNS)


def find_category_column(columns: Sequence[str], category: str) -> str | None:
    return find_column(columns, K.CATEGORY_COLUMNS.get(category, ()))


def normalize_export(
    df: DataFrame,
    text_col: str = "text",
    label_map: Mapping[str, str] | None = None,
    source: str = "twitter",
) -> DataFrame:
    """An authorised export in the canonical training shape.

    ``label_map`` is target label → source column. Labels are never invented: a missing
    source column is an error. A label that is no number fails the job.
    """
    label_map = label_map or {label: label for label in K.TRAINING_LABELS}
    for name in [text_col, *label_map.values()]:
        if name not in df.columns:
            raise ValueError(f"required column {name!r} is missing from the export")
    labels = [
        F.col(f"`{src}`").cast("double").cast("int").alias(target)
        for target, src in label_map.items()
    ]
    return df.select(
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *labels,
        F.lit(source).alias("source"),
    )


def merge_sources(*frames: DataFrame) -> DataFrame:
    """One canonical training set out of several exports; the columns must agree."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged
