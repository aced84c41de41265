"""Sources. Each takes a session and a path that Spark can open and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.text import is_blank
from millrace.schemas import ENRICHED, GOLD_LABEL, RAW_COLUMNS, RAW_POSTING, require_columns


def read_csv_strings(spark: SparkSession, path: str, columns=RAW_COLUMNS, head: int | None = None) -> DataFrame:
    """A headed CSV, every field a string, empty fields as "" rather than null, lines that break the layout kept.

    The header is read once to build the schema; a missing column is an error.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
    df = spark.read.schema(schema).options(**options).csv(path)
    require_columns(df, columns)
    df = df.select(*columns).na.fill("")
    return df if head is None else df.limit(head)


def as_raw_records(df: DataFrame) -> DataFrame:
    """The raw posting as it is replayed: ``remote_allowed`` is 1 where anything but blanks stands, else 0."""
    flag = F.when(is_blank(F.col("remote_allowed")), 0).otherwise(1)
    return df.select(*[flag.alias(c) if c == "remote_allowed" else F.col(c) for c in RAW_COLUMNS])


def read_jsonl_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Non-blank lines as ``value``."""
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    return lines if limit is None else lines.limit(limit)


def parse_json(df: DataFrame, column: str = "value", schema: T.StructType = RAW_POSTING) -> DataFrame:
    """The struct's fields as columns. Text that isn't JSON gives nulls, not a lost row."""
    return df.select(F.from_json(F.col(column).cast("string"), schema).alias("_r")).select("_r.*")


def read_json_directory(spark: SparkSession, path: str, schema: T.StructType = ENRICHED) -> DataFrame:
    """One object a file, as the per-record sink writes them; order by key where order matters."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


#: A list that is read as one value, so that its lines keep their order, is no larger than this.
MOST_LIST_BYTES = 64 << 20


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """Files of a bounded size, each as one ``value``; a larger one is an error before anything is read."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if largest > MOST_LIST_BYTES:
        raise ValueError(f"a list of {largest} bytes; at most {MOST_LIST_BYTES} are read as one value")
    return spark.read.text(path, wholetext=True)


def read_id_list(spark: SparkSession, path: str, name: str = "job_id") -> DataFrame:
    """Trimmed non-blank lines with their place in the file (``pos``); a list is a file of MOST_LIST_BYTES at most."""
    lines = _whole_file(spark, path)
    parts = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", name))
    return parts.select(F.trim(F.col(name)).alias(name), "pos").filter(F.col(name) != "")


def read_labels(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """``job_id | skill | label`` without a header, in a file of MOST_LIST_BYTES at most.

    A line without exactly three fields is an error; the last of repeated keys stays.
    """
    lines = _whole_file(spark, path).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value")).filter(~is_blank(F.col("value")))
    parts = F.split(F.col("value"), "\\" + separator)
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    rows = lines.select("pos", checked.alias("f")).select("pos", *[F.trim(F.col("f")[i]).alias(n) for i, n in enumerate(GOLD_LABEL.names)])
    return rows.groupBy("job_id", "skill").agg(F.max_by("label", "pos").alias("label"))


def read_documents(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 10_000) -> DataFrame:
    """Needs the Kafka connector on the class path; ``streaming.ingest.file_stream`` is the stand-in without it."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(max_offsets)}
    return spark.readStream.format("kafka").options(**options).load()


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the greatest ``order``. Hash aggregation, so repeated keys combine before the shuffle."""
    packed = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r"))
    return packed.select("_r.*")


def numbered(df: DataFrame, *order, name: str = "i") -> DataFrame:
    """1-based export index over a bounded export list."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
