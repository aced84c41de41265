"""Sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from millrace.functions.text import PROMPT_CHARS, wrap_lines
from millrace.schemas import INDEX_DOCUMENT, conform


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """UTF-8 JSON lines; ``files`` splits the replay into so many micro-batches."""
    (df if files is None else df.repartition(files)).write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").options(header=True, sep="\t", quote="").csv(path)


def write_id_list(df: DataFrame, path: str, column: str = "job_id") -> None:
    """One id a line, sorted as strings. Lists of ids are small by nature."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_kafka(df: DataFrame, servers: str, topic: str, linger_ms: int = 50, batch_bytes: int = 65_536) -> None:
    """A batch write of ``value``; needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.linger.ms": str(linger_ms), "kafka.batch.size": str(batch_bytes)}
    df.selectExpr("CAST(value AS BINARY) AS value").write.format("kafka").options(**options).save()


def replay(lines: DataFrame, connect: Callable[[], Callable[[str], None]], every: int = 500, pause_s: float = 0.1) -> int:
    """Send each non-null ``value`` through what ``connect`` returns, a pause after ``every`` messages of a task; how many.

    Tasks pace themselves, so a paced replay of one stream is a frame of one partition. ``connect`` runs once a task; a
    ``flush`` of its sender, if it has one, ends it.
    """

    def run(frames):
        import pandas as pd

        send, sent = connect(), 0
        for frame in frames:
            for value in frame["value"]:
                if value is None:
                    continue
                send(value)
                sent += 1
                if sent % every == 0:
                    time.sleep(pause_s)
        getattr(send, "flush", lambda: None)()
        yield pd.DataFrame({"n": [sent]})

    return lines.select(F.col("value").cast("string")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" in str(gone) or "UNABLE_TO_INFER_SCHEMA" in str(gone):
            return None
        raise


def pending(df: DataFrame, path: str, key: str = "job_id", retry_failed: bool = False) -> DataFrame:
    """Rows not written yet. Failed records count as written unless ``retry_failed``."""
    done = stored(df.sparkSession, path)
    if done is None:
        return df
    if retry_failed:
        done = done.filter(F.col("status") == "ok")
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("status").parquet(path)


def upsert(existing: DataFrame | None, updates: DataFrame, key: str = "job_id") -> DataFrame:
    """Updates win over existing rows; of repeated updates the last in (``_seq``) order wins where that column is given."""
    fresh = updates if "_seq" in updates.columns else updates.withColumn("_seq", F.lit(0))
    body = [c for c in fresh.columns if c != "_seq"]
    fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*body), F.col("_seq")).alias("_r")).select("_r.*")
    if existing is None:
        return fresh
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


POINTER = "_current"


def _file_context(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the index at ``path`` points at, or None where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one: a pointer written beside the old one takes its place in one rename."""
    jvm, context = _file_context(spark, path)
    beside, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"{POINTER}.{version}", POINTER))
    stream = beside.getFileSystem(spark._jsc.hadoopConfiguration()).create(beside, True)
    stream.writeUTF(version)
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(beside, target, how)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index's current rows, or None before the first write."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(version)


def index_health(spark: SparkSession, path: str) -> dict:
    """Whether the index exists and how many documents it holds."""
    rows = read_index(spark, path)
    return {"exists": rows is not None, "count": 0 if rows is None else rows.count()}


def rejected(docs: DataFrame, schema: T.StructType = INDEX_DOCUMENT, key: str = "job_id") -> DataFrame:
    """Rows that an index won't take, with ``reason``: no key, or a value that isn't of its column's type."""
    reasons = [F.when(F.col(key).isNull(), F.lit("no key"))]
    for f in schema.fields:
        if f.name in docs.columns and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            reasons.append(F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    return docs.withColumn("reason", F.coalesce(*reasons)).filter(F.col("reason").isNotNull())


def write_index(docs: DataFrame, path: str, schema: T.StructType = INDEX_DOCUMENT, key: str = "job_id") -> DataFrame:
    """Upsert by ``key`` into a strictly typed table, and the rows that it didn't take. Rows of earlier runs stay.

    The merged table is written as a new version and then pointed at, so readers see the old rows or the new and a crash
    in between changes nothing. The version before stays for who still reads it; older ones go. Read with ``read_index``.
    """
    spark = docs.sparkSession
    bad = rejected(docs, schema, key)
    good = conform(docs.join(bad.select(key).distinct(), key, "left_anti").filter(F.col(key).isNotNull()), schema)
    before = current_version(spark, path)
    merged = upsert(read_index(spark, path), good, key)
    version = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{version}")
    _point(spark, path, version)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in (version, (before or "").rsplit("/", 1)[-1]):
            fs.delete(entry.getPath(), True)
    return bad


def export_readable(df: DataFrame, key: str, title: str, text: str, width: int = 90, terms: str | None = None, index: str | None = None, total: int | None = None) -> DataFrame:
    """One wrapped block a record, for reading by people.

    With ``index`` (a column, see ``readers.numbered``) and ``total`` the head begins with [i/n]; with ``terms`` a line of
    the terms found follows it.
    """
    parts = [F.col(key).cast("string"), F.lit("  "), F.coalesce(F.col(title), F.lit(""))]
    if index is not None:
        parts = [F.format_string(f"[%d/{total if total is not None else '?'}] ", F.col(index)), *parts]
    lines = [F.concat(*parts)]
    if terms is not None:
        lines.append(F.concat(F.lit("terms ("), F.size(terms).cast("string"), F.lit("): "), F.array_join(terms, ", ")))
    return df.select(F.col(key), F.concat_ws("\n", *lines, wrap_lines(F.col(text).substr(1, PROMPT_CHARS), width)).alias("block"))
