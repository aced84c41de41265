"""Document assembly, vector top-k and the gap report."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import arrays, vectors
from millrace.functions.text import composite_text
from millrace.schemas import INDEX_DOCUMENT, conform

TOP_K = 8


def assemble(metadata: DataFrame, records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Index documents: metadata, ok records and vectors joined on job_id; generated columns keep their own names."""
    left = metadata.select(
        F.col("job_id").cast("string").alias("job_id"),
        "title",
        F.col("description_clean").alias("description"),
        F.col("company_name").alias("company"),
        "location",
        F.col("formatted_work_type").alias("work_type"),
        F.col("formatted_experience_level").alias("experience_level_source"),
        F.coalesce("skills_gazetteer", F.array().cast("array<string>")).alias("skills_gazetteer"),
        F.coalesce("n_skills", F.lit(0)).alias("n_skills"),
    )
    made = records.filter(F.col("status") == "ok").select(
        F.col("job_id").cast("string").alias("job_id"),
        F.col("seniority").alias("seniority_llm"),
        "years_experience_min",
        *arrays.attribution_columns(F.col("skills")),
    )
    joined = left.join(made, "job_id").join(embeddings.select(F.col("job_id").cast("string").alias("job_id"), "embedding"), "job_id")
    return conform(joined, INDEX_DOCUMENT)


def skipped(metadata: DataFrame, records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ok records without metadata or without a vector."""
    known = metadata.select(F.col("job_id").cast("string").alias("job_id")).join(embeddings.select(F.col("job_id").cast("string").alias("job_id")), "job_id", "left_semi")
    return records.filter(F.col("status") == "ok").select(F.col("job_id").cast("string").alias("job_id")).join(known, "job_id", "left_anti")


def embed_records(records: DataFrame, dims: int = 384, encoder=vectors.hashing_encoder) -> DataFrame:
    """(job_id, embedding) of the ok records; ``encoder(text column, dims)`` gives the vector column."""
    text = composite_text(F.col("title"), F.transform("skills", lambda m: m["skill"]))
    return records.filter(F.col("status") == "ok").select("job_id", encoder(text, dims).alias("embedding"))


def knn(corpus: DataFrame, query, k: int, key: str = "job_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one query vector by cosine, exact; ties by key.

    The query is a literal, so no join is planned: each task keeps its best k and only those travel.
    """
    scored = corpus.withColumn("cosine", vectors.cosine(F.col(vector), vectors.literal_vector(query)))
    return scored.filter(F.col("cosine").isNotNull()).orderBy(F.desc("cosine"), F.asc(key)).limit(k)


#: Query vectors and rows that are scored against one another at once, pairs that are summed at once, and the most queries that are sent to all tasks at once.
QUERY_BLOCK = 512
ROW_BLOCK = 2048
PAIR_BLOCK = 1 << 14
QUERIES_SENT = 4096
#: Cosines of the matrix product this near to the k-th are summed again, row by row, so that equal vectors tie.
NEAR = 1e-9


def knn_many(corpus: DataFrame, queries: DataFrame, k: int, key: str = "job_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, key, cosine, rank) of the ``k`` rows nearest to each row of ``queries`` (query, vector), exact; ties by key.

    Queries are sent in blocks of QUERIES_SENT; every task scores its rows against a block and keeps its best k of each
    query, so k rows a query and task travel. Vectors of null, of length 0 or of another size meet nothing.
    """
    spark, kind = corpus.sparkSession, corpus.schema[key].dataType
    dealt = queries.select(F.col(query_key), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    n = -(-dealt.count() // QUERIES_SENT) or 1
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64(query_key), F.lit(n)))
    rows = corpus.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField(key, kind), T.StructField("cosine", T.DoubleType())])
    found = []
    for b in range(n):
        block = dealt.filter(F.col("b") == b).drop("b").collect()
        shared = spark.sparkContext.broadcast(by_size([r["v"] for r in block]))
        part = rows.mapInArrow(nearest_of(shared, key, k), schema)
        names = spark.createDataFrame([(i, r[query_key]) for i, r in enumerate(block)], T.StructType([T.StructField("q", T.LongType()), T.StructField(query_key, queries.schema[query_key].dataType)]))
        found.append(part.join(F.broadcast(names), "q").drop("q"))  # names: one block of queries
    order = Window.partitionBy(query_key).orderBy(F.desc("cosine"), F.asc(key))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_key, key, "cosine", "rank")


def by_size(vectors_: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each size, QUERY_BLOCK at most in one; what has no length is left out."""
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(vectors_):
        sizes.setdefault(len(v), []).append(i)
    out = []
    for ids in sizes.values():
        places, matrix = np.array(ids), np.array([vectors_[i] for i in ids], float)
        some = measured(matrix)
        places, matrix = places[some], matrix[some]
        out += [(places[at : at + QUERY_BLOCK], matrix[at : at + QUERY_BLOCK]) for at in range(0, len(places), QUERY_BLOCK)]
    return out


def measured(matrix: np.ndarray) -> np.ndarray:
    """Which rows have a length that isn't 0."""
    length = (matrix * matrix).sum(axis=1)
    return (length > 0) & np.isfinite(length)


def nearest_of(shared, key: str, k: int):
    """For ``mapInArrow``: of a task's rows the best k of each query of the block.

    A worker holds an Arrow batch, the scores of a block of queries and rows, and k rows a query as arrays.
    """

    def run(batches):
        asked = [(places, matrix, np.sqrt((matrix * matrix).sum(axis=1))) for places, matrix in shared.value]
        best: list[pd.DataFrame | None] = [None] * len(asked)
        least = [np.full(len(places), -np.inf) for places, *_ in asked]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROW_BLOCK):
                keys, lists = (batch.column(c).slice(at, ROW_BLOCK) for c in range(2))
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                for size in {matrix.shape[1] for _, matrix, _ in asked} & set(sizes.tolist()):
                    own = np.flatnonzero(sizes == size)
                    rows = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(own), size)
                    some = measured(rows)
                    own, rows = own[some], rows[some]
                    if not len(own):
                        continue
                    length, names = np.sqrt((rows * rows).sum(axis=1)), keys.take(pa.array(own)).to_pandas().to_numpy()
                    for b, (_, matrix, norms) in enumerate(asked):
                        if matrix.shape[1] == size:
                            merge(b, best, least[b], matrix, norms, rows, length, names)
        for (places, *_), frame in zip(asked, best, strict=True):
            if frame is not None:
                yield pa.RecordBatch.from_arrays([pa.array(places[frame["q"]], pa.int64()), pa.array(frame["key"].to_numpy(), kind, from_pandas=True), pa.array(frame["cosine"].to_numpy())], ["q", key, "cosine"])

    def merge(b: int, best: list, least: np.ndarray, matrix: np.ndarray, norms: np.ndarray, rows: np.ndarray, length: np.ndarray, names: np.ndarray) -> None:
        near = matrix @ rows.T
        near /= norms[:, None]
        near /= length[None, :]
        bar = least
        if len(length) > k:
            bar = np.maximum(least, np.partition(near, len(length) - k, axis=1)[:, len(length) - k])
        # All that tie with the k-th stay until the keys decide.
        q, r = np.nonzero(near >= (bar - NEAR)[:, None])
        frames = [] if best[b] is None else [best[b]]
        for at in range(0, len(q), PAIR_BLOCK):
            i, j = q[at : at + PAIR_BLOCK], r[at : at + PAIR_BLOCK]
            exact = (matrix[i] * rows[j]).sum(axis=1) / (norms[i] * length[j])
            joined = pd.concat([*frames, pd.DataFrame({"q": i, "key": names[j], "cosine": exact})])
            frames = [joined.sort_values(["q", "cosine", "key"], ascending=[True, False, True]).groupby("q").head(k)]
        if len(q):
            best[b] = frames[0]
            n, last = best[b]["q"].value_counts(), best[b].groupby("q")["cosine"].min()
            full = n.index[n == k].to_numpy()
            least[full] = last.loc[full].to_numpy()

    return run


def knn_postfiltered(corpus: DataFrame, query, k: int = TOP_K, keep=None, key: str = "job_id", vector: str = "embedding") -> DataFrame:
    """2k nearest, then only those that pass ``keep``, then k: may return fewer than k."""
    keep = F.size("skills_required") > 0 if keep is None else keep
    return knn(corpus, query, 2 * k, key, vector).filter(keep).orderBy(F.desc("cosine"), F.asc(key)).limit(k)


def match(docs: DataFrame, role: str, skills: list[str], k: int = TOP_K, query=None, dims: int = 384) -> DataFrame:
    """Documents nearest to a profile with what it has and lacks of their required skills.

    ``query`` is the profile's vector; without one the hashing encoder makes it from the same text layout as documents.
    """
    spark = docs.sparkSession
    if query is None:
        one = spark.createDataFrame([(role, list(skills))], "role string, skills array<string>")
        query = one.select(vectors.hashing_encoder(composite_text(F.col("role"), F.col("skills")), dims).alias("v")).first()["v"]
    confirmed = F.array(*[F.lit(s) for s in skills]).cast("array<string>")
    hits = knn_postfiltered(docs, query, k)
    return hits.select(
        "job_id",
        "title",
        "company",
        "location",
        F.round(vectors.cosine_score(F.col("cosine")), 6).alias("score"),
        arrays.present(F.col("skills_required"), confirmed).alias("have"),
        arrays.missing(F.col("skills_required"), confirmed).alias("missing"),
    )
