"""Labelled documents: a bounded sample for training, or all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most; the hash order of ids picks them.
MOST_LABELLED = 20_000
#: Bits of the filter that keeps texts without a label from travelling; with more ids it lets more of them pass.
MOST_BITS = 1 << 26
BITS_AN_ID = 16
BLOCK = 1 << 15


def marks(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row an id. Labels that contradict each other count as their least value; nulls are left out."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))


def map_size(n: int) -> int:
    """Bits of a map of ``n`` ids, a power of two; more ids than it has room for only let more values pass."""
    size = BLOCK
    while size < min(n * BITS_AN_ID, MOST_BITS):
        size *= 2
    return size


def bit_map(places: DataFrame, size: int) -> np.ndarray:
    """Packed bits with those of ``places`` (place) set; a block of bits comes to the driver at a time, 8 MB in all at most."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, bool)
        bits[rows["place"].to_numpy() % BLOCK] = True
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    # A place once: what a block's task holds is bounded by the block.
    dealt = places.select("place").distinct().withColumn("block", F.floor(F.col("place") / BLOCK))
    out = np.zeros(size // 8, np.uint8)
    for row in dealt.groupBy("block").applyInPandas(block, "block long, bits binary").toLocalIterator():
        out[row["block"] * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def maybe_in(value: Column, known: DataFrame) -> Column:
    """False for most values that aren't in ``known``, a column of ids, and null; true for all that are."""
    size = map_size(known.count())
    shared = known.sparkSession.sparkContext.broadcast(bit_map(known.select(F.pmod(F.xxhash64(known.columns[0]), F.lit(size)).alias("place")), size))

    @F.pandas_udf("boolean")
    def holds(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return F.when(value.isNotNull(), holds(F.pmod(F.xxhash64(value), F.lit(size)))).otherwise(False)


def likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id isn't in ``known``; none that is goes."""
    if docs.schema["doc_id"].dataType != known.schema["doc_id"].dataType:
        return docs
    return docs.filter(maybe_in(F.col("doc_id"), known.select("doc_id")))


def everyone(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of all labelled documents, one row an id. Of the texts, hardly any without a label travels."""
    known = marks(labels, label)
    joined = likely(docs.select("doc_id", "text"), known).join(known.hint("shuffle_hash"), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents, one row an id.

    The ids are few by the bound, so they are broadcast and texts don't travel. Labels that contradict each other for an
    id count as their least value; null labels and ids without a document are left out.
    """
    known = marks(labels, label)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
