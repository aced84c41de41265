"""Lines that many documents share, found with levelled runs of line hashes.

A line's key is met as 128 bits of BLAKE2. A run is a table bucketed and sorted by key hash. Each batch of documents is
reduced to its keys and merged against the runs: what no run holds (the anti-join) becomes a run of its own, so that every
key is in exactly one run; of keys that a run holds only the count goes on, into the updates beside the new run. When a
level has ``fanout`` runs they are merged into one of the next level.
"""

from __future__ import annotations

import uuid
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import kernel as K
from millrace.llm.labelled import maybe_in
from millrace.llm.skew import spread_join
from millrace.workspace import discard, drop, materialise, scratch

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
#: Batches of arrival that a table without any is dealt into.
BATCHES = 6
#: Keys of a bucket, about, and the most buckets that Spark takes.
BUCKET_KEYS = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
#: Shared keys (some 100 bytes each as a broadcast) up to which they are sent to the lines; with more, lines travel to them.
KEYS_SENT = 250_000
KEYS = ["k1", "k2"]
NEW = "n_lines long, n_dropped long, text_kept string"


def long_lines(slab: K.Slab, min_chars: int):
    """Of the lines whose key is long enough: text, line number in it, and 128 bits of key hash in two arrays."""
    data = K.LOWER[slab.data]
    starts, ends, first = K.spans(data, slab.bounds, K.LINE_END)
    solid = np.flatnonzero(~K.WHITE[data])
    left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = right > left
    owner = np.repeat(np.arange(slab.rows), np.diff(first))[some]
    whole_starts, left, right = starts[some], solid[left[some]], solid[right[some] - 1] + 1
    letters = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    long = letters[right] - letters[left] >= min_chars
    owner, left, right, whole_starts = owner[long], left[long], right[long], whole_starts[long]
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    number = breaks[whole_starts] - breaks[slab.bounds[owner]]
    view = memoryview(np.ascontiguousarray(data))
    digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return owner, number, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def document_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(batch, doc_id, k1, k2) of rows (batch, doc_id, text), once for each row and key."""

    def run(batches):
        for batch in batches:
            for slab in K.slabs(batch.column(2)):
                owner, _, k1, k2 = long_lines(slab, min_chars)
                order = np.lexsort((k2, k1, owner))
                owner, k1, k2 = owner[order], k1[order], k2[order]
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))[: len(owner)]
                at = pa.array(owner[new] + slab.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(k1[new]), pa.array(k2[new])], ["batch", "doc_id", *KEYS])

    old = rows.select("batch", "doc_id").schema.fields
    schema = T.StructType([*old, *[T.StructField(k, T.LongType()) for k in KEYS]])
    return rows.select("batch", "doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


class LineRuns:
    """The levelled store: tables (k1, k2, n, known) in the shared folder, which ``levels`` lists by name and path.

    ``known`` is false for a run's own keys, n being the rows of the batch that brought the key, and true for updates of
    keys that an earlier run holds. Tables are bucketed by key, so a batch meets the runs without moving them.
    """

    def __init__(self, spark: SparkSession, buckets: int = LEAST_BUCKETS, fanout: int = FANOUT) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        writer = rows.coalesce(self.buckets).write.format("parquet").partitionBy("known").bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
        writer.option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, tables: list[tuple[str, str]]) -> None:
        for name, path in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, path)

    def tables(self) -> list[tuple[str, str]]:
        return [t for level in self.levels for t in level]

    def _rows(self, tables, known: bool) -> list[DataFrame]:
        return [self.spark.table(name).filter(F.col("known") == known).select(*KEYS, "n") for name, _ in tables]

    def runs(self) -> list[DataFrame]:
        """(k1, k2, n) of each run; no key is in two of them."""
        return self._rows(self.tables(), False)

    def updates(self, tables=None) -> DataFrame | None:
        """(k1, k2, n): rows that later batches brought of keys that a run holds."""
        found = self._rows(self.tables() if tables is None else tables, True)
        return reduce(DataFrame.union, found).groupBy(*KEYS).agg(F.sum("n").alias("n")) if found else None

    def add(self, keys: DataFrame) -> None:
        """One batch, as rows of KEYS."""
        counted = keys.groupBy(*KEYS).agg(F.count("*").alias("n")).repartition(self.buckets, *KEYS)
        marks: list[Column] = []
        for i, run in enumerate(self.runs()):
            held = run.select(*KEYS, F.lit(True).alias(f"held{i}")).hint("merge")
            counted = counted.join(held, KEYS, "left")
            marks.append(F.col(f"held{i}"))
        self._write(counted.select(*KEYS, "n", F.coalesce(*marks, F.lit(False)).alias("known")), 0)
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                tables = self.levels[level]
                # Runs hold no key twice, so merging them is a union; updates add up.
                own = reduce(DataFrame.union, self._rows(tables, False)).withColumn("known", F.lit(False))
                both = own.unionByName(self.updates(tables).withColumn("known", F.lit(True)))
                self._write(both.repartition(self.buckets, *KEYS), level + 1)
                self.levels[level] = []
                self._drop(tables)

    def shared(self, least: int = MIN_DOCS) -> DataFrame:
        """Keys of at least ``least`` rows."""
        added = self.updates().select(*KEYS, F.col("n").alias("more")).repartition(self.buckets, *KEYS)
        found = [run.join(added, KEYS, "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= least).select(*KEYS) for run in self.runs()]
        return reduce(DataFrame.union, found)

    def clear(self) -> None:
        self._drop(self.tables())
        self.levels = []


def shared_lines(keys: DataFrame, batches: int, min_docs: int, fanout: int = FANOUT) -> DataFrame:
    """(k1, k2, last) of the keys that ``min_docs`` distinct documents hold, with the largest doc_id holding them.

    The runs count rows, which are no fewer than documents, so they give the candidates; those alone are counted by
    document.
    """
    spark = keys.sparkSession
    total = keys.count()
    store = LineRuns(spark, min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_KEYS))), fanout)
    for k in range(batches):
        store.add(keys.filter(F.col("batch") == k).select(*KEYS))
    candidates = materialise(store.shared(min_docs), "line-candidates")
    store.clear()
    rows = keys.select("doc_id", *KEYS)
    if candidates.count() <= KEYS_SENT:
        held = rows.join(F.broadcast(candidates), KEYS)
    else:
        held = spread_join(rows, candidates, KEYS, ["doc_id"], total)
    counted = held.distinct().groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    shared = materialise(counted.filter(F.col("n") >= min_docs).select(*KEYS, "last"), "shared-lines")
    discard(candidates)
    return shared


def without_lines(texts: pa.Array, gone) -> list[pa.Array]:
    """n_lines, n_dropped and the text that is left. ``gone(slab, rows' first)`` gives text and number of lines to drop."""
    n_lines, n_dropped, changed = [], np.zeros(len(texts), np.int64), {}
    for slab in K.slabs(texts):
        n_lines.append(K.per_text((slab.data == 10).astype(np.int64), slab.bounds) + 1)
        owner, number = gone(slab)
        cuts = np.searchsorted(owner, np.arange(slab.rows + 1))
        for i in np.unique(owner).tolist():
            out = set(number[cuts[i] : cuts[i + 1]].tolist())
            at = slab.first + i
            n_dropped[at] = len(out)
            changed[at] = "\n".join(line for n, line in enumerate(texts[at].as_py().split("\n")) if n not in out)
    kept = texts.fill_null("")
    if changed:
        mask = np.zeros(len(texts), bool)
        mask[list(changed)] = True
        kept = pc.replace_with_mask(kept, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], kept.type))
    return [pa.array(np.concatenate(n_lines) if n_lines else np.empty(0), pa.int64()), pa.array(n_dropped), kept.cast(pa.string())]


def drop_sent(rows: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """Lines dropped where the shared keys, few enough, are sent to all tasks. ``rows``: row, doc_id, text."""
    table = shared.toArrow()
    k1, k2, last = (table[c].to_numpy() for c in (*KEYS, "last"))
    order = np.lexsort((k2, k1))
    known = rows.sparkSession.sparkContext.broadcast((k1[order], k2[order], last[order]))

    def handle(texts, ids):
        k1, k2, last = known.value
        own = ids.fill_null(np.iinfo(np.int64).max).to_numpy()

        def gone(slab):
            owner, number, a, b = long_lines(slab, min_chars)
            at = np.searchsorted(k1, a)
            hit = np.flatnonzero((at < len(k1)) & (k1[np.minimum(at, len(k1) - 1)] == a)) if len(k1) else np.empty(0, np.int64)
            at = at[hit]
            # Keys of one first half are few, if ever more than one.
            while True:
                on = np.flatnonzero((at + 1 < len(k1)) & (k2[at] != b[hit]))
                on = on[k1[at[on] + 1] == a[hit[on]]]
                if not len(on):
                    break
                at[on] += 1
            same = (k2[at] == b[hit]) & (own[slab.first + owner[hit]] < last[at]) if len(hit) else np.zeros(0, bool)
            return owner[hit[same]], number[hit[same]]

        return without_lines(texts, gone)

    return K.map_texts(rows.withColumn("doc_id", F.col("doc_id").cast("long")), NEW, handle, carry=["row"], extra=("doc_id",))


def drop_joined(rows: DataFrame, keys: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """Lines dropped by a join: of the texts, hardly any but those that lose lines travel."""
    held = spread_join(keys.select("doc_id", *KEYS), shared, KEYS, ["doc_id"], keys.count())
    # A document's own keys: bounded by its lines.
    lists = held.filter(F.col("doc_id") < F.col("last")).groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias("gone"))
    lists = materialise(lists, "line-drops")
    touched = maybe_in(F.col("doc_id"), lists.select("doc_id"))
    nothing = F.array().cast(lists.schema["gone"].dataType)
    some = rows.filter(touched).join(lists.hint("shuffle_hash"), "doc_id", "left").select("row", "text", F.coalesce("gone", nothing).alias("gone"))
    rest = rows.filter(~touched).select("row", "text", nothing.alias("gone"))

    def handle(texts, lists):
        drops = lists.to_pylist()

        def gone(slab):
            owner, number, k1, k2 = long_lines(slab, min_chars)
            mine = [{(d["k1"], d["k2"]) for d in drops[slab.first + i]} for i in range(slab.rows)]
            same = np.array([(a, b) in mine[i] for i, a, b in zip(owner.tolist(), k1.tolist(), k2.tolist(), strict=True)], bool)
            return owner[same], number[same]

        return without_lines(texts, gone)

    return K.map_texts(some.unionByName(rest), NEW, handle, carry=["row"], extra=("gone",))


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_sent: int = KEYS_SENT) -> DataFrame:
    """``docs`` with text_kept, n_lines and n_dropped.

    A line's key is the line stripped of ASCII whitespace, A-Z lower-cased. Keys of ``min_chars`` code points held by
    ``min_docs`` distinct documents lose their lines everywhere but in the largest doc_id holding them. ``batches`` are
    the parts of ``docs`` in order of arrival, or a number of parts to deal it into by hash; the result doesn't depend on
    them. Null and empty texts are one empty line and become empty text; very long ones are taken whole. A document
    without doc_id counts nowhere and loses nothing; rows that share a doc_id count as one document and have the same keys
    dropped. An empty table gives an empty result. Columns of the new names are replaced; all others pass unchanged.
    """
    names = K.others(docs, T._parse_datatype_string(NEW).names)
    if isinstance(batches, int):
        n, arrived = batches, docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "text")
    else:
        n, arrived = len(batches), reduce(DataFrame.union, [b.select(F.lit(k).alias("batch"), "doc_id", "text") for k, b in enumerate(batches)])
    path = scratch(docs.sparkSession, "line-keys")
    found = document_keys(arrived.filter("doc_id IS NOT NULL"), min_chars)
    found.write.partitionBy("batch").parquet(path)
    keys = docs.sparkSession.read.schema(found.schema).parquet(path)
    shared = shared_lines(keys, n, min_docs)
    rows = docs.select(K.boxed(names), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and shared.count() <= keys_sent:
        done = drop_sent(rows, shared, min_chars)
    else:
        done = drop_joined(rows, keys, shared, min_chars)
    discard(shared)
    drop(docs.sparkSession, path)
    return done.select(*K.unboxed(names), "n_lines", "n_dropped", "text_kept")
