"""Benchmark passages in training texts.

The windows of the test items go into a hash index that every task gets; each task looks up all windows of its texts and
verifies every hit word by word. Broadcast blocks are bounded: a larger benchmark is cut into blocks, each looked up in a
pass of its own. Beyond a few blocks, windows travel: what a map of bits of the test windows lets pass, of each text, is
joined with them by hash and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import kernel as K
from millrace.llm.labelled import bit_map, map_size
from millrace.llm.skew import spread_join
from millrace.workspace import discard, materialise

WINDOW = 10
#: Text bytes of test items in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Blocks that are looked up in passes of their own; with more, windows are joined.
MOST_PASSES = 4
#: Words of a piece that a longer item is cut into.
PIECE_WORDS = 50_000
#: Runs of digits, a-z and characters beyond ASCII, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Log2 of the entries in the first look-up table.
FILTER_BITS = 22

FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


class Windows(NamedTuple):
    """Windows of one length. Those of equal words are one group; groups are sorted by hash."""

    filter: np.ndarray
    keys: np.ndarray  # a group's hash
    heads: np.ndarray  # first word of a group's first window
    cuts: np.ndarray  # where a group's owners begin, one more than groups
    owners: np.ndarray  # items of each group, by number


class Index(NamedTuple):
    """Arrays only: a window costs about 32 bytes and a word its bytes and 8, so a block of text bounds the index."""

    items: list[str]
    data: bytes  # all words, each followed by a space
    starts: np.ndarray  # of the words in data, one more than words
    windows: dict[int, Windows]

    def text(self, word: int, n: int) -> bytes:
        return self.data[self.starts[word] : self.starts[word + n] - 1]


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW) -> Index:
    """Items with fewer words than a window are one window of their own length; items without words have none."""
    raw = [(text or "").encode() for _, text in items]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    data = K.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, first = K.spans(data, bounds, K.NOT_ALNUM)
    words = K.hash_spans(data, starts, ends)
    whole = data.tobytes()
    packed = b"".join([whole[s:e] + b" " for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    index = Index([item for item, _ in items], packed, np.concatenate(([0], np.cumsum(ends - starts + 1))), {})
    owner = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(first))
    lengths = np.minimum(np.diff(first), window)
    for n in np.unique(lengths[lengths > 0]).tolist():
        hashed = K.ngram_hashes(words, n)
        inside = K.windows_inside(first, len(words), n)[: len(hashed)] & (lengths[owner[: len(hashed)]] == n)
        index.windows[n] = grouped(index, n, np.flatnonzero(inside), hashed, owner)
    return index


def grouped(index: Index, n: int, at: np.ndarray, hashed: np.ndarray, owner: np.ndarray) -> Windows:
    at = at[np.argsort(hashed[at], kind="stable")]
    keys = hashed[at]
    head = np.searchsorted(keys, keys)
    # Windows of one hash but other words get a number of their own beside the hash.
    other = np.zeros(len(at), np.int32)
    numbers: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(head != np.arange(len(at))).tolist():
        words = index.text(at[k], n)
        if words != index.text(at[head[k]], n):
            other[k] = numbers.setdefault((int(keys[k]), words), len(numbers) + 1)
    order = np.lexsort((owner[at], other, keys))
    at, keys, other = at[order], keys[order], other[order]
    own = owner[at]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])))
    kept = new | np.concatenate(([True], own[1:] != own[:-1]))
    groups = np.flatnonzero(new)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(keys[groups] >> K.U(64 - FILTER_BITS)).astype(np.int64)] = True
    cuts = np.concatenate((np.flatnonzero(new[kept]), [kept.sum()]))
    return Windows(maybe, keys[groups], at[groups].astype(np.int32), cuts, own[kept])


def scan(slab: K.Slab, index: Index, known=None):
    """Words a text, covered words a text, ids a text, and the byte spans of covered runs a text.

    ``known``: for each text the ids and spans that were found before, or None; they count as found here.
    """
    data = K.LOWER[slab.data]
    starts, ends, first = K.spans(data, slab.bounds, K.NOT_ALNUM)
    words = K.hash_spans(data, starts, ends)
    cover = np.zeros(len(words) + 1, np.int32)
    ids: dict[int, set[str]] = {}
    seen: set[tuple[int, int, int]] = set()
    for row, (items, spans) in enumerate(known or ()):
        if items:
            ids[row] = set(items)
        for s in spans or ():
            a, b = np.searchsorted(starts, [slab.bounds[row] + s["start"], slab.bounds[row] + s["end"]])
            cover[a] += 1
            cover[b] -= 1
    for n, found in index.windows.items():
        hashed = K.ngram_hashes(words, n)
        maybe = np.flatnonzero(found.filter[(hashed >> K.U(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[K.windows_inside(first, len(words), n)[maybe]]
        at = np.searchsorted(found.keys, hashed[maybe])
        at[at == len(found.keys)] = 0
        same = found.keys[at] == hashed[maybe]
        for i, k in zip(maybe[same].tolist(), at[same].tolist(), strict=True):
            here = b" ".join([data[starts[j] : ends[j]].tobytes() for j in range(i, i + n)])
            while k < len(found.keys) and found.keys[k] == hashed[i]:
                if index.text(found.heads[k], n) == here:
                    cover[i] += 1
                    cover[i + n] -= 1
                    seen.add((int(np.searchsorted(first, i, "right")) - 1, n, k))
                    break
                k += 1
    for row, n, k in seen:
        found = index.windows[n]
        ids.setdefault(row, set()).update(index.items[i] for i in found.owners[found.cuts[k] : found.cuts[k + 1]].tolist())
    covered = np.cumsum(cover[:-1]) > 0
    return np.diff(first), K.per_text(covered.astype(np.int64), first), ids, runs(covered, first, starts, ends, slab.bounds)


def runs(covered, first, starts, ends, bounds) -> dict[int, list[tuple[int, int]]]:
    """Byte spans, from the text's start, of runs of covered words."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(covered & (np.concatenate(([True], ~covered[:-1])) | edge[:-1])) if len(covered) else []
    finish = np.flatnonzero(covered & (np.concatenate((~covered[1:], [True])) | edge[1:])) if len(covered) else []
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(begin, finish, strict=True):
        row = int(np.searchsorted(first, a, "right")) - 1
        out.setdefault(row, []).append((int(starts[a] - bounds[row]), int(ends[b] - bounds[row])))
    return out


class Blocks(NamedTuple):
    """Items dealt into ``n`` blocks; only one at a time is on the driver."""

    numbered: DataFrame
    n: int

    def __len__(self) -> int:
        return self.n

    def each(self) -> Iterator[list[tuple[str, str | None]]]:
        for k in range(self.n):
            yield [(row["i"], row["t"]) for row in self.numbered.filter(F.col("b") == k).collect()]


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int, piece_words: int = PIECE_WORDS) -> Blocks:
    """Blocks of about ``block_bytes``, their number taken from a size counted before anything is fetched.

    Items go down to their words. Those without any aren't fetched, equal rows are fetched once, and a long item is cut
    into pieces that overlap by a window less a word, so that no row is large and no window is lost.
    """
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), words.alias("w")).filter(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(piece_words))
    pieces = F.transform(begins, lambda k: F.array_join(F.slice("w", k, F.lit(piece_words + window - 1)), " "))
    rows = items.select("i", F.explode(pieces).alias("t")).distinct()
    rows = materialise(rows, "benchmark-items")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return Blocks(rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n)


def item_windows(rows: DataFrame, window: int) -> DataFrame:
    """(h, n, w, i) of items (i, t): hash, length and words of each window, with its item, once."""

    def run(batches):
        for batch in batches:
            for slab in K.slabs(batch.column(1)):
                starts, ends, first = K.spans(slab.data, slab.bounds, K.NOT_ALNUM)
                words = K.hash_spans(slab.data, starts, ends)
                owner, lengths = np.repeat(np.arange(slab.rows), np.diff(first)), np.minimum(np.diff(first), window)
                for n in np.unique(lengths[lengths > 0]).tolist():
                    hashed = K.ngram_hashes(words, n)
                    at = np.flatnonzero(K.windows_inside(first, len(words), n)[: len(hashed)] & (lengths[owner[: len(hashed)]] == n))
                    said = [slab.data[starts[k] : ends[k + n - 1]].tobytes().decode() for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(hashed[at].view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(said, pa.string()), batch.column(0).take(pa.array(owner[at] + slab.first))], ["h", "n", "w", "i"])

    # Items came down to words with one blank between, so a window's bytes are its words.
    return rows.select("i", "t").mapInArrow(run, "h long, n int, w string, i string").distinct()


def text_windows(staged: DataFrame, bits, size: int, lengths: list[int]) -> DataFrame:
    """(id, h, n, w, start, end) of the windows of texts that the map of bits lets pass; bytes from the text's start."""
    shift = K.U(64 - (size.bit_length() - 1))

    def run(batches):
        for batch in batches:
            for slab in K.slabs(batch.column(1)):
                data = K.LOWER[slab.data]
                starts, ends, first = K.spans(data, slab.bounds, K.NOT_ALNUM)
                words = K.hash_spans(data, starts, ends)
                owner = np.repeat(np.arange(slab.rows), np.diff(first))
                for n in lengths:
                    hashed = K.ngram_hashes(words, n)
                    place = (hashed >> shift).astype(np.int64)
                    maybe = (bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                    at = np.flatnonzero(maybe & K.windows_inside(first, len(words), n)[: len(hashed)])
                    said = [b" ".join([data[starts[j] : ends[j]].tobytes() for j in range(k, k + n)]).decode() for k in at.tolist()]
                    base = slab.bounds[owner[at]]
                    columns = [pa.array(hashed[at].view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(said, pa.string()), pa.array(starts[at] - base), pa.array(ends[at + n - 1] - base)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at] + slab.first)), *columns], ["id", "h", "n", "w", "start", "end"])

    return staged.select("id", "text").mapInArrow(run, "id long, h long, n int, w string, start long, end long")


def joined_windows(staged: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(id, ids, places) of the texts with hits, for a benchmark of any size: one pass and a join by hash and words."""
    known = materialise(item_windows(items, window), "benchmark-windows")
    size = map_size(known.count())
    bits = bit_map(known.select(F.shiftrightunsigned("h", 64 - (size.bit_length() - 1)).alias("place")), size)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # as many as a window has words, at most
    shared = staged.sparkSession.sparkContext.broadcast(bits)
    said = materialise(text_windows(staged, shared, size, lengths), "text-windows")
    hit = spread_join(said, known, ["h", "n", "w"], ["id", "start"], said.count())
    place = F.struct("start", "end")
    found = hit.groupBy("id").agg(F.collect_set("i").alias("ids"), F.collect_set(place).alias("places"))
    found = materialise(found, "hits-joined")
    discard(known, said)
    return found


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry=None) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurring window), items (ids, sorted) and spans (bytes, end exclusive).

    One row a row of ``docs``, repeated rows included. Null and empty texts have no words and no hits; very long ones are
    searched whole. An empty benchmark, or items of null or without words, hit nothing; items of one text are all named;
    an item without id counts as "". An empty table gives an empty result. Columns of the new names are replaced; all
    others pass unchanged, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    new = T._parse_datatype_string(FIELDS).names
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    blocks = item_blocks(benchmark, window, block_bytes)
    rows = docs.select(K.boxed(names), docs["text"].cast("string").alias("text"))
    if len(blocks) == 1:
        shared = sc.broadcast(build_index(next(blocks.each()), window))
        discard(blocks.numbered)
        done = K.map_texts(rows, FIELDS, lambda texts: look_up(texts, shared.value), carry=["row"])
        return done.select(*K.unboxed(names), *new)
    # Rows get a number and are written once; each block's pass brings out only the rows that it hits.
    staged = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "hits-rows")
    if len(blocks) > MOST_PASSES:
        together = joined_windows(staged, blocks.numbered, window)
    else:
        found = []
        for block in blocks.each():
            shared = sc.broadcast(build_index(block, window))
            part = K.map_texts(staged, FIELDS, lambda texts, shared=shared: look_up(texts, shared.value), carry=["id"])
            found.append(materialise(part.filter("n_hit > 0").select("id", "items", "spans"), "hits-block"))
            shared.unpersist()
        together = reduce(DataFrame.union, found).groupBy("id").agg(F.flatten(F.collect_list("items")).alias("ids"), F.flatten(F.collect_list("spans")).alias("places"))
        together = materialise(together, "hits-found")
        discard(*found)
    discard(blocks.numbered)
    nothing = build_index([], window)
    merged = K.map_texts(staged.join(together, "id", "left"), FIELDS, lambda *columns: look_up(columns[0], nothing, *columns[1:]), carry=["row"], extra=("ids", "places"))
    return merged.select(*K.unboxed(names), *new)


def look_up(texts, index: Index, items=None, spans=None) -> list[pa.Array]:
    """The columns of FIELDS. ``items`` and ``spans``: what was found in these texts before."""
    before = list(zip(items.to_pylist(), spans.to_pylist(), strict=True)) if items is not None else None
    n_words, n_hit, found, covered = [], [], [], []
    for slab in K.slabs(texts):
        words, hit, ids, spans_ = scan(slab, index, before and before[slab.first : slab.first + slab.rows])
        n_words.append(words)
        n_hit.append(hit)
        found += [sorted(ids.get(i, ())) for i in range(slab.rows)]
        covered += [[{"start": a, "end": b} for a, b in spans_.get(i, ())] for i in range(slab.rows)]
    whole = lambda x: pa.array(np.concatenate(x) if x else np.empty(0), pa.int64())
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [whole(n_words), whole(n_hit), pa.array(found, pa.list_(pa.string())), pa.array(covered, pairs)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """Clean ``docs``, same columns: contaminated documents go (``documents``), or only the covered spans (``spans``).

    Rows are judged each by its own text, so repeated rows stay or go together; rows of null or empty text stay as they
    are, very long texts are searched whole, and an empty table stays empty. No column's name gets in the way.
    """
    rows = docs.select(K.boxed(docs.columns), F.col("text").cast("string").alias("text"))
    found = hits(rows, benchmark, window, carry=["row"] if remove == "documents" else ["row", "text"])
    if remove == "documents":
        return found.filter(F.col("n_hit") == 0).select(*K.unboxed(docs.columns))
    text = F.col("text").cast("binary")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col("spans"))
    after = lambda s, i: F.coalesce(F.try_element_at(F.col("spans"), (i + 1).cast("int"))["start"], F.octet_length("text").cast("long"))
    pieces = F.transform(edges, lambda s, i: F.substring(text, (s["end"] + 1).cast("int"), (after(s, i) - s["end"]).cast("int")).cast("string"))
    cut = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    return found.select(*[(cut if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
