"""Vectorised byte kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in slabs of half a megabyte, so memory follows the slab and not the batch; a longer
text is a slab of its own. Spans of bytes are hashed together, eight bytes of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from millrace.session import BATCH_BYTES, BATCH_SETTING, tuned  # noqa: F401

U = np.uint64
SLAB = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but digits, a-z and bytes from 0x80 (after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LINE_END = np.zeros(256, bool)
LINE_END[10] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans of more bytes are hashed piece by piece.
PIECE = 512
STEP = U(0x9E3779B97F4A7C15)
SEED = U(0xD6E8FEB86659FD93)
#: What of eight bytes belongs to a span with 0 to 8 bytes left.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


class Slab(NamedTuple):
    first: int  # of the batch's rows
    data: np.ndarray  # bytes
    bounds: np.ndarray  # of the rows' bytes, one more than rows

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slabs(texts: pa.Array) -> Iterator[Slab]:
    """Runs of whole texts of about SLAB bytes; a longer text is a slab of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1)
        to = min(to, n)
        yield Slab(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separators, none across texts, and each text's first run (one more than texts)."""
    inside = ~separators[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per span: its bytes, eight at a time, go through a chain of finalisers that its length begins.

    A span of more than PIECE bytes is hashed by the hashes of its pieces, so that no chain is long. Memory follows the
    number of spans and pieces; only one copy of the bytes is made.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    size = ends - starts
    if not len(size) or size.max() <= PIECE:
        return chained(data, starts, size)
    number = np.maximum(1, -(-size // PIECE))
    first = np.concatenate(([0], np.cumsum(number)))
    owner = np.repeat(np.arange(len(size)), number)
    at = starts[owner] + (np.arange(first[-1]) - first[owner]) * PIECE
    parts = chained(data, at, np.minimum(ends[owner] - at, PIECE))
    out = parts[first[:-1]]
    long = np.flatnonzero(number > 1)
    whole = hash_spans(parts.view(np.uint8), first[long] * 8, first[long + 1] * 8)
    out[long] = mix(whole ^ size[long].astype(U) * STEP)
    return out


def chained(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hashes of the spans of ``left`` bytes from ``at``. Two aligned words make the eight bytes at any place."""
    words = np.zeros(len(data) // 8 + 2, np.dtype("<u8"))
    words.view(np.uint8)[: len(data)] = data
    out = mix(left.astype(U) * STEP + SEED)
    live = None
    while len(at):
        word, shift = at >> 3, ((at & 7) << 3).astype(U)
        eight = (words[word] >> shift | words[word + 1] << U(1) << (U(63) - shift)) & LEFT[np.minimum(left, 8)]
        if live is None:
            out, live = mix(out ^ eight), np.arange(len(at))
        else:
            out[live] = mix(out[live] ^ eight)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one run of words."""
    if len(words) < n:
        return np.empty(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    return mix(total)


def windows_inside(first: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """For each of ``n_words`` words, whether an n-word window starts there and ends in the same text."""
    ok = np.zeros(n_words + 1, np.int32)
    stop = np.maximum(first[1:] - n + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, stop, -1)
    return np.cumsum(ok[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's range."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def others(df, new) -> list[str]:
    """The columns of ``df`` but for those whose names, in any case, are in ``new``."""
    taken = {name.lower() for name in new}
    return [c for c in df.columns if c.lower() not in taken]


def column(name: str):
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def boxed(names):
    """The caller's columns as one struct, so that no name of theirs meets one of ours."""
    from pyspark.sql import functions as F

    return F.struct(*([column(c) for c in names] or [F.lit(None).cast("boolean").alias("nothing")])).alias("row")


def unboxed(names) -> list:
    from pyspark.sql import functions as F

    return [F.col("row").getField(c).alias(c) for c in names]


def map_texts(df, fields: str, handle, text: str = "text", carry=(), extra: tuple[str, ...] = ()):
    """``mapInArrow`` over ``df``: the columns of ``carry`` pass through, ``handle(texts, *extra)`` gives the new ones.

    ``handle`` takes the Arrow arrays of a batch, the texts as strings first, and returns one array per new field.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    names = list(carry)
    old = df.select(*names).schema
    slim = df.select(*names, df[text].cast("string").alias("_kernel_text"), *[df[c].alias(f"_kernel_{c}") for c in extra])

    def run(batches):
        for batch in batches:
            made = handle(*batch.columns[len(names) :])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, *new.names])

    return slim.mapInArrow(run, T.StructType([*old.fields, *new.fields]))
