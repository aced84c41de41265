"""Vector expressions over ``array<float>``; arithmetic in double."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bound


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalise(vector: Column) -> Column:
    """Unit length in single precision; a zero vector stays as it is."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n).cast("float"))
    return bound(vector, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def cosine(left: Column, right: Column) -> Column:
    """Null where either vector has length 0."""
    return dot(left, right) / F.nullif(norm(left) * norm(right), F.lit(0.0))


def cosine_score(cos: Column) -> Column:
    """The 0..1 score that document indexes publish for a cosine."""
    return (F.lit(1.0) + cos) / 2


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def hashing_encoder(text: Column, dims: int = 384) -> Column:
    """Signed feature hashing of lower-cased words, unit length: a stand-in where no sentence model is at hand.

    It is deterministic and needs no Python worker; it makes no claim on retrieval quality.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}+#.]+"), lambda w: w != "")
    coded = F.transform(words, lambda w: F.xxhash64(w))
    sign = lambda h: F.when(F.shiftright(h, 62).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    slot = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dims)) == i), F.lit(0.0), lambda total, h: total + sign(h))
    raw = bound(coded, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: slot(hs, i)))
    return l2_normalise(raw)


def hashing_encode(text: str, dims: int = 384) -> list[float]:
    """A driver-side encoder for tests that need any deterministic vector."""
    out = [0.0] * dims
    for word in text.lower().split():
        code = zlib.crc32(word.encode())
        out[code % dims] += 1.0 if code & 0x10000 else -1.0
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out] if size else out
