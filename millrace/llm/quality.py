"""Quality rules: counts that fail a text outright, and a hashed n-gram log-likelihood ratio for the rest.

Byte 4-grams are hashed into buckets. One multinomial is counted over all trusted texts, one over all texts; a
text's score is the mean log ratio of its n-grams, drawn towards 0 for short texts. Every text is held against one
fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.labelled import everyone
from millrace.workspace import discard, materialise

GRAM = 4
BUCKET_BITS = 14
#: N-grams of evidence for "no difference" that every text starts with.
PRIOR_GRAMS = 40
#: Share of trusted texts that the threshold may cost at most.
MAX_LOSS = 0.002
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def grams(slab: K.Slab) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 4-gram at each byte, and whether it ends in the same text."""
    data = slab.data.astype(np.uint32)
    n = len(data)
    if n < GRAM:
        return np.empty(0, np.int64), np.empty(0, bool)
    word = data[: n - 3] | data[1 : n - 2] << np.uint32(8) | data[2 : n - 1] << np.uint32(16) | data[3:] << np.uint32(24)
    word ^= word >> np.uint32(15)
    word *= np.uint32(0x2C1B3C6D)
    word ^= word >> np.uint32(12)
    word *= np.uint32(0x297A2D39)
    inside = np.ones(n - 3, bool)
    for k in range(1, GRAM):
        at = slab.bounds[1:-1] - k
        inside[at[(at >= 0) & (at < n - 3)]] = False
    return (word >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), inside


def count_grams(df: DataFrame) -> np.ndarray:
    """Counts by bucket over all texts: each task sends one row a bucket, the driver gets as many rows as buckets."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for slab in K.slabs(batch.column(0)):
                bucket, inside = grams(slab)
                total += np.bincount(bucket[inside], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = df.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def scores(slab: K.Slab, table: np.ndarray) -> np.ndarray:
    bucket, inside = grams(slab)
    values = np.zeros(len(slab.data))
    values[: len(bucket)] = np.where(inside, table[bucket], 0.0) if len(bucket) else 0.0
    number = np.maximum(np.diff(slab.bounds) - GRAM + 1, 0)
    # Rounded, since sums along a slab leave traces of the texts before.
    return np.round(K.per_text(values, slab.bounds) / (number + PRIOR_GRAMS), 9)


def repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(slab: K.Slab) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data = slab.data
    starts, ends, first = K.spans(data, slab.bounds, K.WHITE)
    number = np.diff(first)
    owner = np.repeat(np.arange(slab.rows), number)
    white = K.WHITE[data]
    salt = K.mix(np.arange(slab.rows, dtype=K.U) + K.U(1))
    words = K.hash_spans(data, starts, ends)
    triples = K.ngram_hashes(words, 3)
    ok = K.windows_inside(first, len(words), 3)[: len(triples)]
    at = np.flatnonzero(ok)
    again = at[repeats(K.mix(triples[at] ^ salt[owner[at]]))]
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, np.minimum(again + 3, len(words)), -1)
    lines, line_ends, line_first = K.spans(data, slab.bounds, K.LINE_END)
    seen = np.concatenate(([0], np.cumsum(~white)))
    worded = seen[line_ends] > seen[lines]
    line_owner = np.repeat(np.arange(slab.rows), np.diff(line_first))[worded]
    keys = K.mix(K.hash_spans(data, lines, line_ends)[worded] ^ salt[line_owner])
    distinct = np.unique(keys, return_index=True)[1]
    return {
        "n_words": number,
        "word_chars": K.per_text((~white & (data & 0xC0 != 0x80)).astype(np.int64), slab.bounds),
        "n_symbols": K.per_text(SYMBOLS[data].astype(np.int64), slab.bounds),
        "n_dup_lines": np.bincount(line_owner, minlength=slab.rows) - np.bincount(line_owner[distinct], minlength=slab.rows),
        "n_repeat_words": K.per_text((np.cumsum(cover[:-1]) > 0).astype(np.int64), first),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts, table: np.ndarray) -> list[pa.Array]:
    parts = [[*base_counts(slab).values(), scores(slab, table)] for slab in K.slabs(texts)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * 6
    return [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]


def score(texts, table: np.ndarray) -> list[pa.Array]:
    parts = [scores(slab, table) for slab in K.slabs(texts)]
    return [pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())]


def threshold(held: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """Of (label, score): between trusted and untrusted scores where they are told apart best, losing ``max_loss`` of the
    trusted at most.

    Without untrusted examples, the loss alone decides; without trusted ones nothing is rejected. Untrusted scores below
    a cut are only more at the next trusted score, so the best cut is one of the lowest trusted scores; those come to the
    driver, with the number and the highest of the untrusted scores between them.
    """
    trusted, untrusted = held.filter("label = 1"), held.filter("label <> 1")
    # A bound on the scores that are needed; the cut itself is exact.
    totals = trusted.agg(F.count("*").alias("n"), F.percentile_approx("score", min(1.0, 2 * max_loss), 10_000).alias("bound")).first()
    if not totals["n"]:
        return float("-inf")
    need = int(np.floor((totals["n"] - 1) * max_loss)) + 1
    for some in (trusted.filter(F.col("score") <= totals["bound"]), trusted):
        lowest = some.groupBy("score").agg(F.count("*").alias("n")).toArrow()
        order = np.argsort(lowest["score"].to_numpy())
        cuts, upto = lowest["score"].to_numpy()[order], np.cumsum(lowest["n"].to_numpy()[order])
        if len(upto) and upto[-1] >= need:
            break
    cuts = cuts[: np.searchsorted(upto, need) + 1]
    lost = np.concatenate(([0], upto))[: len(cuts)]

    def run(batches):
        number, highest = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, -np.inf)
        for batch in batches:
            values = batch.column(0).to_numpy()
            at = np.searchsorted(cuts, values, side="right")
            number += np.bincount(at, minlength=len(number))
            np.maximum.at(highest, at, values)
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(number[some]), pa.array(highest[some])], ["gap", "n", "highest"])

    gaps = untrusted.select("score").mapInArrow(run, "gap long, n long, highest double").groupBy("gap").agg(F.sum("n").alias("n"), F.max("highest").alias("highest")).collect()
    number, highest = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, -np.inf)
    for row in gaps:
        number[row["gap"]], highest[row["gap"]] = row["n"], row["highest"]
    if not number.any():
        return float(cuts[-1])
    gain = np.cumsum(number)[:-1] / number.sum() - lost / totals["n"]
    best = int(np.argmax(gain))
    below = max(float(highest[: best + 1].max()), float(cuts[best - 1]) if best else float("-inf"))
    return (float(cuts[best]) + below) / 2 if below > float("-inf") else float(cuts[best])


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", carry=None) -> DataFrame:
    """``docs`` with the five counts, score, base_failed and kept.

    Null text counts as empty, has no words and fails; very long texts are measured whole. Repeated rows and rows without
    doc_id are judged each by its text. Labels of one id that contradict each other count as their least, and of rows
    that share a labelled id one text speaks for it. With no trusted example nothing fails but by the counts. An empty
    table gives an empty result. Columns of the new names are replaced; all others pass unchanged, whatever their names.
    """
    known = materialise(everyone(docs, labels, label), "quality-labelled")
    trusted = count_grams(known.filter("label = 1"))
    table = log_ratio(trusted, count_grams(docs)) if trusted.any() else np.zeros(1 << BUCKET_BITS)
    held = materialise(K.map_texts(known, "score double", lambda texts: score(texts, table), carry=["label"]), "quality-scores")
    discard(known)
    cut = threshold(held)
    discard(held)
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {*COUNTS, "score", "base_failed", "kept"}]
    fields = ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    rows = docs.select(K.boxed(names), K.column("text").alias("text"))
    measured = K.map_texts(rows, fields, lambda texts: measure(texts, table), carry=["row"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    return measured.select(*K.unboxed(names), *COUNTS, "score", "base_failed", (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept"))
