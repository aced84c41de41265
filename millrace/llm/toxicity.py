"""Toxicity as ordered severity grades: cumulative-link regression on sparse text features.

Features are words and word beginnings, hashed into 2**22 buckets; none is left out but those that too few texts hold.
One weight vector is shared by all thresholds, P(grade > k) = sigmoid(w x - theta_k), and the fit maximises the
likelihood of the grades themselves, log(P(grade > k - 1) - P(grade > k)), less a ridge penalty. Grades come from the
labels: 0 for clean texts, 1 for toxic ones, 2 for toxic ones that are labelled bad as well.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.labelled import MOST_LABELLED, sample
from millrace.workspace import discard, materialise

#: Bytes of a word's beginning that make a feature of their own, besides the whole word.
BEGINNINGS = (4, 5, 6)
FEATURE_BITS = 22
#: Sampled texts that a feature is learnt from at least.
MIN_SUPPORT = 4
#: Log-likelihood ratio at which a feature's ridge penalty is 1; surer features are penalised less, others more.
PLAIN_G2 = 3.0
STEPS = 80
#: Texts whose features are widened to doubles at a time.
FIT_TEXTS = 1024
NEW = "expected_severity double, severity int, toxic_probability double"


def buckets_of(slab: K.Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket), sorted, with the logarithm of one more than its count."""
    data = K.LOWER[slab.data]
    starts, ends, first = K.spans(data, slab.bounds, K.NOT_ALNUM)
    hashes = [K.hash_spans(data, starts, ends)]
    hashes += [K.mix(K.hash_spans(data, starts, np.minimum(ends, starts + n)) + K.U(n)) for n in BEGINNINGS]
    owner = np.repeat(np.arange(slab.rows, dtype=np.int64), np.diff(first)) << FEATURE_BITS
    keys, counts = np.unique(np.concatenate([owner + (h >> K.U(64 - FEATURE_BITS)).astype(np.int64) for h in hashes]), return_counts=True)
    return keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1), np.log1p(counts)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ascending: the first, then sums of exponentials."""
    return raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def ordinal(eta: np.ndarray, raw: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the grades, and its gradients by ``eta`` and ``raw``."""
    theta = thresholds(raw)
    over = np.ones((len(eta), len(theta) + 2))
    over[:, 1:-1] = sigmoid(eta[:, None] - theta[None, :])
    over[:, -1] = 0.0
    slope = over * (1 - over)
    at = np.arange(len(eta))
    p = np.maximum(over[at, grade] - over[at, grade + 1], 1e-12)
    high, low = slope[at, grade] / p, slope[at, grade + 1] / p
    by_theta = np.array([high[grade == k + 1].sum() - low[grade == k].sum() for k in range(len(theta))])
    gaps = np.exp(raw[1:])
    by_raw = np.concatenate(([by_theta.sum()], [gaps[k] * by_theta[k + 1 :].sum() for k in range(len(gaps))]))
    return -np.log(p).sum(), -(high - low), by_raw


def minimise(f: Callable, x: np.ndarray, steps: int = STEPS, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search; fixed start, so reruns agree."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            d = d + (alpha - rho * (y @ d)) * s
        slope = g @ d
        if slope >= 0:
            d, slope, pairs = -g, -(g @ g), []
        t = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(40):
            after, new = f(x + t * d)
            if after <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y, 1 / (s @ y))]
        moved = value - after
        x, value, g = x + s, after, new
        if moved <= 1e-6 * max(1.0, abs(value)):
            break
    return x


def fit(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, n_features: int, grade: np.ndarray, penalty: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds. Text i has the features ``starts[i]`` to ``starts[i + 1]``."""
    levels = int(grade.max())
    cuts = range(0, len(grade), FIT_TEXTS)

    def objective(x):
        w, raw = x[:n_features], x[n_features:]
        value, g = 0.5 * float(penalty @ (w * w)), np.concatenate((penalty * w, np.zeros(levels)))
        for k in cuts:
            rows = starts[k : k + FIT_TEXTS + 1]
            c, v = columns[rows[0] : rows[-1]], values[rows[0] : rows[-1]]
            sizes = np.diff(rows)
            eta = np.zeros(len(sizes))
            if len(c):
                eta[sizes > 0] = np.add.reduceat(v * w[c], (rows[:-1] - rows[0])[sizes > 0])
            loss, by_eta, by_raw = ordinal(eta, raw, grade[k : k + FIT_TEXTS])
            value += loss
            g[:n_features] += np.bincount(c, weights=v * np.repeat(by_eta, sizes), minlength=n_features)
            g[n_features:] += by_raw
        return value, g

    share = np.array([(grade > k).mean() for k in range(levels)])
    start = -np.log(share / (1 - share))
    raw = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    x = minimise(objective, np.concatenate((np.zeros(n_features), raw)), steps)
    return x[:n_features], thresholds(x[n_features:])


def g2(seen: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each feature's texts by grade against the texts' own shares."""
    expected = seen.sum(axis=1, keepdims=True) * (totals / totals.sum())[None, :]
    return 2 * (seen * np.log(np.where(seen > 0, seen / np.maximum(expected, 1e-300), 1.0))).sum(axis=1)


def weighed(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, names: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A weight for each bucket, and thresholds; None where there are no two grades or no feature. ``names[columns]`` are the buckets."""
    present, grade = np.unique(grade, return_inverse=True)
    if len(present) < 2 or present[0] != 0 or not len(names):
        return None
    seen = np.zeros(len(present) * len(names))
    for k in range(0, len(grade), FIT_TEXTS):
        rows = starts[k : k + FIT_TEXTS + 1]
        owner = np.repeat(grade[k : k + FIT_TEXTS] * len(names), np.diff(rows))
        seen += np.bincount(owner + columns[rows[0] : rows[-1]], minlength=len(seen))
    sure = g2(seen.reshape(len(present), len(names)).T, np.bincount(grade).astype(float))
    w, theta = fit(starts, columns, values, len(names), grade, PLAIN_G2 / np.maximum(sure, 1e-2))
    out = np.zeros(1 << FEATURE_BITS, np.float32)
    out[names] = w
    return out, theta


def places(names: np.ndarray) -> np.ndarray:
    """Where each bucket stands in ``names``, or -1."""
    out = np.full(1 << FEATURE_BITS, -1, np.int32)
    out[names] = np.arange(len(names), dtype=np.int32)
    return out


def learnt(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """``weighed`` of the supported ones among all features of the texts."""
    names = np.flatnonzero(np.bincount(columns, minlength=1 << FEATURE_BITS) >= MIN_SUPPORT)
    columns = places(names)[columns]
    upto = np.concatenate(([0], np.cumsum(columns >= 0)))
    return weighed(upto[starts], columns[columns >= 0], values[columns >= 0], names, grade)


def packed(texts) -> list[pa.Array]:
    columns, values, sizes = [], [], []
    for slab in K.slabs(texts):
        rows, c, v = buckets_of(slab)
        sizes.append(np.bincount(rows, minlength=slab.rows))
        columns.append(c.astype(np.int32))
        values.append(v.astype(np.float32))
    ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1), pa.int32())
    whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
    return [pa.ListArray.from_arrays(ends, whole(columns, pa.int32())), pa.ListArray.from_arrays(ends, whole(values, pa.float32()))]


def blobs(texts) -> list[pa.Array]:
    """``packed`` with each text's features as bytes, which reach the driver without an object for each."""
    blob = lambda lists: pa.Array.from_buffers(
        pa.binary(), len(lists), [None, pa.py_buffer(4 * lists.offsets.to_numpy()), pa.py_buffer(lists.flatten().to_numpy())]
    )
    return [blob(lists) for lists in packed(texts)]


def supported(features: DataFrame) -> tuple[np.ndarray, int]:
    """Buckets that MIN_SUPPORT texts hold, ascending, and how many features of texts lie in them."""

    def counts(batches):
        for batch in batches:
            names, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["bucket", "n"])

    seen = features.select("c").mapInArrow(counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most a row a bucket, and no more than a quarter of the sample's features.
    rows = seen.filter(F.col("n") >= MIN_SUPPORT).toArrow()
    return np.sort(rows["bucket"].to_numpy()), int(rows["n"].to_numpy().sum())


def graded(labels: DataFrame, label: str, worse: str | None) -> DataFrame:
    """(doc_id, label) with the grade as label: 0 clean, 1 toxic, 2 toxic and bad by the column ``worse``."""
    toxic = F.col(label).cast("int")
    grade = toxic if worse is None else F.when(toxic > 0, 1 + F.coalesce((F.col(worse) == 0).cast("int"), F.lit(0))).otherwise(toxic)
    return labels.select("doc_id", grade.alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str, worse: str | None, most: int):
    """(weights by bucket, thresholds), or None where the sample can't tell grades apart."""
    known = materialise(sample(docs, graded(labels, label, worse), "label", most), "toxicity-sample")
    features = materialise(K.map_texts(known, "c binary, v binary", blobs, carry=["doc_id", "label"]), "toxicity-features")
    names, total = supported(features)
    place, columns, values = places(names), np.empty(total, np.int32), np.empty(total, np.float32)
    starts, grade = [0], []
    # Bounded by the sample, and a partition comes at a time. Ids are distinct in it, and their order makes the fit's sums
    # the same in every run.
    for row in features.orderBy("doc_id").toLocalIterator():
        at = place[np.frombuffer(row["c"], np.int32)]
        kept = at >= 0
        end = starts[-1] + int(kept.sum())
        columns[starts[-1] : end] = at[kept]
        values[starts[-1] : end] = np.frombuffer(row["v"], np.float32)[kept]
        starts.append(end)
        grade.append(row["label"])
    discard(known, features)
    return weighed(np.array(starts), columns, values, names, np.array(grade, np.int64))


def severity_of(texts, model) -> list[pa.Array]:
    if model is None:
        zero = np.zeros(len(texts))
        return [pa.array(zero, pa.float64()), pa.array(zero.astype(np.int32), pa.int32()), pa.array(zero, pa.float64())]
    w, theta = model
    parts = []
    for slab in K.slabs(texts):
        rows, columns, values = buckets_of(slab)
        # Rounded, since sums of the same values may differ by their order elsewhere.
        eta = np.round(np.bincount(rows, weights=values * w[columns], minlength=slab.rows), 9)
        parts.append(sigmoid(eta[:, None] - theta[None, :]))
    over = np.concatenate(parts) if parts else np.empty((0, len(theta)))
    return [pa.array(over.sum(axis=1), pa.float64()), pa.array((over >= 0.5).sum(axis=1).astype(np.int32), pa.int32()), pa.array(over[:, 0], pa.float64())]


def severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", worse: str | None = "quality", most: int = MOST_LABELLED, carry=None) -> DataFrame:
    """``docs`` with expected_severity, severity (grade, 0 to 2), toxic_probability and toxic.

    Null and empty texts hold no feature and get the base rate, which is below a half where most texts are clean; very
    long ones are read whole. Repeated rows and rows without doc_id are graded each by its text; of rows that share a
    labelled id one text is trained on, and labels that contradict each other count as their least. Without usable labels
    all is 0. An empty table gives an empty result. Columns of the new names are replaced; all others pass unchanged.
    """
    model = train(docs, labels, label, worse, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {"expected_severity", "severity", "toxic_probability", "toxic"}]
    rows = docs.select(K.boxed(names), K.column("text").alias("text"))
    out = K.map_texts(rows, NEW, lambda texts: severity_of(texts, shared.value), carry=["row"])
    return out.select(*K.unboxed(names), "expected_severity", "severity", "toxic_probability", (F.col("toxic_probability") >= 0.5).alias("toxic"))
