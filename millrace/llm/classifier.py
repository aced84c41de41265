"""Quality classifier with hierarchical empirical Bayes.

A logistic model on text features gives each document's own evidence. Hosts and paths under them get posterior means,
grouped sums of that evidence shrunk towards the level above: few documents say little about a site. A document's verdict
adds the log odds of its path, against the corpus, to its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.labelled import MOST_LABELLED, sample
from millrace.llm.quality import SYMBOLS, base_counts
from millrace.llm.skew import spread_join
from millrace.workspace import materialise

HASHED = 256
RIDGE = 1.0
#: Rows that the fit widens to doubles at a time.
FIT_ROWS = 1024
#: How sure a document's own evidence can be, so that a site can't be silenced or silence.
CLIP = 1e-6
#: Scores are rounded to so many digits and summed as whole numbers, so that sums don't depend on the order of rows.
DIGITS = 9
STRENGTH = (1.0, 1e6)
NAMES = ("doc_score", "host_posterior", "path_posterior", "quality_score", "kept")


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


CLASSES = (byte_class((65, 90)), byte_class((97, 122)), byte_class((48, 57)), byte_class((128, 255)), SYMBOLS, byte_class((33, 33)), byte_class((124, 124)), byte_class((46, 46), (44, 44)), byte_class((10, 10)))


def features(slab: K.Slab) -> np.ndarray:
    """A float row a text: shares of byte classes, rates of the counts, and roots of hashed byte-trigram shares."""
    data, bounds = slab.data, slab.bounds
    length = np.maximum(np.diff(bounds), 1)
    counts = base_counts(slab)
    words = np.maximum(counts["n_words"], 1)
    columns = [np.sqrt(K.per_text(c[data].astype(np.int64), bounds) / length) for c in CLASSES]
    columns += [np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_repeat_words"] / words, np.log1p(counts["n_dup_lines"])]
    grams = np.zeros((slab.rows, HASHED))
    if len(data) >= 3:
        d = data.astype(np.uint32)
        word = (d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        bucket = ((word ^ word >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.int64)
        owner = np.repeat(np.arange(slab.rows), np.diff(bounds))
        inside = owner[:-2] == owner[2:]
        grams = np.bincount((owner[:-2] * HASHED + bucket)[inside], minlength=slab.rows * HASHED).reshape(slab.rows, HASHED)
    return np.hstack([np.stack(columns, axis=1), np.sqrt(grams / length[:, None])]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method on standardised columns: (mean, scale, weights with intercept first).

    Sums are made over runs of rows, so the driver holds the features once, as they came, and no copy of them.
    """
    cuts = range(0, len(x), FIT_ROWS)
    mean = sum(x[k : k + FIT_ROWS].sum(axis=0, dtype=np.float64) for k in cuts) / len(x)
    scale = np.sqrt(sum(((x[k : k + FIT_ROWS] - mean) ** 2).sum(axis=0) for k in cuts) / len(x)) + 1e-6
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        hessian, gradient = np.diag(penalty), -penalty * w
        for k in cuts:
            part = x[k : k + FIT_ROWS]
            z = np.hstack([np.ones((len(part), 1)), (part - mean) / scale])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian += (z * (p * (1 - p))[:, None]).T @ z
            gradient += z.T @ (y[k : k + FIT_ROWS] - p)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of floats out of a binary column whose values are all of one length, without a Python object a row."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(chunk), -1))
    return np.concatenate(parts)


def train(docs: DataFrame, labels: DataFrame, label: str, most: int):
    """A model fitted on the bounded sample, or None where it lacks one of the two classes."""
    known = sample(docs, labels, label, most)
    packed = K.map_texts(known, "x binary", lambda texts: [pa.array([row.tobytes() for slab in K.slabs(texts) for row in features(slab)], pa.binary())], carry=["doc_id", "label"]).toArrow()
    # Ids are distinct in the sample; their order makes the fit's sums the same in every run.
    order = np.argsort(packed["doc_id"].to_numpy())
    y = packed["label"].to_numpy().astype(float)[order]
    if len(set(y.tolist())) < 2:
        return None
    x = unpacked(packed["x"])
    del packed
    return fit(x[order], y)


def document_scores(texts, model) -> list[pa.Array]:
    if model is None:
        return [pa.array(np.ones(len(texts)), pa.float64())]
    mean, scale, w = model
    parts = [1 / (1 + np.exp(-np.clip(w[0] + (features(slab) - mean) / scale @ w[1:], -30, 30))) for slab in K.slabs(texts)]
    return [pa.array(np.round(np.concatenate(parts), DIGITS) if parts else np.empty(0), pa.float64())]


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(p / (1 - p))


def shrunk(total: Column, n: Column, prior: Column, strength: float) -> Column:
    return (total + F.lit(strength) * prior) / (n + F.lit(strength))


def strength(groups: DataFrame) -> float:
    """Pseudo-documents of a prior: what documents vary within groups against what groups vary around their parents.

    ``groups`` has n, s and s2 (documents, sum and sum of squares) of each group, and of its parent as pn and ps. The
    spread of group means around their parent's is lessened by what sampling alone makes of it (nested analysis of
    variance), so that small groups of alike documents don't pass for different ones.
    """
    mean, parent = F.col("s") / F.col("n"), F.col("ps") / F.col("pn")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") / F.col("pn")).alias("parents"),
        F.sum(F.col("s2") - F.col("s") * mean).alias("within"),
        F.sum(F.col("n") * F.pow(mean - parent, 2)).alias("between"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("own"),
    ).first()
    n, k, parents = row["n"] or 0, row["groups"] or 0, round(row["parents"] or 0.0)
    if n <= k or k <= parents:
        return STRENGTH[1]
    noise = max(row["within"], 0.0) / (n - k)
    spread = (row["between"] - (k - parents) * noise) / max(n - row["own"], 1e-12)
    if spread <= 0:
        return STRENGTH[1]
    return float(min(max(noise / spread, STRENGTH[0]), STRENGTH[1]))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(site, host_posterior, path_posterior, n) from rows (host_key, site, doc_score), and the corpus mean."""
    whole = lambda c: (F.sum(F.round(c * 10**DIGITS).cast("decimal(38,0)")) / F.lit(10.0**DIGITS)).cast("double")
    score = F.col("doc_score")
    paths = scored.groupBy("host_key", "site").agg(F.count("*").alias("n"), whole(score).alias("s"), whole(score * score).alias("s2"))
    paths = materialise(paths, "paths")
    hosts = materialise(paths.groupBy("host_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")), "hosts")
    all_ = hosts.agg(F.sum("n").alias("pn"), F.sum("s").alias("ps")).first()
    total, mean = all_["pn"] or 0, min(max((all_["ps"] / all_["pn"]) if all_["pn"] else 1.0, CLIP), 1 - CLIP)
    of_hosts = strength(hosts.withColumns({"pn": F.lit(total), "ps": F.lit(all_["ps"])}))
    parents = hosts.select("host_key", F.col("n").alias("pn"), F.col("s").alias("ps"))
    within = paths.join(parents, "host_key")
    of_paths = strength(within)
    host = shrunk(F.col("ps"), F.col("pn"), F.lit(mean), of_hosts)
    known = within.withColumn("host_posterior", host)
    path = shrunk(F.col("s"), F.col("n"), F.col("host_posterior"), of_paths)
    return known.select("site", "host_posterior", path.alias("path_posterior"), "n"), mean


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", most: int = MOST_LABELLED, carry=None) -> DataFrame:
    """``docs`` with doc_score, host_posterior, path_posterior, quality_score and kept (score of at least a half).

    A path is ``path`` under ``host``; null is a host or path of its own. Null texts count as empty, very long ones are
    taken whole. Repeated rows and rows without doc_id are judged each for itself; of rows that share a labelled id one
    text is trained on, and labels that contradict each other count as their least. Where the sample lacks good or bad
    examples, all documents are kept. An empty table gives an empty result. Columns of the new names are replaced; all
    others pass unchanged, whatever their names.
    """
    model = train(docs, labels, label, most)
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in NAMES]
    as_text = lambda *cs: F.to_json(F.struct(*[K.column(c).cast("string").alias(f"c{i}") for i, c in enumerate(cs)]))
    rows = docs.select(K.boxed(names), K.column("text").alias("text"), as_text(host).alias("host_key"), as_text(host, path).alias("site"))
    made = K.map_texts(rows, "doc_score double", lambda texts: document_scores(texts, model), carry=["row", "host_key", "site"])
    scored = materialise(made.withColumn("rid", F.monotonically_increasing_id()), "scored")
    sites, mean = site_posteriors(scored)
    both = spread_join(scored, sites.drop("n"), ["site"], ["rid"], scored.count(), sites.select("site", "n"))
    odds = logit(F.col("doc_score")) + logit(F.col("path_posterior")) - F.lit(float(np.log(mean / (1 - mean))))
    both = both.withColumn("quality_score", 1 / (1 + F.exp(-odds)))
    return both.select(*K.unboxed(names), "doc_score", "host_posterior", "path_posterior", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))
