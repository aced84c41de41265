"""Predicted attributions against gold labels, keyed by (job_id, skill)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.lexicon import Lexicon, canonicalise
from millrace.functions.text import safe_ratio
from millrace.schemas import ATTRIBUTIONS, SPURIOUS

KEYS = ["job_id", "skill"]


def best_precedence(mentions: DataFrame, keys=KEYS, label: str = "attribution", classes=ATTRIBUTIONS) -> DataFrame:
    """One label a key: the first in ``classes`` order among those given. Combines before the shuffle."""
    order = F.array(*[F.lit(c) for c in classes])
    rank = F.nullif(F.array_position(order, F.col(label)), F.lit(0))
    best = mentions.groupBy(*keys).agg(F.min(rank).alias("_rank"))
    return best.select(*keys, F.when(F.col("_rank").isNotNull(), F.try_element_at(order, F.col("_rank").cast("int"))).alias(label))


def predicted_keys(mentions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Mentions mapped to canonical terms, unmapped ones left out, best precedence for each key."""
    mapped = canonicalise(mentions, "skill", lexicon, out="_canonical").drop("skill").withColumnRenamed("_canonical", "skill")
    return best_precedence(mapped)


def mapping_counts(mentions: DataFrame, lexicon: Lexicon) -> DataFrame:
    aliases = lexicon.alias_frame(mentions.sparkSession).select(F.col("surface")).distinct()
    key = F.lower(F.regexp_replace("skill", r"(?U)^\s+|\s+$", ""))
    marked = mentions.select(key.alias("surface")).join(F.broadcast(aliases.withColumn("_hit", F.lit(1))), "surface", "left")  # bounded by the lexicon
    return marked.agg(F.count("*").alias("n_mentions"), F.count("_hit").alias("n_mapped"), F.count_if(F.col("_hit").isNull()).alias("n_unmapped"))


def paired(gold: DataFrame, predicted: DataFrame, keys=KEYS) -> DataFrame:
    """Full outer join of gold (``label``) and predicted (``attribution``); null where a side has no such key."""
    return gold.join(predicted, list(keys), "full")


def detection(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    """Precision, recall and F1 of the lexicon and of the model.

    The gold universe is what the lexicon found, so its recall is 1 by construction and spurious rows are its false
    positives. A prediction on a spurious key counts neither way for the model.
    """
    scorable = F.col("label").isin(*classes)
    seen = F.col("attribution").isNotNull()
    row = pairs.agg(
        F.count_if(scorable).alias("g"),
        F.count_if(F.col("label") == SPURIOUS).alias("s"),
        F.count_if(scorable & seen).alias("tp"),
        F.count_if(F.col("label").isNull() & seen).alias("fp"),
    )
    systems = F.array(
        F.struct(F.lit("lexicon").alias("system"), F.col("g").alias("tp"), F.col("s").alias("fp"), F.lit(0).cast("long").alias("fn")),
        F.struct(F.lit("model").alias("system"), F.col("tp"), F.col("fp"), (F.col("g") - F.col("tp")).alias("fn")),
    )
    return with_prf(row.select(F.inline(systems)))


def with_prf(counts: DataFrame) -> DataFrame:
    p = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = counts.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both)
    return df.withColumn("f1", F.round(f1, 6)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def common(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    """Scorable gold keys that were also predicted."""
    return pairs.filter(F.col("label").isin(*classes) & F.col("attribution").isNotNull())


def accuracy(pairs: DataFrame, classes=ATTRIBUTIONS, baseline: str | None = None) -> DataFrame:
    """Baseline and model, on the common set and end to end (a key without a prediction is wrong)."""
    baseline = baseline or classes[0]
    scorable, seen = F.col("label").isin(*classes), F.col("attribution").isNotNull()
    base, hit = F.col("label") == baseline, F.coalesce(F.col("attribution") == F.col("label"), F.lit(False))
    row = pairs.agg(
        F.count_if(scorable & seen).alias("nc"),
        F.count_if(scorable).alias("n"),
        F.count_if(scorable & seen & base).alias("bc"),
        F.count_if(scorable & base).alias("b"),
        F.count_if(scorable & hit).alias("m"),
    )
    cells = [("common", "baseline", "bc", "nc"), ("common", "model", "m", "nc"), ("end_to_end", "baseline", "b", "n"), ("end_to_end", "model", "m", "n")]
    parts = [F.struct(F.lit(s).alias("scope"), F.lit(w).alias("system"), F.col(k).alias("correct"), F.col(t).alias("total")) for s, w, k, t in cells]
    return row.select(F.inline(F.array(*parts))).withColumn("accuracy", F.round(F.col("correct") / F.nullif(F.col("total"), F.lit(0)), 6))


def confusion(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    """All class pairs on the common set, zero cells included: one reduction, then one small row unpivoted."""
    cells = [(g, p) for g in classes for p in classes]
    row = common(pairs, classes).agg(*[F.count_if((F.col("label") == g) & (F.col("attribution") == p)).alias(f"c_{i}") for i, (g, p) in enumerate(cells)])
    parts = [F.struct(F.lit(g).alias("gold"), F.lit(p).alias("predicted"), F.col(f"c_{i}").alias("n")) for i, (g, p) in enumerate(cells)]
    return row.select(F.inline(F.array(*parts)))


def per_class(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    seen, hit = F.col("attribution").isNotNull(), F.coalesce(F.col("attribution") == F.col("label"), F.lit(False))
    counted = pairs.filter(F.col("label").isin(*classes)).groupBy("label")
    return counted.agg(F.count("*").alias("n_gold"), F.count_if(seen).alias("n_common"), F.count_if(hit).alias("n_correct"))


def disagreements(pairs: DataFrame, classes=ATTRIBUTIONS, keys=KEYS) -> DataFrame:
    rows = common(pairs, classes).filter(F.col("label") != F.col("attribution"))
    return rows.select(*keys, F.col("label").alias("gold"), F.col("attribution").alias("predicted")).orderBy(*keys)


def transitions(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    """Gold-to-predicted counts among disagreements, and whether the prediction is softer or stricter."""
    order = F.array(*[F.lit(c) for c in classes])
    moved = disagreements_unordered(pairs, classes).groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    softer = F.array_position(order, F.col("predicted")) > F.array_position(order, F.col("gold"))
    return moved.withColumn("direction", F.when(softer, "softer").otherwise("stricter"))


def disagreements_unordered(pairs: DataFrame, classes=ATTRIBUTIONS) -> DataFrame:
    rows = common(pairs, classes).filter(F.col("label") != F.col("attribution"))
    return rows.select(F.col("label").alias("gold"), F.col("attribution").alias("predicted"))
