"""Quality funnel: clean, flag, count and filter text records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def flagged(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds description_clean, stopword_hits, clean_len and the three flags has_desc, is_english, long_enough."""
    df = X.with_once(df, description_clean=X.clean_html(F.col(text)))
    counted = X.with_once(df, stopword_hits=X.stopword_hits(F.col("description_clean")), clean_len=F.length("description_clean"), has_desc=X.is_present(F.col(text)))
    return counted.select(
        "*",
        (F.col("stopword_hits") >= X.MIN_STOPWORDS).alias("is_english"),
        F.coalesce(F.col("clean_len") >= X.MIN_CHARS, F.lit(False)).alias("long_enough"),
    )


def silver(df: DataFrame, text: str = "description", dedupe_on: str | None = None) -> DataFrame:
    """Records that pass all three flags, ``description_clean`` in place of the text. ``dedupe_on`` keeps one row a key."""
    keep = [("description_clean" if c == text else c) for c in df.columns]
    # Cleaned once: the filter stays above the column it tests.
    cleaned = X.with_once(df.filter(X.is_present(F.col(text))), description_clean=X.clean_html(F.col(text)))
    clean = F.col("description_clean")
    passed = cleaned.filter((F.length(clean) >= X.MIN_CHARS) & (X.stopword_hits(clean) >= X.MIN_STOPWORDS)).select(*keep)
    return passed.dropDuplicates([dedupe_on]) if dedupe_on else passed


def funnel_counts(df: DataFrame, key: str = "job_id", text: str = "description") -> DataFrame:
    """One row of counts. The distinct count shuffles keys only; all else combines before the shuffle."""
    flags = flagged(df, text).select(key, "has_desc", "is_english", "long_enough")
    has, english, long_enough = F.col("has_desc"), F.col("is_english"), F.col("long_enough")
    counted = flags.agg(
        F.count("*").alias("bronze"),
        F.count_if(has).alias("has_desc"),
        F.countDistinct(F.when(has, F.col(key))).alias("distinct_ids"),
        F.count_if(has & ~english).alias("not_english"),
        F.count_if(has & english & ~long_enough).alias("too_short"),
        F.count_if(has & english & long_enough).alias("silver"),
    )
    loss = F.col("bronze") - F.col("silver")
    return counted.select(
        "*",
        (F.col("bronze") - F.col("has_desc")).alias("blank"),
        (F.col("has_desc") - F.col("distinct_ids")).alias("duplicates"),
        loss.alias("loss"),
        F.round(F.lit(100.0) * loss / F.nullif(F.col("bronze"), F.lit(0)), 6).alias("loss_pct"),
    )


def funnel_report(counts: DataFrame) -> str:
    """The one row of ``funnel_counts`` as text."""
    row = counts.first()
    share = "n/a" if row["bronze"] == 0 else f"{row['loss'] / row['bronze']:.2%}"
    lines = [
        ("raw rows", f"{row['bronze']:,}"),
        ("blank text", f"-{row['blank']:,}"),
        ("repeated key", f"-{row['duplicates']:,}"),
        ("language filter", f"-{row['not_english']:,}"),
        (f"under {X.MIN_CHARS} chars", f"-{row['too_short']:,}"),
        ("rows kept", f"{row['silver']:,}"),
        ("lost in all", f"{row['loss']:,} ({share})"),
    ]
    return "".join(f"{name:<16}: {value}\n" for name, value in lines)
