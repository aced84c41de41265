"""Corpus statistics and profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import is_blank, phrase_mask, word_count
from millrace.schemas import ATTRIBUTIONS

# Phrases that mark a wish rather than a demand.
PREFERRED_PHRASES = ("nice to have", "preferred", "a plus", "bonus", "ideally", "desirable", "advantageous")
LONG_TEXT = 20_000


def frequency(df: DataFrame, by: str, keep_null: bool = False, out: str = "n") -> DataFrame:
    """Counts by value, most frequent first, ties by value."""
    rows = df if keep_null else df.filter(F.col(by).isNotNull())
    return rows.groupBy(by).agg(F.count("*").alias(out)).orderBy(F.desc(out), F.asc(by))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; null is a key of its own. Texts are grouped by 128 bits of hash."""
    value = F.md5(F.col(key).cast("binary")) if isinstance(df.schema[key].dataType, T.StringType) else F.col(key)
    groups = df.groupBy(value.alias("_key")).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def blank_rate(df: DataFrame, column: str) -> DataFrame:
    blank = is_blank(F.col(column).cast("string"))
    return df.agg(F.count_if(blank).alias("n_blank"), F.round(F.avg(blank.cast("double")), 6).alias("blank_rate"))


def column_inventory(df: DataFrame, key: str, example_chars: int = 65) -> DataFrame:
    """For each column, by name: blank rate and the first non-blank value in key order.

    All columns are reduced in one pass and one small row is unpivoted afterwards.
    """
    names = sorted(df.columns)
    texts = {name: F.col(name).cast("string") for name in names}
    row = df.agg(
        *[F.avg(is_blank(texts[n]).cast("double")).alias(f"r_{i}") for i, n in enumerate(names)],
        *[F.min_by(texts[n].substr(1, example_chars), F.when(~is_blank(texts[n]), F.col(key))).alias(f"e_{i}") for i, n in enumerate(names)],
    )
    parts = [F.struct(F.lit(n).alias("column_name"), F.round(F.col(f"r_{i}"), 6).alias("blank_rate"), F.col(f"e_{i}").alias("example")) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*parts)))


def length_profile(df: DataFrame, text: str) -> DataFrame:
    """Exact length statistics over non-blank texts, in characters, and the median in words."""
    rows = df.filter(~is_blank(F.col(text))).select(F.length(text).alias("chars"), word_count(F.col(text)).alias("words"))
    cut = {50: 0.5, 90: 0.9, 95: 0.95, 99: 0.99}
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return rows.agg(
        F.count("*").alias("n"),
        rounded(F.avg("chars"), "mean_chars"),
        rounded(F.stddev_samp("chars"), "std_chars"),
        F.min("chars").alias("min_chars"),
        *[rounded(F.percentile("chars", p), f"p{name}_chars") for name, p in cut.items()],
        F.max("chars").alias("max_chars"),
        rounded(F.percentile("words", 0.5), "median_words"),
        F.count_if(F.col("chars") > LONG_TEXT).alias("n_long"),
    )


def phrase_counts(df: DataFrame, text: str, phrases=PREFERRED_PHRASES, apart: str = "bonus") -> DataFrame:
    """Rows matching each phrase, any of them, any of them but ``apart``, and ``apart`` alone."""
    masks: dict[str, Column] = {p: phrase_mask(F.col(text), p) for p in phrases}
    either = lambda names: _any([F.col(f"m_{i}") for i, p in enumerate(phrases) if p in names])
    rows = df.select(*[m.alias(f"m_{i}") for i, m in enumerate(masks.values())])
    strict = [p for p in phrases if p != apart]
    picked = {**{p: F.col(f"m_{i}") for i, p in enumerate(phrases)}, "any": either(phrases), "strict": either(strict), f"only {apart}": either([apart]) & ~either(strict)}
    row = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c_{i}") for i, c in enumerate(picked.values())])
    parts = [F.struct(F.lit(p).alias("phrase"), F.col(f"c_{i}").alias("n"), F.round(F.col(f"c_{i}") / F.nullif(F.col("total"), F.lit(0)), 6).alias("rate")) for i, p in enumerate(picked)]
    return row.select(F.inline(F.array(*parts)))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def label_distribution(df: DataFrame, label: str, labels) -> DataFrame:
    """Every label of ``labels`` in order, zero rows included; the share is null where nothing was counted."""
    row = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == x).alias(f"c_{i}") for i, x in enumerate(labels)])
    parts = [
        F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label"), F.col(f"c_{i}").alias("n"), F.round(F.col(f"c_{i}") / F.nullif(F.col("total"), F.lit(0)), 6).alias("share"))
        for i, x in enumerate(labels)
    ]
    return row.select(F.inline(F.array(*parts)))


def majority_class(distribution: DataFrame) -> DataFrame:
    """The most frequent label of a distribution; of equals the first in label order."""
    best = F.struct(F.col("n"), -F.col("ord"))
    return distribution.agg(F.max_by("label", best).alias("majority"), F.max_by("share", best).alias("share"))


def off_schema(df: DataFrame, label: str, labels) -> DataFrame:
    return df.filter(~F.col(label).isin(*labels)).groupBy(label).agg(F.count("*").alias("n"))


def status_counts(records: DataFrame) -> DataFrame:
    """Totals over enriched records; mention figures count ok records only. Ratios are null on a zero base."""
    ok = F.col("status") == "ok"
    skills = F.when(ok, F.coalesce(F.col("skills"), F.array().cast(records.schema["skills"].dataType)))
    n, grounded = F.size(skills), F.size(F.filter(skills, lambda m: F.coalesce(m["grounded"], F.lit(False))))
    row = records.agg(
        F.count("*").alias("n_records"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_error"),
        F.count_if(ok & (n == 0)).alias("n_zero_skill"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_mentions"),
        F.coalesce(F.sum(grounded), F.lit(0)).alias("n_grounded"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("input_tokens", F.lit(0)))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("output_tokens", F.lit(0)))), F.lit(0)).alias("output_tokens"),
    )
    return row.select(
        "*",
        F.round(F.col("n_grounded") / F.nullif(F.col("n_mentions"), F.lit(0)), 6).alias("grounded_rate"),
        F.round(F.col("n_mentions") / F.nullif(F.col("n_ok"), F.lit(0)), 6).alias("mentions_per_record"),
    )


def mentions(records: DataFrame) -> DataFrame:
    """One row a mention of the ok records."""
    return records.filter(F.col("status") == "ok").select("job_id", F.inline("skills"))


def attribution_distribution(records: DataFrame) -> DataFrame:
    return label_distribution(mentions(records), "attribution", ATTRIBUTIONS)


def distinct_records(records: DataFrame, key: str = "job_id") -> DataFrame:
    """How many different records there are by key; null is none."""
    return records.agg(F.countDistinct(key).alias("n_records"))


def error_ids(records: DataFrame) -> DataFrame:
    return records.filter(~F.coalesce(F.col("status") == "ok", F.lit(False))).select("job_id")
