"""Fixed schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of a raw posting, in file order.
RAW_COLUMNS = (
    "job_id",
    "title",
    "company_name",
    "description",
    "location",
    "formatted_experience_level",
    "formatted_work_type",
    "remote_allowed",
    "listed_time",
)

RAW_POSTING = T.StructType([T.StructField(name, T.StringType(), True) for name in RAW_COLUMNS])

SILVER_COLUMNS = tuple("description_clean" if name == "description" else name for name in RAW_COLUMNS)

#: Precedence order: the first class that applies to a term wins.
ATTRIBUTIONS = ("required", "preferred", "boilerplate", "not_expected")
SPURIOUS = "spurious"
SENIORITIES = ("junior", "mid", "senior", "unspecified")

MENTION = T.StructType(
    [
        T.StructField("skill", T.StringType(), True),
        T.StructField("attribution", T.StringType(), True),
        T.StructField("evidence", T.StringType(), True),
    ]
)
GROUNDED_MENTION = T.StructType([*MENTION.fields, T.StructField("grounded", T.BooleanType(), True)])

EXTRACTION = T.StructType(
    [
        T.StructField("skills", T.ArrayType(MENTION), True),
        T.StructField("seniority", T.StringType(), True),
        T.StructField("years_experience_min", T.IntegerType(), True),
    ]
)

ENRICHED = T.StructType(
    [
        T.StructField("job_id", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("attempt", T.IntegerType(), True),
        T.StructField("skills", T.ArrayType(GROUNDED_MENTION), True),
        T.StructField("seniority", T.StringType(), True),
        T.StructField("years_experience_min", T.IntegerType(), True),
        T.StructField("input_tokens", T.LongType(), True),
        T.StructField("output_tokens", T.LongType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

GOLD_LABEL = T.StructType([T.StructField(name, T.StringType(), True) for name in ("job_id", "skill", "label")])

VECTOR = T.StructType([T.StructField("job_id", T.StringType(), True), T.StructField("embedding", T.ArrayType(T.FloatType()), True)])

INDEX_DOCUMENT = T.StructType(
    [
        *[
            T.StructField(name, T.StringType(), True)
            for name in ("job_id", "title", "description", "company", "location", "work_type", "experience_level_source", "seniority_llm")
        ],
        T.StructField("years_experience_min", T.IntegerType(), True),
        T.StructField("n_skills", T.IntegerType(), True),
        T.StructField("skills_gazetteer", T.ArrayType(T.StringType()), True),
        *[T.StructField(f"skills_{name}", T.ArrayType(T.StringType()), True) for name in ATTRIBUTIONS],
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    ]
)


class SchemaMismatch(ValueError):
    """A frame doesn't have the fields a strict sink or source asks for."""


def require_columns(df, names) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {', '.join(missing)}")


def conform(df, schema: T.StructType):
    """Project to ``schema`` exactly: unknown or missing columns are an error, types are cast."""
    require_columns(df, schema.names)
    extra = [name for name in df.columns if name not in schema.names]
    if extra:
        raise SchemaMismatch(f"columns outside the schema: {', '.join(extra)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
