"""Lexicon matching and alias canonicalisation, as expressions or as a join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens

# The technology lexicon. One term a line, aliases after the colon;
# * marks a term whose bare name is too ambiguous to match in prose.
DEFAULT_TERMS = """
Python
Java
JavaScript: JS
TypeScript: TS
SQL
C++
C#: CSharp, C Sharp
Go *: Golang
Rust
Ruby
PHP
Scala
Kotlin
Swift
R *: R programming, R language
MATLAB
Perl
Bash: Shell scripting, Shell script
PowerShell
VBA: Visual Basic
Spark: Apache Spark, PySpark
Kafka: Apache Kafka
Hadoop: Apache Hadoop
Airflow: Apache Airflow
dbt *: dbt Core, dbt Cloud
Snowflake
Databricks
Redshift: Amazon Redshift
BigQuery: Google BigQuery
Hive: Apache Hive
Flink: Apache Flink
Kinesis: AWS Kinesis
Talend
Informatica
SSIS
ETL
Data warehousing: Data warehouse
PostgreSQL: Postgres
MySQL
MongoDB: Mongo
Oracle: Oracle DB, Oracle Database
SQL Server: MS SQL, Microsoft SQL Server, MSSQL, T-SQL, TSQL
Redis
Cassandra: Apache Cassandra
DynamoDB
Elasticsearch: Elastic Search, ELK
Neo4j
SQLite
MariaDB
NoSQL: no-SQL
AWS: Amazon Web Services
Azure: Microsoft Azure
GCP: Google Cloud, Google Cloud Platform
Docker
Kubernetes: K8s
Terraform
Ansible
Jenkins
GitLab CI: GitLab CI/CD
GitHub Actions
CI/CD: CICD, Continuous Integration
Linux: Unix
EC2: Amazon EC2
S3: Amazon S3
Lambda: AWS Lambda
EKS
CloudFormation
Helm
Prometheus
Grafana
Datadog
Splunk
React: React.js, ReactJS
Angular: AngularJS
Vue: Vue.js, VueJS
Node.js: NodeJS, Node
Django
Flask
FastAPI
Spring Boot
Spring: Spring Framework
.NET: dotnet, ASP.NET
Rails: Ruby on Rails
Express *: Express.js, ExpressJS
GraphQL
REST API: RESTful API, REST APIs, RESTful APIs
HTML: HTML5
CSS: CSS3, SASS, SCSS
Git
Jira
Microservices: Microservice architecture
TensorFlow
PyTorch: Torch
scikit-learn: sklearn, scikit learn
pandas
NumPy
Keras
Machine learning: ML
Deep learning
NLP: Natural language processing
Computer vision
Tableau
Power BI: PowerBI
Looker
Excel: Microsoft Excel, MS Excel
SAS
SPSS
Stata
Alteryx
Qlik: QlikView, Qlik Sense
Jupyter: Jupyter Notebook
"""

# Names that denote a term, or two, under another spelling.
EXTRA_ALIASES = {
    "c/c++": ("C", "C++"),
    ".net framework": (".NET",),
    ".net core": (".NET",),
}


@dataclass(frozen=True)
class Term:
    canonical: str
    aliases: tuple[str, ...] = ()
    requires_context: bool = False

    @property
    def surfaces(self) -> tuple[str, ...]:
        """What is searched in prose."""
        return self.aliases if self.requires_context else (self.canonical, *self.aliases)


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[Term, ...]
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str, extra: dict[str, tuple[str, ...]] | None = None) -> Lexicon:
        terms = []
        for line in filter(None, map(str.strip, text.splitlines())):
            name, _, rest = line.partition(": ")
            context = name.endswith(" *")
            terms.append(Term(name.removesuffix(" *"), tuple(a.strip() for a in rest.split(",") if a.strip()), context))
        return cls(tuple(terms), dict(extra or {}))

    @classmethod
    def from_yaml(cls, path: str, extra: dict[str, tuple[str, ...]] | None = None) -> Lexicon:
        """A list of ``{canonical, aliases, requires_context}``; needs the optional yaml package. The driver reads the file."""
        import yaml

        with open(path, encoding="utf-8") as handle:
            entries = yaml.safe_load(handle) or []
        return cls(tuple(Term(e["canonical"], tuple(e.get("aliases") or ()), bool(e.get("requires_context"))) for e in entries), dict(extra or {}))

    @classmethod
    def of_words(cls, *words: str) -> Lexicon:
        return cls(tuple(Term(word) for word in words))

    def alias_pairs(self) -> list[tuple[str, str]]:
        """(lower-cased surface, canonical). Context-only terms map here too: a bare name isn't prose."""
        table: dict[str, tuple[str, ...]] = {}
        for term in self.terms:
            for surface in (term.canonical, *term.aliases):
                table[surface.lower()] = (term.canonical,)
        table |= self.extra
        return [(surface, canonical) for surface, names in table.items() for canonical in names]

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.alias_pairs(), "surface string, canonical string")


def default_lexicon() -> Lexicon:
    return Lexicon.parse(DEFAULT_TERMS, EXTRA_ALIASES)


def surface_pattern(surface: str, strict_boundaries: bool = True) -> str:
    """A Java regex for one surface form between boundaries.

    A form that ends in punctuation has no word boundary there, so it must not run on into a word, ``+`` or ``#``.
    With ``strict_boundaries`` a form that starts with punctuation wants a word character before it; without,
    it must not follow one.
    """
    head = r"\b" if strict_boundaries or surface[0].isalnum() else r"(?<!\w)"
    tail = r"\b" if surface[-1].isalnum() else r"(?![\w+#])"
    return head + re.escape(surface) + tail


def is_word(surface: str) -> bool:
    """A form of letters, digits and underscores only, which between boundaries is a token of the text."""
    return re.fullmatch(r"\w+", surface) is not None


def match_terms(text: Column, lexicon: Lexicon, strict_boundaries: bool = True) -> Column:
    """Sorted canonical names found in ``text``; null or empty text gives an empty array.

    Terms may overlap: each is looked for on its own, none consumes text.
    """
    if not lexicon.terms:
        return F.array().cast("array<string>")
    safe = F.coalesce(text, F.lit(""))
    words: dict[str, list[str]] = {}
    hits: list[Column] = []
    for term in lexicon.terms:
        for surface in term.surfaces:
            if is_word(surface):
                words.setdefault(surface.lower(), []).append(term.canonical)
            else:
                # The regex runs only where the lower-cased text holds the lower-cased form at all.
                held = F.contains(F.lower(safe), F.lit(surface.lower())) & safe.rlike("(?iU)" + surface_pattern(surface, strict_boundaries))
                hits.append(F.when(held, F.lit(term.canonical)))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    if words:
        # Words are looked up in one pass over the tokens, whatever their number.
        table = F.create_map(*[x for w, names in words.items() for x in (F.lit(w), F.array(*[F.lit(n) for n in names]))])
        seen = F.array_intersect(tokens(safe), F.array(*[F.lit(w) for w in words]))
        found = F.concat(found, F.flatten(F.transform(seen, lambda w: table[w])))
    return F.array_sort(F.array_distinct(found))


def with_terms(df: DataFrame, text: str, lexicon: Lexicon, out: str = "skills_gazetteer", count: str = "n_skills", strict_boundaries: bool = True) -> DataFrame:
    return df.withColumn(out, match_terms(F.col(text), lexicon, strict_boundaries)).withColumn(count, F.size(F.col(out)))


def canonicalise(df: DataFrame, name: str, lexicon: Lexicon, out: str = "canonical", keep_unmapped: bool = False) -> DataFrame:
    """One row for each canonical term that ``name`` denotes; unmapped rows go, or stay with null.

    The alias table has the lexicon's size, a driver-side constant, so it is safe to broadcast.
    """
    aliases = lexicon.alias_frame(df.sparkSession).select(F.col("surface").alias("_surface"), F.col("canonical").alias(out))
    key = F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))
    joined = df.withColumn("_key", key).join(F.broadcast(aliases), F.col("_key") == F.col("_surface"), "left" if keep_unmapped else "inner")
    return joined.drop("_key", "_surface")
