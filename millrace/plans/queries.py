"""Named queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it.

``documents`` stands in for postings: doc_id is the job id, source the company, lang the experience level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import arrays, vectors
from millrace.functions import text as X
from millrace.functions.lexicon import Lexicon, canonicalise, default_lexicon, match_terms
from millrace.operators import enrich, funnel, idlists, matching, sampling, scoring, stats
from millrace.session import tuned
from millrace.sources import readers
from millrace.sources.readers import latest_by, parse_json
from millrace.sources.writers import append_records, export_readable, index_health, pending, read_index, upsert, write_id_list, write_index, write_jsonl, write_parquet, write_tsv
from millrace.workspace import materialise, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The driver's prose holds none of the default lexicon's terms, so matching queries use common words of it.
WORDS = ("the", "of", "and", "with", "that", "from", "und", "der", "die", "les", "des", "que", "los", "was", "are")
SMALL_LEXICON = Lexicon.of_words(*WORDS)
#: event_type as if it were a mention's skill name; one name denotes two terms.
EVENT_LEXICON = Lexicon.parse("View: click\nBuy: purchase\nJoin: signup", {"view": ("View", "Seen")})
CLASSES4 = ("required", "preferred", "boilerplate", "not_expected")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.concat(F.lit("Posting "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("company_name"),
        F.col("text").alias("description"),
        F.lit("").alias("location"),
        F.col("lang").alias("formatted_experience_level"),
        F.lit("").alias("formatted_work_type"),
        F.lit("0").alias("remote_allowed"),
        F.col("n_chars").cast("string").alias("listed_time"),
    )


# SQL pieces shared by the oracles -------------------------------------------------------------------------------

BOUND = r"[^\p{L}\p{N}_]"


def sql_word(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|{BOUND}){word}({BOUND}|$)')"


def sql_clean(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def sql_hits(text: str) -> str:
    return " + ".join(f"CASE WHEN {sql_word(text, w)} THEN 1 ELSE 0 END" for w in X.STOPWORDS)


SQL_FLAGS = f"""WITH c AS (SELECT *, {sql_clean("text")} AS description_clean FROM documents),
h AS (SELECT *, {sql_hits("lower(description_clean)")} AS hits FROM c),
f AS (SELECT *, text IS NOT NULL AND trim(text) <> '' AS has_desc, hits >= {X.MIN_STOPWORDS} AS is_english,
  coalesce(length(description_clean) >= {X.MIN_CHARS}, false) AS long_enough FROM h)"""


def sql_surface(surface: str) -> str:
    """The same test as ``surface_pattern`` without look-around."""
    escaped = "".join("\\" + c if not c.isalnum() and c != " " else c for c in surface)
    head = f"(^|{BOUND})" if surface[0].isalnum() else r"[\p{L}\p{N}_]"
    tail = f"({BOUND}|$)" if surface[-1].isalnum() else r"([^\p{L}\p{N}_+#]|$)"
    return f"(?i){head}{escaped}{tail}"


def sql_terms(text: str, lexicon: Lexicon) -> str:
    cases = []
    for term in lexicon.terms:
        tests = " OR ".join(f"regexp_matches({text}, '{sql_surface(s)}')" for s in term.surfaces)
        cases.append(f"CASE WHEN {tests} THEN '{term.canonical}' END")
    return f"array_to_string(list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)), ',')"


# Text and funnel ------------------------------------------------------------------------------------------------


@query("clean_pages", f"SELECT page_id, {sql_clean('html')} AS clean_text, CAST(length({sql_clean('html')}) AS INTEGER) AS clean_len FROM pages")
def clean_pages(spark, sf_dir):
    cleaned = table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean_text"))
    return cleaned.withColumn("clean_len", F.length("clean_text"))


@query(
    "quality_funnel",
    f"""{SQL_FLAGS}, n AS (SELECT count(*) AS bronze, count(*) FILTER (has_desc) AS has_desc, count(DISTINCT CASE WHEN has_desc THEN doc_id END) AS distinct_ids,
count(*) FILTER (has_desc AND NOT is_english) AS not_english, count(*) FILTER (has_desc AND is_english AND NOT long_enough) AS too_short,
count(*) FILTER (has_desc AND is_english AND long_enough) AS silver FROM f)
SELECT *, bronze - has_desc AS blank, has_desc - distinct_ids AS duplicates, bronze - silver AS loss, round(100.0 * (bronze - silver) / bronze, 6) AS loss_pct FROM n""",
)
def quality_funnel(spark, sf_dir):
    return funnel.funnel_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("silver_rows", f"{SQL_FLAGS} SELECT doc_id, description_clean, lang, source, n_chars FROM f WHERE has_desc AND is_english AND long_enough")
def silver_rows(spark, sf_dir):
    return funnel.silver(table(spark, sf_dir, "documents"), "text")


@query("stopword_hist", f"{SQL_FLAGS} SELECT CAST(hits AS INTEGER) AS stopword_hits, count(*) AS n FROM f GROUP BY 1")
def stopword_hist(spark, sf_dir):
    flags = funnel.flagged(table(spark, sf_dir, "documents").select("text"), "text")
    return stats.frequency(flags, "stopword_hits")


# Lexicon --------------------------------------------------------------------------------------------------------


def _matched(spark, sf_dir, name="documents", key="doc_id", text="text", lexicon=SMALL_LEXICON) -> DataFrame:
    rows = table(spark, sf_dir, name).select(key, text)
    return rows.select(key, match_terms(F.col(text), lexicon).alias("terms"))


SQL_MATCHED = f"m AS (SELECT doc_id, {sql_terms('text', SMALL_LEXICON)} AS terms FROM documents)"


@query("lexicon_match", f"WITH {SQL_MATCHED} SELECT doc_id, terms, CAST(CASE WHEN terms = '' THEN 0 ELSE len(string_split(terms, ',')) END AS INTEGER) AS n_terms FROM m")
def lexicon_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("doc_id", F.array_join("terms", ",").alias("terms"), F.size("terms").alias("n_terms"))


@query("lexicon_pages", f"SELECT page_id, {sql_terms('html', default_lexicon())} AS terms FROM pages")
def lexicon_pages(spark, sf_dir):
    return _matched(spark, sf_dir, "pages", "page_id", "html", default_lexicon()).select("page_id", F.array_join("terms", ",").alias("terms"))


@query("term_frequency", f"WITH {SQL_MATCHED} SELECT t.term, count(*) AS n FROM m, unnest(string_split(terms, ',')) AS t(term) WHERE t.term <> '' GROUP BY 1")
def term_frequency(spark, sf_dir):
    return stats.frequency(_matched(spark, sf_dir).select(F.explode_outer("terms").alias("term")), "term")


@query("technical_population", f"WITH {SQL_MATCHED} SELECT doc_id, len(string_split(terms, ',')) AS n_skills FROM m WHERE terms <> '' AND len(string_split(terms, ',')) >= {sampling.MIN_SKILLS}")
def technical_population(spark, sf_dir):
    return sampling.population(_matched(spark, sf_dir).select("doc_id", F.size("terms").cast("long").alias("n_skills")))


SQL_ALIASES = "a(surface, canonical) AS (VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in EVENT_LEXICON.alias_pairs()) + ")"


@query("canonicalise_aliases", f"WITH {SQL_ALIASES} SELECT canonical, count(*) AS n FROM events LEFT JOIN a ON lower(trim(event_type)) = surface GROUP BY 1")
def canonicalise_aliases(spark, sf_dir):
    mapped = canonicalise(table(spark, sf_dir, "events").select("event_type"), "event_type", EVENT_LEXICON, keep_unmapped=True)
    return mapped.groupBy("canonical").agg(F.count("*").alias("n"))


@query("mapping_counts", f"WITH {SQL_ALIASES} SELECT count(*) AS n_mentions, count(*) FILTER (k) AS n_mapped, count(*) FILTER (NOT k) AS n_unmapped FROM (SELECT lower(trim(event_type)) IN (SELECT surface FROM a) AS k FROM events)")
def mapping_counts(spark, sf_dir):
    return scoring.mapping_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("skill")), EVENT_LEXICON)


# Id lists, joins, sets ------------------------------------------------------------------------------------------


def _toxic_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")


@query("semi_id_list", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_id_list(spark, sf_dir):
    return idlists.keep_listed(table(spark, sf_dir, "documents").select("doc_id", "lang"), _toxic_ids(spark, sf_dir), "doc_id")


@query("anti_id_list", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_id_list(spark, sf_dir):
    return idlists.drop_listed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("ordered_lookup", "SELECT l.doc_id, -l.doc_id AS pos, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1")
def ordered_lookup(spark, sf_dir):
    ids = _toxic_ids(spark, sf_dir).withColumn("pos", -F.col("doc_id"))
    return idlists.in_list_order(table(spark, sf_dir, "documents").select("doc_id", "source"), ids, "doc_id")


@query("id_union", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def id_union(spark, sf_dir):
    return idlists.union_ids(_toxic_ids(spark, sf_dir), table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"))


@query("id_intersect", "SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr'")
def id_intersect(spark, sf_dir):
    return idlists.common_ids(_toxic_ids(spark, sf_dir), table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"))


@query("id_except", "SELECT doc_id FROM documents WHERE lang = 'fr' EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 1")
def id_except(spark, sf_dir):
    return idlists.except_ids(table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"), _toxic_ids(spark, sf_dir))


@query(
    "three_way_assembly",
    """SELECT c_custkey, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def three_way_assembly(spark, sf_dir):
    # Lines combine to one row an order first, so the customer join moves orders and not lines.
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = lines.join(orders, "o_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return joined.groupBy("c_custkey").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_orders"), F.sum("r").cast("double").alias("revenue"))


@query("assembly_skipped", "SELECT count(*) AS n_skipped FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def assembly_skipped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return idlists.drop_listed(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey").agg(F.count("*").alias("n_skipped"))


# Samples --------------------------------------------------------------------------------------------------------

SQL_DRAW = f"md5(CAST(doc_id AS VARCHAR) || '#{sampling.SEED}')"


@query("stratified_equal", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SQL_DRAW}, doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= 10")
def stratified_equal(spark, sf_dir):
    return sampling.equal_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 10, "doc_id")


@query(
    "stratified_proportional",
    f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SQL_DRAW}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS t FROM documents)
SELECT doc_id, lang FROM r WHERE lang IS NOT NULL AND r <= greatest(1, CAST(round_even(n * 100.0 / t, 0) AS BIGINT))""",
)
def stratified_proportional(spark, sf_dir):
    return sampling.proportional_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, "doc_id")


@query("simple_sample", f"SELECT doc_id, lang FROM documents ORDER BY {SQL_DRAW}, doc_id LIMIT 20")
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, "doc_id")


PRIORITY_BANDS = {"1-URGENT": "senior", "2-HIGH": "senior", "3-MEDIUM": "mid", "4-NOT SPECIFIED": "unspecified"}


@query("band_distribution", "SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_BANDS.items()) + " END AS band, count(*) AS n FROM orders GROUP BY 1 HAVING band IS NOT NULL")
def band_distribution(spark, sf_dir):
    return stats.frequency(table(spark, sf_dir, "orders").select(sampling.band(F.col("o_orderpriority"), PRIORITY_BANDS).alias("band")), "band")


# Profiles -------------------------------------------------------------------------------------------------------

SQL_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"


@query(
    "profile_lengths",
    f"""WITH r AS (SELECT length(text) AS chars, {SQL_WORDS} AS words FROM documents WHERE regexp_matches(text, '\\S'))
SELECT count(*) AS n, round(avg(chars), 6) AS mean_chars, round(stddev_samp(chars), 6) AS std_chars, CAST(min(chars) AS INTEGER) AS min_chars, round(quantile_cont(chars, 0.5), 6) AS p50_chars,
round(quantile_cont(chars, 0.9), 6) AS p90_chars, round(quantile_cont(chars, 0.95), 6) AS p95_chars, round(quantile_cont(chars, 0.99), 6) AS p99_chars, CAST(max(chars) AS INTEGER) AS max_chars,
round(quantile_cont(words, 0.5), 6) AS median_words, count(*) FILTER (chars > {stats.LONG_TEXT}) AS n_long FROM r""",
)
def profile_lengths(spark, sf_dir):
    return stats.length_profile(table(spark, sf_dir, "documents").select("text"), "text")


@query("blank_rates", "SELECT count(*) FILTER (NOT coalesce(regexp_matches(lang, '\\S'), false)) AS n_blank, round(avg(CASE WHEN coalesce(regexp_matches(lang, '\\S'), false) THEN 0.0 ELSE 1.0 END), 6) AS blank_rate FROM documents")
def blank_rates(spark, sf_dir):
    return stats.blank_rate(table(spark, sf_dir, "documents").select("lang"), "lang")


@query("column_inventory", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN coalesce(regexp_matches(CAST({c} AS VARCHAR), '\\S'), false) THEN 0.0 ELSE 1.0 END), 6) AS blank_rate, arg_min(CAST({c} AS VARCHAR)[1:65], doc_id) AS example FROM documents" for c in ("doc_id", "lang", "n_chars", "source")) + ")")
def column_inventory(spark, sf_dir):
    return stats.column_inventory(table(spark, sf_dir, "documents").drop("text"), "doc_id")


PHRASES = ("the this", "with the", "is a", "bonus", "of the")


@query(
    "phrase_masks",
    "WITH m AS (SELECT " + ", ".join(f"coalesce(regexp_matches(text, '(?i){p}'), false) AS m{i}" for i, p in enumerate(PHRASES)) + " FROM documents), c AS ("
    + " UNION ALL ".join([*[f"SELECT '{p}' AS phrase, count(*) FILTER (m{i}) AS n, count(*) AS t FROM m" for i, p in enumerate(PHRASES)], "SELECT 'any', count(*) FILTER (m0 OR m1 OR m2 OR m3 OR m4), count(*) FROM m", "SELECT 'strict', count(*) FILTER (m0 OR m1 OR m2 OR m4), count(*) FROM m", "SELECT 'only bonus', count(*) FILTER (m3 AND NOT (m0 OR m1 OR m2 OR m4)), count(*) FROM m"])
    + ") SELECT phrase, n, round(n / t, 6) AS rate FROM c",
)
def phrase_masks(spark, sf_dir):
    return stats.phrase_counts(table(spark, sf_dir, "documents").select("text"), "text", PHRASES)


@query("word_counts", f"SELECT doc_id, CAST({SQL_WORDS} AS INTEGER) AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query("duplicate_count", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_count(spark, sf_dir):
    return stats.duplicate_keys(table(spark, sf_dir, "documents").select("text"), "text")


@query("context_snippets", "SELECT doc_id, replace(text[greatest(1, strpos(lower(text), 'with the') - 90) : strpos(lower(text), 'with the') + 59], chr(10), ' ') AS snippet FROM documents WHERE strpos(lower(text), 'with the') > 0 ORDER BY doc_id LIMIT 5")
def context_snippets(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.context_snippet(F.col("text"), "with the").alias("snippet"))
    return found.filter(F.col("snippet").isNotNull()).orderBy("doc_id").limit(5)


@query("json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.LongType())])).alias("p"))
    return events.select("event_id", "p.k")


EVENT_LABELS = ("view", "click", "purchase", "refund")


def _distribution(spark, sf_dir):
    return stats.label_distribution(table(spark, sf_dir, "events").select("event_type"), "event_type", EVENT_LABELS)


SQL_DIST = "d AS (SELECT l.ord, l.label, (SELECT count(*) FROM events WHERE event_type = l.label) AS n, (SELECT count(*) FROM events) AS t FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(EVENT_LABELS)) + ") l(ord, label))"


@query("label_distribution", f"WITH {SQL_DIST} SELECT CAST(ord AS INTEGER) AS ord, label, n, round(n / t, 6) AS share FROM d")
def label_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir)


@query("majority_class", f"WITH {SQL_DIST} SELECT label AS majority, round(n / t, 6) AS share FROM d ORDER BY n DESC, ord LIMIT 1")
def majority_class(spark, sf_dir):
    return stats.majority_class(_distribution(spark, sf_dir))


@query("off_schema", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'refund') GROUP BY 1")
def off_schema(spark, sf_dir):
    return stats.off_schema(table(spark, sf_dir, "events").select("event_type"), "event_type", EVENT_LABELS)


# Scoring --------------------------------------------------------------------------------------------------------

EVENT_CLASSES = ("purchase", "signup", "click", "view", "error")


@query("best_precedence", "SELECT user_id, arg_min(event_type, CASE event_type " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(EVENT_CLASSES)) + " END) AS event_type FROM events GROUP BY 1")
def best_precedence(spark, sf_dir):
    return scoring.best_precedence(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type", EVENT_CLASSES)


def _pairs(spark, sf_dir) -> DataFrame:
    """Labelled documents as gold keys; a prediction by document id and length, for languages that the predictor knows."""
    labels = table(spark, sf_dir, "labels")
    key = [F.col("doc_id").cast("string").alias("job_id"), F.lit("x").alias("skill")]
    gold_label = F.when(F.col("doc_id") % 11 == 0, "spurious").when(F.col("toxic") == 1, "preferred").when(F.col("quality") == 0, "boilerplate").otherwise("required")
    gold = labels.select(*key, gold_label.alias("label"))
    guess = F.when(F.col("n_chars") < 500, "boilerplate").when(F.col("doc_id") % 3 == 0, "preferred").otherwise("required")
    predicted = table(spark, sf_dir, "documents").filter(F.col("lang") != "fr").select(*key, guess.alias("attribution"))
    return scoring.paired(gold, predicted)


SQL_PAIRS = """g AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, 'x' AS skill, CASE WHEN doc_id % 11 = 0 THEN 'spurious' WHEN toxic = 1 THEN 'preferred' WHEN quality = 0 THEN 'boilerplate' ELSE 'required' END AS label FROM labels),
q AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, 'x' AS skill, CASE WHEN n_chars < 500 THEN 'boilerplate' WHEN doc_id % 3 = 0 THEN 'preferred' ELSE 'required' END AS attribution FROM documents WHERE lang <> 'fr'),
p AS (SELECT job_id, skill, label, attribution FROM g FULL JOIN q USING (job_id, skill)),
s AS (SELECT *, coalesce(label <> 'spurious', false) AS ok, attribution IS NOT NULL AS seen, coalesce(label = attribution, false) AS hit FROM p)"""


@query(
    "prf",
    f"""WITH {SQL_PAIRS}, n AS (SELECT 'lexicon' AS system, count(*) FILTER (ok) AS tp, count(*) FILTER (label = 'spurious') AS fp, 0::BIGINT AS fn FROM s
UNION ALL SELECT 'model', count(*) FILTER (ok AND seen), count(*) FILTER (label IS NULL AND seen), count(*) FILTER (ok AND NOT seen) FROM s)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n""",
)
def prf(spark, sf_dir):
    return scoring.detection(_pairs(spark, sf_dir))


@query(
    "accuracy",
    f"""WITH {SQL_PAIRS}, n AS (SELECT 'common' AS scope, 'baseline' AS system, count(*) FILTER (ok AND seen AND label = 'required') AS correct, count(*) FILTER (ok AND seen) AS total FROM s
UNION ALL SELECT 'common', 'model', count(*) FILTER (ok AND hit), count(*) FILTER (ok AND seen) FROM s
UNION ALL SELECT 'end_to_end', 'baseline', count(*) FILTER (ok AND label = 'required'), count(*) FILTER (ok) FROM s
UNION ALL SELECT 'end_to_end', 'model', count(*) FILTER (ok AND hit), count(*) FILTER (ok) FROM s) SELECT *, round(correct / total, 6) AS accuracy FROM n""",
)
def accuracy(spark, sf_dir):
    return scoring.accuracy(_pairs(spark, sf_dir))


SQL_CLASSES = "c(x) AS (VALUES " + ", ".join(f"('{x}')" for x in CLASSES4) + ")"


@query("confusion", f"WITH {SQL_PAIRS}, {SQL_CLASSES} SELECT a.x AS gold, b.x AS predicted, (SELECT count(*) FROM s WHERE label = a.x AND attribution = b.x) AS n FROM c a CROSS JOIN c b")
def confusion(spark, sf_dir):
    return scoring.confusion(_pairs(spark, sf_dir))


@query("per_class", f"WITH {SQL_PAIRS} SELECT label, count(*) AS n_gold, count(*) FILTER (seen) AS n_common, count(*) FILTER (hit) AS n_correct FROM s WHERE ok GROUP BY 1")
def per_class(spark, sf_dir):
    return scoring.per_class(_pairs(spark, sf_dir))


@query("disagreements", f"WITH {SQL_PAIRS} SELECT job_id, skill, label AS gold, attribution AS predicted FROM s WHERE ok AND seen AND NOT hit")
def disagreements(spark, sf_dir):
    return scoring.disagreements(_pairs(spark, sf_dir))


SQL_RANK = "list_position(['required', 'preferred', 'boilerplate', 'not_expected'], {})"


@query("transitions", f"WITH {SQL_PAIRS} SELECT label AS gold, attribution AS predicted, count(*) AS n, CASE WHEN {SQL_RANK.format('attribution')} > {SQL_RANK.format('label')} THEN 'softer' ELSE 'stricter' END AS direction FROM s WHERE ok AND seen AND NOT hit GROUP BY label, attribution")
def transitions(spark, sf_dir):
    return scoring.transitions(_pairs(spark, sf_dir))


# Documents, grounding, validation ---------------------------------------------------------------------------------


@query(
    "collect_by_class",
    "SELECT conv_id, " + ", ".join(f"coalesce(array_to_string(list(turn ORDER BY turn, text) FILTER (role = '{r}'), ','), '') AS {r}_turns" for r in ("system", "user", "assistant")) + " FROM conversations GROUP BY 1",
)
def collect_by_class(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text", "role").alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    pick = lambda r: F.array_join(F.transform(F.filter("ts", lambda t: t["role"] == r), lambda t: t["turn"].cast("string")), ",").alias(f"{r}_turns")
    return grouped.select("conv_id", *[pick(r) for r in ("system", "user", "assistant")])


SQL_FOLD = "regexp_replace(lower(translate({}, '‘’“”–—', '''''\"\"--')), '\\s', '', 'g')"


@query("grounding", f"SELECT doc_id, CASE WHEN length(text) > 0 THEN strpos({SQL_FOLD.format('text')}, {SQL_FOLD.format('text[11:60]')}) > 0 AND length(text[11:60]) > 0 ELSE false END AS grounded, CASE WHEN length(text) > 0 THEN strpos({SQL_FOLD.format('text')}, 'theand') > 0 ELSE false END AS fused FROM documents")
def grounding(spark, sf_dir):
    docs = X.with_once(table(spark, sf_dir, "documents").select("doc_id", "text"), folded=X.without_spaces(F.col("text")))
    found = lambda evidence, name: X.is_grounded(evidence, F.col("text"), F.col("folded")).alias(name)
    return docs.select("doc_id", found(F.col("text").substr(11, 50), "grounded"), found(F.lit("The  AND"), "fused"))


def _answers(spark, sf_dir) -> DataFrame:
    """Model answers in the shapes seen in the wild, one a document: fenced, bare, with prose, broken."""
    doc = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"skills": [{"skill": "s'), doc, F.lit('", "attribution": "required", "evidence": "e"}], "seniority": "mid", "years_experience_min": '), (F.col("doc_id") % 60).cast("string"), F.lit("}"))
    shape = F.col("doc_id") % 5
    raw = (
        F.when(shape == 0, good)
        .when(shape == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here it is: "), good, F.lit(" Done.")))
        .when(shape == 3, F.regexp_replace(good, '"mid"', '"Mid"'))
        .otherwise(F.regexp_replace(good, r"\}$", ', "more": 1}'))
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


SQL_GOOD = """'{"skills": [{"skill": "s' || doc_id || '", "attribution": "required", "evidence": "e"}], "seniority": "mid", "years_experience_min": ' || (doc_id % 60) || '}'"""


@query("fence_strip", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN g WHEN 1 THEN g WHEN 2 THEN 'Here it is: ' || g || ' Done.' WHEN 3 THEN replace(g, '\"mid\"', '\"Mid\"') ELSE g[:-2] || ', \"more\": 1}}' END AS body FROM (SELECT doc_id, {SQL_GOOD} AS g FROM documents)")
def fence_strip(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", X.strip_fences(F.col("raw")).alias("body"))


@query("brace_slice", f"SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN replace(g, '\"mid\"', '\"Mid\"') WHEN 4 THEN g[:-2] || ', \"more\": 1}}' ELSE g END AS body FROM (SELECT doc_id, {SQL_GOOD} AS g FROM documents)")
def brace_slice(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", X.json_slice(F.col("raw")).alias("body"))


@query(
    "validate_extraction",
    """SELECT doc_id, coalesce(r IS NULL, true) AS ok, r AS reason, CASE WHEN r IS NULL THEN CAST(doc_id % 60 AS INTEGER) END AS years FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'not a JSON object' WHEN doc_id % 5 = 3 THEN 'invalid seniority' WHEN doc_id % 5 = 4 THEN 'unknown key'
WHEN doc_id % 60 > 50 THEN 'years out of range' END AS r FROM documents)""",
)
def validate_extraction(spark, sf_dir):
    checked = _answers(spark, sf_dir).select("doc_id", enrich.validated(F.col("raw")).alias("v"))
    return checked.select("doc_id", "v.ok", "v.reason", F.col("v.extraction.years_experience_min").alias("years"))


@query("prompt_build", f"SELECT doc_id, CAST(length(text[1:{X.PROMPT_CHARS}]) + {len(enrich.PROMPT) - len('{title}{description}')} + length(CAST(doc_id AS VARCHAR)) AS INTEGER) AS n_chars FROM documents")
def prompt_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(enrich.prompt_column(F.col("doc_id").cast("string"), F.col("text"))).alias("n_chars"))


#: The prose has no wording of demand or wish, so these words stand in for it.
CUES = (("not_expected", (" by ",)), ("preferred", (" with ", " pour ")), ("required", (" the ", " der ", " des ")))


def _enriched(kept: DataFrame) -> DataFrame:
    """Enriched records of silver postings, written once: a model is called once a posting, whoever reads."""
    tuned(kept.sparkSession)
    # Rules wait on nothing, so threads would only contend.
    return materialise(enrich.enrich(kept, enrich.RuleProvider(WORDS, CUES), workers=1, pause_s=0.0), "records")


def _records(spark, sf_dir) -> DataFrame:
    """Only records are written: nothing else reads the silver postings."""
    return _enriched(funnel.silver(postings(spark, sf_dir)))


@query("enrich_rule_based")
def enrich_rule_based(spark, sf_dir):
    return _records(spark, sf_dir).withColumn("skills", F.to_json("skills"))


@query("record_stats")
def record_stats(spark, sf_dir):
    return stats.status_counts(_records(spark, sf_dir))


@query("attribution_distribution")
def attribution_distribution(spark, sf_dir):
    return stats.attribution_distribution(_records(spark, sf_dir))


def _index(spark, sf_dir) -> DataFrame:
    kept = materialise(funnel.silver(postings(spark, sf_dir)), "silver")
    records = _enriched(kept)
    meta = kept.withColumn("skills_gazetteer", match_terms(F.col("description_clean"), SMALL_LEXICON)).withColumn("n_skills", F.size("skills_gazetteer"))
    return matching.assemble(meta, records, matching.embed_records(records, dims=32))


@query("index_documents")
def index_documents(spark, sf_dir):
    return _index(spark, sf_dir).select("job_id", "seniority_llm", "n_skills", F.array_join("skills_required", ",").alias("required"), F.array_join("skills_boilerplate", ",").alias("boilerplate"))


def _labelled_records(spark, sf_dir) -> DataFrame:
    """Records whose skills follow from the labels, so that SQL can say what is assembled of them."""
    first = F.struct(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("skill"), F.when(F.col("toxic") == 1, "preferred").otherwise("required").alias("attribution"), F.lit("e").alias("evidence"), F.lit(True).alias("grounded"))
    second = F.struct(F.lit("base").alias("skill"), F.lit("boilerplate").alias("attribution"), F.lit("e").alias("evidence"), F.lit(True).alias("grounded"))
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"), F.lit("mid").alias("seniority"), F.col("toxic").cast("int").alias("years_experience_min"), F.array(first, second).alias("skills"))


SQL_ASSEMBLED = "FROM documents d JOIN labels l USING (doc_id) JOIN embeddings v ON v.vec_id = d.doc_id WHERE l.quality = 1"


@query(
    "assemble_documents",
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS job_id, source AS company, lang AS experience_level_source, 'mid' AS seniority_llm, CAST(toxic AS INTEGER) AS years_experience_min, 0 AS n_skills,
CASE WHEN toxic = 1 THEN '' ELSE 's' || d.doc_id END AS required, CASE WHEN toxic = 1 THEN 's' || d.doc_id ELSE '' END AS preferred, 'base' AS boilerplate, '' AS not_expected, CAST(len(embedding) AS INTEGER) AS dims {SQL_ASSEMBLED}""",
)
def assemble_documents(spark, sf_dir):
    meta = postings(spark, sf_dir).withColumnRenamed("description", "description_clean").withColumn("skills_gazetteer", F.lit(None).cast("array<string>")).withColumn("n_skills", F.lit(None).cast("int"))
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    docs = matching.assemble(meta, _labelled_records(spark, sf_dir), vectors_)
    lists = [F.array_join(f"skills_{name}", ",").alias(name) for name in CLASSES4]
    return docs.select("job_id", "company", "experience_level_source", "seniority_llm", "years_experience_min", "n_skills", *lists, F.size("embedding").alias("dims"))


@query("skipped_records", "SELECT CAST(l.doc_id AS VARCHAR) AS job_id FROM labels l WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.doc_id = l.doc_id)")
def skipped_records(spark, sf_dir):
    meta = postings(spark, sf_dir)
    return matching.skipped(meta, _labelled_records(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding"))


@query("export_readable")
def readable(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.col("source"))
    return export_readable(docs, "doc_id", "title", "text")


@query("upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    merged = latest_by(old, "user_id", "event_id")
    newer = latest_by(new, "user_id", "event_id").join(merged.select("user_id", F.col("event_id").alias("had")), "user_id", "left").filter("had IS NULL OR event_id > had").drop("had")
    return upsert(merged, newer, "user_id")


# Vectors and gaps -------------------------------------------------------------------------------------------------

SQL_COS = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


EVERY = 20
SQL_NEAR = f"""n AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {SQL_COS} AS c FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM n)"""


def _queries(spark, sf_dir) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    tuned(spark)
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn_topk", f"WITH {SQL_NEAR} SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 16")
def knn_topk(spark, sf_dir):
    hits = matching.knn_many(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 16, "vec_id")
    return hits.withColumn("cosine", F.round("cosine", 6))


@query("knn_postfilter", f"WITH {SQL_NEAR} SELECT query_id, vec_id, round((1 + c) / 2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS i FROM t WHERE rank <= 16 AND label > 2) WHERE i <= 8")
def knn_postfilter(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    hits = matching.knn_many(corpus, _queries(spark, sf_dir), 16, "vec_id").join(corpus.select("vec_id", "label"), "vec_id").filter("label > 2")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("i", first).filter("i <= 8").select("query_id", "vec_id", F.round(vectors.cosine_score(F.col("cosine")), 6).alias("score"))


@query("vector_norms", "SELECT count(*) AS n, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS max_norm FROM embeddings")
def vector_norms(spark, sf_dir):
    norms = table(spark, sf_dir, "embeddings").select(vectors.norm(vectors.l2_normalise(F.col("embedding"))).alias("n"))
    return norms.agg(F.count("*").alias("n"), F.round(F.min("n"), 4).alias("min_norm"), F.round(F.max("n"), 4).alias("max_norm"))


CONFIRMED = ("THE", "of", "und")


def _gap(pick) -> Query:
    def run(spark, sf_dir):
        words = F.split(F.col("text"), " ")
        confirmed: Column = F.array(*[F.lit(x) for x in CONFIRMED])
        return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pick(words, confirmed), " ").alias("names"))

    return run


SQL_GAP = "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: {} (lower(x) IN ('the', 'of', 'und'))), ' ') AS names FROM documents"
query("skill_gap", SQL_GAP.format("NOT"))(_gap(arrays.missing))
query("skill_have", SQL_GAP.format(""))(_gap(arrays.present))


@query("match_profile")
def match_profile(spark, sf_dir):
    hits = matching.match(_index(spark, sf_dir), "Posting", ["the", "of"], query=vectors.hashing_encode("the of", 32))
    return hits.withColumns({c: F.array_join(c, ",") for c in ("have", "missing")})


# Sources and sinks: what a writer wrote, read back ----------------------------------------------------------------


@query("csv_strings", "SELECT CAST(doc_id AS VARCHAR) AS job_id, coalesce(source, '') AS company_name, md5(coalesce(text, '')) AS description_md5, CAST(CASE WHEN regexp_matches(lang, '\\S') THEN 1 ELSE 0 END AS INTEGER) AS remote_allowed FROM documents")
def csv_strings(spark, sf_dir):
    path = scratch(spark, "csv")
    raw = postings(spark, sf_dir).withColumn("remote_allowed", F.col("formatted_experience_level"))
    raw.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    read = readers.as_raw_records(readers.read_csv_strings(spark, path))
    return read.select("job_id", "company_name", F.md5("description").alias("description_md5"), "remote_allowed")


@query("csv_head", "SELECT least(count(*), 50) AS n, least(count(*), 50) AS n_ids FROM documents")
def csv_head(spark, sf_dir):
    path = scratch(spark, "csv")
    postings(spark, sf_dir).drop("description").withColumn("description", F.lit("x")).write.options(header=True).csv(path)
    return readers.read_csv_strings(spark, path, head=50).agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("n_ids"))


@query("jsonl_lines", "SELECT CAST(doc_id AS VARCHAR) AS job_id, source AS company_name, md5(text) AS description_md5 FROM documents")
def jsonl_lines(spark, sf_dir):
    path = scratch(spark, "jsonl")
    write_jsonl(postings(spark, sf_dir), path)
    return parse_json(readers.read_jsonl_lines(spark, path)).select("job_id", "company_name", F.md5("description").alias("description_md5"))


@query("json_directory", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_directory(spark, sf_dir):
    path = scratch(spark, "objects")
    nations = table(spark, sf_dir, "nation")
    # One object a file, as the per-record sink leaves them.
    nations.repartitionByRange(64, "n_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_json_directory(spark, path, nations.schema)


@query("id_list", "SELECT CAST(doc_id AS VARCHAR) AS job_id, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INTEGER) AS pos FROM labels WHERE toxic = 1")
def id_list(spark, sf_dir):
    path = scratch(spark, "ids")
    write_id_list(_toxic_ids(spark, sf_dir), path, "doc_id")
    return readers.read_id_list(spark, f"{path}/*.txt")


@query("label_lines", "SELECT CAST(doc_id AS VARCHAR) AS job_id, 'x' AS skill, CASE WHEN toxic = 1 THEN 'spurious' ELSE 'required' END AS label FROM labels")
def label_lines(spark, sf_dir):
    path = scratch(spark, "labels")
    lines = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(" | x | "), F.when(F.col("toxic") == 1, "spurious").otherwise("required")).alias("value"))
    lines.coalesce(1).write.text(path)
    return readers.read_labels(spark, f"{path}/*.txt")


@query("records_pending", "SELECT CAST(doc_id AS VARCHAR) AS job_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def records_pending(spark, sf_dir):
    """Records are appended twice; failed ones are due again, written ones aren't."""
    path = scratch(spark, "records")
    records = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("job_id"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    append_records(records.filter("status = 'ok'"), path)
    append_records(pending(records, path), path)
    return pending(postings(spark, sf_dir).select("job_id"), path, retry_failed=True)


@query("tsv_table", "SELECT event_type AS skill, CAST(count(*) AS VARCHAR) AS count FROM events GROUP BY 1")
def tsv_table(spark, sf_dir):
    path = scratch(spark, "tsv")
    write_tsv(stats.frequency(table(spark, sf_dir, "events").select(F.col("event_type").alias("skill")), "skill", out="count"), path)
    return spark.read.options(header=True, sep="\t", quote="").csv(path)


@query("parquet_overwrite", "SELECT doc_id, lang FROM documents")
def parquet_overwrite(spark, sf_dir):
    path = scratch(spark, "table")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for rows in (docs.limit(3), docs):
        write_parquet(rows, path)
    return readers.read_documents(spark, path, ["doc_id", "lang"])


@query("vector_table", "SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def vector_table(spark, sf_dir):
    path = scratch(spark, "vectors")
    write_parquet(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("job_id"), vectors.l2_normalise(F.col("embedding")).alias("embedding")), path)
    return readers.read_documents(spark, path).select("job_id", F.size("embedding").alias("dims"))


@query("index_upsert", "SELECT CAST(doc_id AS VARCHAR) AS job_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS state, (SELECT count(*) FROM documents) AS n FROM documents")
def index_upsert(spark, sf_dir):
    """All documents are indexed, the labelled ones again, one of them without a key."""
    path, schema = scratch(spark, "index"), T.StructType([T.StructField("job_id", T.StringType()), T.StructField("state", T.StringType())])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.lit("old").alias("state"))
    write_index(docs, path, schema)
    again = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("job_id")), "job_id", "left_semi").withColumn("state", F.lit("new"))
    write_index(again.union(spark.createDataFrame([(None, "new")], schema)), path, schema)
    return read_index(spark, path).withColumn("n", F.lit(index_health(spark, path)["count"]).cast("long"))


# Streaming --------------------------------------------------------------------------------------------------------


@query("stream_bronze", "SELECT event_id, user_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events")
def stream_bronze(spark, sf_dir):
    """The events file as a stream, parsed and drained once, read back as a batch."""
    from millrace.streaming.ingest import bronze, file_stream

    schema = table(spark, sf_dir, "events").schema
    source = table(spark, sf_dir, "events").inputFiles()[0].rsplit("/", 1)
    stream = file_stream(spark, source[0], "parquet", schema, glob="events.parquet" if source[1] == "events.parquet" else "*.parquet")
    props = T.StructType([T.StructField("k", T.LongType())])
    rows = stream.select("event_id", "user_id", "event_type", F.from_json("props", props)["k"].alias("k"))
    out = scratch(spark, "bronze")
    return bronze(spark, rows, f"{out}/data", f"{out}/checkpoint")


@query("raw_records", "SELECT CAST(doc_id AS VARCHAR) AS job_id, source AS company_name, CASE WHEN regexp_matches(lang, '\\S') THEN '1' ELSE '0' END AS remote_allowed FROM documents")
def raw_records(spark, sf_dir):
    """Documents as JSON values and back through the raw schema, numbers landing as strings."""
    from millrace.sources.readers import as_raw_records

    raw = as_raw_records(postings(spark, sf_dir).withColumn("remote_allowed", F.col("formatted_experience_level")))
    sent = raw.select(F.to_json(F.struct(*raw.columns)).cast("binary").alias("value"))
    return parse_json(sent).select("job_id", "company_name", "remote_allowed")
