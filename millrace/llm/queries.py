"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, classifier, decontaminate, kernel, linededup, mixing, neardup, pii, quality, sharding, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return kernel.tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard(rows, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STRIP = "regexp_replace({}, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_linededup",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {ASCII_LOWER.format(STRIP.format("line"))} AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key),
d AS (SELECT k.*, coalesce(c.n >= 5 AND k.doc_id < c.last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
)
def op2_linededup(spark, sf_dir):
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256).alias("kept_sha256"))


WORDS3 = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op3_decontaminate",
    f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS3.format(ASCII_LOWER.format("text"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({WORDS3.format(ASCII_LOWER.format("text"))}, []) AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def op3_decontaminate(spark, sf_dir):
    found = decontaminate.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS4 = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


@query(
    "op4_neardup",
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS4.format(ASCII_LOWER.format("text"))}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN c p ON p.doc_id = x.doc_id JOIN c q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
m AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)""",
)
def op4_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


SQL_TURNS = """c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
e AS (SELECT conv_id, t[1 : list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant'))] AS a FROM c WHERE len(list_filter(t, lambda x: x.role = 'assistant')) > 0),
p AS (SELECT e.conv_id, xor(e.conv_id, 1) AS rejected_from, e.a, list_append(e.a[1 : len(e.a) - 1], {'role': 'assistant', 'text': o.a[len(o.a)].text}) AS b FROM e JOIN e o ON o.conv_id = xor(e.conv_id, 1)),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, len(a)) AS n FROM p),
r AS (SELECT *, a[n + 1 :] AS ra, b[n + 1 :] AS rb FROM n)"""
RENDER = "array_to_string(list_transform({}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')"


@query(
    "op5_chat",
    f"""WITH {SQL_TURNS} SELECT conv_id, rejected_from, CAST(n AS INTEGER) AS n_prefix_turns, {RENDER.format("a[1:n]")} AS prompt, {RENDER.format("ra")} AS chosen, {RENDER.format("rb")} AS rejected,
CASE WHEN len(ra) = 0 THEN '' ELSE '14:' || (22 + length(ra[1].text)) END AS chosen_mask, CASE WHEN len(rb) = 0 THEN '' ELSE '14:' || (22 + length(rb[1].text)) END AS rejected_mask FROM r""",
)
def op5_chat(spark, sf_dir):
    done = chat.preference_pairs(chat.swapped_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return done.select("conv_id", "rejected_from", "n_prefix_turns", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


SQL_MIX = """d AS (SELECT doc_id, coalesce('=' || source, '') AS s, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT s, source, size, count(*)::BIGINT AS n FROM d GROUP BY ALL),
c AS (SELECT s, source, sum(size * n)::BIGINT AS source_size, sum(n)::BIGINT AS cnt, min(size) FILTER (size > 0) AS least FROM h GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM c),
l AS (SELECT *, 3 * source_size / weight AS ratio, (sum(source_size) OVER ()::BIGINT - coalesce(sum(3 * source_size) OVER b, 0)::BIGINT) / (sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT) AS level FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
t AS (SELECT l.s, source_size, cnt, least, least(3.0::DOUBLE * source_size, v.level * weight) AS target FROM l, v),
z(i, s, target, low, high) AS (SELECT 0, s, target, -50.0::DOUBLE, ln(3.0::DOUBLE) / least FROM t WHERE target > 0 AND target < 3 * source_size
UNION ALL SELECT i + 1, s, target, CASE WHEN f < target THEN (low + high) / 2 ELSE low END, CASE WHEN f < target THEN high ELSE (low + high) / 2 END
FROM (SELECT z.i, z.s, z.target, z.low, z.high, sum(h.n * h.size * least(3.0::DOUBLE, exp((z.low + z.high) / 2 * h.size))) AS f FROM z JOIN h ON z.s = h.s WHERE z.i < 120 GROUP BY ALL)),
r AS (SELECT t.*, (z.low + z.high) / 2 AS tilt FROM t LEFT JOIN z ON z.s = t.s AND z.i = 120),
k AS (SELECT d.doc_id, d.s, d.size, r.source_size, r.target, round(CASE WHEN r.source_size = 0 THEN 0.0 WHEN tilt IS NULL THEN 3.0 ELSE least(3.0::DOUBLE, exp(tilt * d.size)) END * 1000000)::BIGINT AS units, ('0x' || md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size)[1:8])::BIGINT % CAST(ceil(r.cnt / 1024) AS BIGINT) AS g FROM d JOIN r ON d.s = r.s),
q AS (SELECT *, units // 1000000 AS floor, units % 1000000 AS more, row_number() OVER (PARTITION BY s, g ORDER BY size DESC, doc_id ASC NULLS LAST) AS rank FROM k),
a(s, g, rank, c, owed) AS (SELECT DISTINCT s, g, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM q
UNION ALL SELECT s, g, rank, floor + up, owed + units * size - (floor + up) * 1000000 * size FROM (SELECT q.*, a.owed, CASE WHEN q.more > 0 AND 2 * (a.owed + q.more * q.size) >= 1000000 * q.size THEN 1 ELSE 0 END AS up FROM a JOIN q ON q.s = a.s AND q.g = a.g AND q.rank = a.rank + 1)),
e AS (SELECT s, g, arg_max(owed, rank) AS owed FROM a GROUP BY ALL),
b(s, g, rank, c, owed) AS (SELECT s, g, 0::BIGINT, 0::BIGINT, owed FROM e
UNION ALL SELECT s, g, rank, c + more, owed - more * 1000000 * size FROM (SELECT x.s, x.g, x.rank, x.c, q.size, b.owed, greatest(-x.c, least(3 - x.c, CASE WHEN q.size = 0 THEN 0 ELSE sign(b.owed)::BIGINT * (abs(b.owed) // (1000000 * q.size)) END)) AS more FROM b JOIN a x ON x.s = b.s AND x.g = b.g AND x.rank = b.rank + 1 JOIN q ON q.s = b.s AND q.g = b.g AND q.rank = b.rank + 1))"""


@query("op6_mixing", f"WITH RECURSIVE {SQL_MIX} SELECT q.doc_id, q.size, q.source_size, q.target, (b.c * q.size)::BIGINT AS taken FROM q JOIN b ON q.s = b.s AND q.g = b.g AND q.rank = b.rank")
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.token_size(F.col("text")).alias("size"))
    return mixing.with_copies(sized).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_quality")
def op7_quality(spark, sf_dir):
    done = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return done.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@query("op8_classifier")
def op8_classifier(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    done = toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return done.select("doc_id", "expected_severity", "severity", "toxic_probability", "toxic")


@query("op10_pii")
def op10_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    lists = {kind: pii.listed(kind, F.col(kind)) for kind in pii.KINDS}
    base, more = F.concat(*lists.values()), pii.listed(pii.FOUND, F.col("found"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        F.size(F.concat(base, more)).cast("long").alias("n_spans"),
    )
