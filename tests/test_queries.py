import json
import os
import re
import textwrap

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors
from millrace.operators import enrich
from millrace.plans.queries import CUES, ORACLES, QUERIES, SMALL_LEXICON, WORDS
from millrace.schemas import ATTRIBUTIONS
from millrace.session import BATCH_SETTING

SF = os.environ.get("MILLRACE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        compare(df, con, ORACLES[name])
    else:
        assert df.count() > 0


# Queries that SQL can't say, against plain Python -----------------------------------------------------------------


def clean(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"<[^>]+>", " ", text)).strip(" ")


def squeezed(text):
    return re.sub(r"\s", "", text.translate(str.maketrans(X.TYPOGRAPHIC, X.PLAIN)).lower())


@pytest.fixture(scope="module")
def records(con):
    """Silver texts and their records, by plain rules and the same provider."""
    out = {}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        body = clean(text or "")
        hits = sum(re.search(rf"(?<![^\W]){w}(?![^\W])", body.lower()) is not None for w in X.STOPWORDS)
        if not (text or "").strip(" ") or hits < X.MIN_STOPWORDS or len(body) < X.MIN_CHARS:
            continue
        title = f"Posting {doc}"
        raw, usage = enrich.RuleProvider(WORDS, CUES)(enrich.PROMPT.replace("{title}", title).replace("{description}", body[: X.PROMPT_CHARS]), 0)
        fault = enrich.fault(raw)
        data = json.loads(raw)
        for m in data["skills"]:
            m["grounded"] = squeezed(m["evidence"]) in squeezed(body)
        out[str(doc)] = (title, body, fault, data, usage)
    assert len(out) > 20
    return out


def test_enriched_records(spark, records):
    got = {r["job_id"]: r for r in QUERIES["enrich_rule_based"](spark, SF).collect()}
    assert set(got) == set(records)
    for job, (title, _, fault, data, usage) in records.items():
        r = got[job]
        assert (r["title"], r["status"], r["seniority"], r["years_experience_min"]) == (title, "ok" if fault is None else "failed", data["seniority"], data["years_experience_min"])
        assert json.loads(r["skills"]) == data["skills"] and (r["input_tokens"], r["output_tokens"], r["attempt"]) == (usage["input_tokens"], usage["output_tokens"], 1)


def test_record_totals(spark, records):
    row = QUERIES["record_stats"](spark, SF).first()
    mentions = [m for *_, data, _ in records.values() for m in data["skills"]]
    assert (row["n_records"], row["n_ok"], row["n_mentions"], row["n_grounded"]) == (len(records), len(records), len(mentions), sum(m["grounded"] for m in mentions))
    assert row["input_tokens"] == sum(u["input_tokens"] for *_, u in records.values())
    shares = {r["label"]: r["n"] for r in QUERIES["attribution_distribution"](spark, SF).collect()}
    assert shares == {a: sum(m["attribution"] == a for m in mentions) for a in ATTRIBUTIONS}


def test_indexed_documents(spark, records):
    got = {r["job_id"]: r for r in QUERIES["index_documents"](spark, SF).collect()}
    assert set(got) == set(records)
    for job, (_, body, _, data, _) in records.items():
        terms = [t.canonical for t in SMALL_LEXICON.terms if re.search(rf"\b{t.canonical}\b", body, re.IGNORECASE)]
        pick = lambda a, data=data: ",".join(m["skill"] for m in data["skills"] if m["attribution"] == a)
        assert (got[job]["seniority_llm"], got[job]["n_skills"], got[job]["required"], got[job]["boilerplate"]) == (data["seniority"], len(terms), pick("required"), pick("boilerplate"))


def test_matched_profile(spark, records):
    hits = QUERIES["match_profile"](spark, SF).collect()
    assert 0 < len(hits) <= 8 and [r["score"] for r in hits] == sorted((r["score"] for r in hits), reverse=True)
    texts = {job: f"{title}. Skills: " + ", ".join(m["skill"] for m in data["skills"]) for job, (title, _, _, data, _) in records.items()}
    rows = spark.createDataFrame(list(texts.items()), "job_id string, t string")
    made = {r["job_id"]: r["v"] for r in rows.select("job_id", vectors.hashing_encoder(rows["t"], 32).alias("v")).collect()}
    asked = vectors.hashing_encode("the of", 32)
    cosine = lambda v: sum(a * b for a, b in zip(v, asked, strict=True)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in asked) ** 0.5)
    nearest = sorted(made, key=lambda job: (-cosine(made[job]), job))[:16]
    required = {job: [m["skill"] for m in data["skills"] if m["attribution"] == "required"] for job, (_, _, _, data, _) in records.items()}
    want = [job for job in nearest if required[job]][:8]
    assert [round(r["score"], 5) for r in hits] == [round((1 + cosine(made[job])) / 2, 5) for job in want]
    for r in hits:
        assert r["have"] == ",".join(s for s in required[r["job_id"]] if s in ("the", "of")) and r["missing"] == ",".join(s for s in required[r["job_id"]] if s not in ("the", "of"))


def test_matching_holds_few_prompts_in_a_worker(spark, monkeypatch, tmp_path):
    """The model call under match_profile bounds its batches, whatever the session's setting is."""
    skill = {"skill": "the", "attribution": "required", "evidence": "the"}
    good = json.dumps({"skills": [skill], "seniority": "mid", "years_experience_min": None})
    held = str(tmp_path / "held")

    def provider(prompt, most):
        with open("/proc/self/statm") as handle, open(held, "a") as out:
            out.write(f"{int(handle.read().split()[1]) * 4096}\n")
        return good, {}

    monkeypatch.setattr(enrich, "RuleProvider", lambda *rules: provider)
    text = F.concat(F.lit("the and for with you are ш"), F.repeat(F.lit("x"), 11_000))
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(11_026).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, "64m")
        hits = QUERIES["match_profile"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(BATCH_SETTING, before)
    with open(held) as handle:
        sizes = [int(line) for line in handle]
    assert len(hits) == 8 and all((r["have"], r["missing"]) == ("the", "") for r in hits)
    assert len(sizes) == 5000 and max(sizes) < 240e6, max(sizes) / 1e6


def test_readable_export(spark, con):
    texts = {d: (s, t) for d, s, t in con.execute("SELECT doc_id, source, text FROM documents").fetchall()}
    got = {r["doc_id"]: r["block"] for r in QUERIES["export_readable"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, (source, text) in texts.items():
        head = f"{d}  {source or ''}"
        assert got[d] == (head if text is None else f"{head}\n{textwrap.fill(text[:X.PROMPT_CHARS], 90)}")


def test_no_plan_deals_rows_round_robin(spark):
    for name in ("quality_funnel", "silver_rows", "lexicon_match", "term_frequency", "grounding", "word_counts", "phrase_masks", "profile_lengths"):
        assert "RoundRobin" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
