import json
import os

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import arrays, vectors
from millrace.functions import text as X
from millrace.functions.lexicon import Lexicon, canonicalise, default_lexicon, match_terms
from millrace.operators import enrich, funnel, idlists, matching, reports, sampling, scoring, stats
from millrace.session import BATCH_SETTING
from millrace.sources import readers, writers
from millrace.streaming import ingest


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def one(spark, text, column):
    return values(spark, [(text,)], "t string", column)[0][0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a<b>c</b>  d", "a c d"), ("\n", ""), ("x y", "x y"), (None, None), ("<p>&amp;</p>", "&amp;")],
)
def test_clean(spark, text, want):
    assert one(spark, text, X.clean_html(F.col("t"))) == want


@pytest.mark.parametrize(("text", "present", "blank"), [(None, False, True), ("", False, True), ("  ", False, True), ("\n", True, True), ("x", True, False)])
def test_presence_differs_by_site(spark, text, present, blank):
    assert values(spark, [(text,)], "t string", X.is_present(F.col("t")), X.is_blank(F.col("t"))) == [(present, blank)]


def test_funnel_thresholds(spark):
    five, four = "the and for with you ", "the and for with "
    rows = [("1", five + "x" * 180), ("2", five + "x" * 178), ("3", four + "x" * 300), ("4", None), ("5", "\n"), ("1", five + "y" * 180)]
    df = spark.createDataFrame(rows, "job_id string, description string")
    row = funnel.funnel_counts(df).first().asDict()
    assert row == {"bronze": 6, "has_desc": 5, "distinct_ids": 4, "not_english": 2, "too_short": 1, "silver": 2, "blank": 1, "duplicates": 1, "loss": 4, "loss_pct": pytest.approx(66.666667)}
    assert funnel.silver(df, dedupe_on="job_id").count() == 1
    assert "blank text      : -1\n" in funnel.funnel_report(funnel.funnel_counts(df))


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("Google your to go R&D express interest", []),
        ("Golang", ["Go"]),
        ("R programming", ["R"]),
        ("dbt Cloud", ["dbt"]),
        ("Express.js", ["Express", "JavaScript"]),
        ("C++", ["C++"]),
        ("C/C++.", ["C++"]),
        ("C++17", []),
        ("C#,", ["C#"]),
        ("using .NET", []),
        ("ASP.NET", [".NET"]),
        ("MySQL", ["MySQL"]),
        ("T-SQL", ["SQL", "SQL Server"]),
        ("no-SQL", ["NoSQL", "SQL"]),
        ("Node.js", ["JavaScript", "Node.js"]),
        (None, []),
        ("", []),
    ],
)
def test_lexicon(spark, text, terms):
    assert one(spark, text, match_terms(F.col("t"), default_lexicon())) == terms


def test_lexicon_loose_boundaries_and_sizes(spark):
    lexicon = default_lexicon()
    assert len(lexicon.terms) == 111 and sum(len(t.aliases) for t in lexicon.terms) == 80
    assert one(spark, "using .NET", match_terms(F.col("t"), lexicon, strict_boundaries=False)) == [".NET"]
    assert one(spark, "x", match_terms(F.col("t"), Lexicon(()))) == []


def test_canonicalise(spark):
    df = spark.createDataFrame([("C/C++ ",), ("go",), (" K8S\n",), ("knitting",)], "skill string")
    got = sorted((r["skill"], r["canonical"]) for r in canonicalise(df, "skill", default_lexicon()).collect())
    assert got == [(" K8S\n", "Kubernetes"), ("C/C++ ", "C"), ("C/C++ ", "C++"), ("go", "Go")]


@pytest.mark.parametrize(
    ("evidence", "source", "want"),
    [("it’s – fine", "It's - FINE", True), ("development using", "developmentusing", True), ("a b", "a b", True), ("a\u00a0b", "xab", True), ("", "x", False), (None, "x", False), (" ", "x", True), ("b a", "a b", False), ("x", None, False)],
)
def test_grounding(spark, evidence, source, want):
    got = values(spark, [(evidence, source)], "e string, s string", X.is_grounded(F.col("e"), F.col("s")))[0][0]
    assert got == want


@pytest.mark.parametrize(("text", "want"), [("```json\n{}\n```", "{}"), ("```{}```", "{}"), ("```\n{}", "{}"), (" {} ", "{}"), ("{}```", "{}"), ("", "")])
def test_fences(spark, text, want):
    assert one(spark, text, X.strip_fences(F.col("t"))) == want


@pytest.mark.parametrize(("text", "want"), [("a {b} c }", "{b} c }"), ("} {", None), ("none", None), (None, None)])
def test_json_slice(spark, text, want):
    assert one(spark, text, X.json_slice(F.col("t"))) == want


def answer(**over):
    base = {"skills": [{"skill": "SQL", "attribution": "required", "evidence": "knows SQL"}], "seniority": "mid", "years_experience_min": 3}
    return json.dumps({k: v for k, v in (base | over).items() if v != "gone"})


MENTION = {"skill": "SQL", "attribution": "required", "evidence": "e"}


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (answer(), None),
        ("```json\n" + answer() + "\n```", None),
        (answer(skills=[]), None),
        (answer(years_experience_min=None), None),
        (answer(years_experience_min="gone"), None),
        (answer(years_experience_min="3"), None),
        (answer(years_experience_min=3.0), None),
        (answer(years_experience_min=3.5), "years is not a whole number"),
        (answer(years_experience_min=51), "years out of range"),
        (answer(years_experience_min=-1), "years out of range"),
        (answer(extra=1), "unknown key"),
        (answer(seniority="gone"), "invalid seniority"),
        (answer(seniority="Mid"), "invalid seniority"),
        (answer(skills="gone"), "skills is not a list of objects"),
        (answer(skills=[MENTION | {"attribution": "Required"}]), "invalid mention"),
        (answer(skills=[MENTION | {"skill": "x" * 61}]), "invalid mention"),
        (answer(skills=[MENTION | {"evidence": ""}]), "invalid mention"),
        (answer(skills=[MENTION | {"more": "1"}]), "invalid mention"),
        (answer(skills=[{"skill": "SQL"}]), "invalid mention"),
        ("no json", "not a JSON object"),
        (None, "not a JSON object"),
    ],
)
def test_validation(spark, raw, reason):
    assert enrich.fault(raw) == reason
    got = one(spark, raw, enrich.validated(F.col("t")))
    assert (got["reason"], got["ok"], got["extraction"] is None) == (reason, reason is None, reason is not None)


def test_enrich_records_failures_and_retries(spark):
    df = spark.createDataFrame([("1", "t", "knows  SQL"), ("2", "t", "boom"), ("3", "t", "later")], "job_id string, title string, description_clean string")

    good = answer()

    def provider(prompt, most, seen={}):  # noqa: B006
        seen[prompt] = seen.get(prompt, 0) + 1
        if "boom" in prompt or ("later" in prompt and seen[prompt] == 1):
            raise RuntimeError("down")
        return good, {"input_tokens": 5, "output_tokens": 7}

    out = {r["job_id"]: r for r in enrich.enrich(df.coalesce(1), provider, pause_s=0.0).collect()}
    assert (out["1"]["status"], out["1"]["attempt"], out["1"]["skills"][0]["grounded"]) == ("ok", 1, True)
    assert (out["2"]["status"], out["2"]["error"]) == ("failed", "RuntimeError: down")
    assert (out["3"]["attempt"], out["3"]["skills"][0]["grounded"]) == (2, False)


def test_profile_answer(spark):
    df = spark.createDataFrame([('Sure: {"role": "dev", "skills": ["a"]}.',), ("nothing",)], "raw string")
    assert [tuple(r) for r in enrich.parse_profile(df).collect()] == [("dev", ["a"]), ("", [])]


def gold_frames(spark):
    """Counts of the published gold set: 189 required, 53 preferred, 7 boilerplate, 6 spurious; 255 rows."""
    labels = ["required"] * 189 + ["preferred"] * 53 + ["boilerplate"] * 7 + ["spurious"] * 6
    gold = spark.createDataFrame([(str(i // 7), f"s{i}", label) for i, label in enumerate(labels)], "job_id string, skill string, label string")
    predicted = [(str(i // 7), f"s{i}", label) for i, label in enumerate(labels) if label != "spurious" and i not in range(100, 120)]
    predicted += [("x", f"f{i}", "required") for i in range(25)] + [(str(250 // 7), "s250", "required")]
    return gold, spark.createDataFrame(predicted, "job_id string, skill string, attribution string")


def test_published_detection_figures(spark):
    gold, predicted = gold_frames(spark)
    rows = {r["system"]: tuple(r)[1:] for r in scoring.detection(scoring.paired(gold, predicted)).collect()}
    assert rows["lexicon"][:3] == (249, 6, 0) and [round(x, 3) for x in rows["lexicon"][3:]] == [0.976, 1.0, 0.988]
    assert rows["model"][:3] == (229, 25, 20) and [round(x, 3) for x in rows["model"][3:]] == [0.902, 0.920, 0.911]
    e2e = [r for r in scoring.accuracy(scoring.paired(gold, predicted)).collect() if (r["scope"], r["system"]) == ("end_to_end", "baseline")][0]
    assert (e2e["correct"], e2e["total"], round(100 * e2e["accuracy"], 1)) == (189, 249, 75.9)


def test_prf_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "job_id string, skill string, label string, attribution string")
    assert [tuple(r)[4:] for r in scoring.detection(empty).collect()] == [(0.0, 0.0, 0.0)] * 2
    assert scoring.confusion(empty).count() == 16


def test_best_precedence(spark):
    rows = [("1", "a", "boilerplate"), ("1", "a", "preferred"), ("1", "b", "unheard of")]
    got = {r["skill"]: r["attribution"] for r in scoring.best_precedence(spark.createDataFrame(rows, "job_id string, skill string, attribution string")).collect()}
    assert got == {"a": "preferred", "b": None}


def test_samples(spark):
    rows = [(str(i), ["junior", "mid", None][i % 3], i) for i in range(90)]
    df = spark.createDataFrame(rows, "job_id string, band string, n_skills int")
    equal = sampling.equal_sample(df, "band", 10)
    assert sorted(r["count"] for r in equal.groupBy("band").count().collect()) == [10, 10]
    rest = sampling.held_out(df, equal, 10)
    sampling.assert_disjoint(equal, rest)
    with pytest.raises(ValueError, match="share"):
        sampling.assert_disjoint(equal, equal)
    with pytest.raises(Exception, match="stratum too small"):
        sampling.require_full_strata(sampling.equal_sample(df, "band", 31), "band", 31).collect()
    assert sorted(r["count"] for r in sampling.proportional_sample(df, "band", 30).groupBy("band").count().collect()) == [10, 10]
    assert {r["job_id"] for r in sampling.simple_sample(df, 5).collect()} == {r["job_id"] for r in sampling.simple_sample(df.repartition(3), 5).collect()}


def test_ordered_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, v int")
    ids = spark.createDataFrame([("b", 0), ("a", 1)], "job_id string, pos int")
    assert [r["job_id"] for r in idlists.in_list_order(df, ids, strict=True).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no row for id c"):
        idlists.in_list_order(df, ids.union(spark.createDataFrame([("c", 2)], ids.schema)), strict=True).collect()


def test_gap_keeps_order_and_repeats(spark):
    got = values(spark, [(["SQL", "Go", "sql", "Rust"], ["sql"])], "r array<string>, c array<string>", arrays.missing(F.col("r"), F.col("c")), arrays.present(F.col("r"), F.col("c")), arrays.missing(F.lit(None).cast("array<string>"), F.col("c")))
    assert got == [(["Go", "Rust"], ["SQL", "sql"], [])]


def test_knn_filters_after_retrieval(spark):
    rows = [(str(i), [1.0, float(i)], ["x"] if i % 2 else []) for i in range(8)]
    df = spark.createDataFrame(rows, "job_id string, embedding array<float>, skills_required array<string>")
    assert [r["job_id"] for r in matching.knn_postfiltered(df, [1.0, 0.0], 2).collect()] == ["1", "3"]
    assert [r["job_id"] for r in matching.knn(df, [1.0, 0.0], 3).collect()] == ["0", "1", "2"]
    assert one(spark, "SQL and Go", F.round(vectors.norm(vectors.hashing_encoder(F.col("t"), 16)), 5)) == 1.0


def test_status_counts(spark):
    rows = [("1", "ok", [("a", "required", "e", True), ("b", "preferred", "e", False)], 3, 4), ("2", "ok", [], 1, None), ("3", "failed", None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, skills array<struct<skill:string,attribution:string,evidence:string,grounded:boolean>>, input_tokens long, output_tokens long")
    row = stats.status_counts(df).first().asDict()
    assert (row["n_ok"], row["n_error"], row["n_zero_skill"], row["n_mentions"], row["n_grounded"], row["input_tokens"], row["output_tokens"], row["grounded_rate"]) == (2, 1, 1, 2, 1, 4, 4, 0.5)
    assert stats.status_counts(df.filter("false")).first()["grounded_rate"] is None
    assert [r["job_id"] for r in stats.error_ids(df).collect()] == ["3"]


def test_csv_and_labels(spark, tmp_path):
    header = ",".join([*schemas.RAW_COLUMNS, "unused"])
    (tmp_path / "p.csv").write_text(header + '\n1,"a ""b""","",“x\ny”,,,,1.0,17,z\n2,t,c,d,l,e,w,,18,z\n'.replace("“", '"').replace("”", '"'))
    raw = readers.read_csv_strings(spark, str(tmp_path / "p.csv"))
    got = {r["job_id"]: r for r in readers.as_raw_records(raw).collect()}
    assert (got["1"]["title"], got["1"]["company_name"], got["1"]["description"]) == ('a "b"', "", "x\ny")
    assert (got["1"]["remote_allowed"], got["2"]["remote_allowed"]) == (1, 0)
    (tmp_path / "bad.csv").write_text("job_id\n1\n")
    with pytest.raises(schemas.SchemaMismatch):
        readers.read_csv_strings(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "g.tsv").write_text("1 | a | required\n\n1|a|preferred\n2|b|spurious\n")
    assert sorted(map(tuple, readers.read_labels(spark, str(tmp_path / "g.tsv")).collect())) == [("1", "a", "preferred"), ("2", "b", "spurious")]
    (tmp_path / "h.tsv").write_text("1|a\n")
    with pytest.raises(Exception, match="not three fields"):
        readers.read_labels(spark, str(tmp_path / "h.tsv")).collect()
    (tmp_path / "ids.txt").write_text(" b \n\na\n")
    assert [tuple(r) for r in readers.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == [("b", 0), ("a", 2)]


def test_jsonl_stream_is_drained_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "é") for i in range(20)], "job_id string, title string")
    writers.write_jsonl(rows, f"{tmp_path}/replay", files=3)
    stream = lambda: ingest.parsed(ingest.file_stream(spark, f"{tmp_path}/replay", glob="*.json", files_per_trigger=1))
    for _ in range(2):
        out = ingest.bronze(spark, stream(), f"{tmp_path}/bronze", f"{tmp_path}/cp")
        assert (out.count(), out.filter("title = 'é' AND description IS NULL").count()) == (20, 20)
    assert readers.read_jsonl_lines(spark, f"{tmp_path}/replay", 5).count() == 5


def test_pending_upsert_and_strict_index(spark, tmp_path):
    docs = spark.createDataFrame([("1", "ok"), ("2", "failed")], "job_id string, status string")
    path = f"{tmp_path}/records"
    assert writers.pending(docs, path).count() == 2
    writers.append_records(docs, path)
    more = docs.union(spark.createDataFrame([("3", "ok")], docs.schema))
    assert {r["job_id"] for r in writers.pending(more, path).collect()} == {"3"}
    assert {r["job_id"] for r in writers.pending(more, path, retry_failed=True).collect()} == {"2", "3"}
    schema = schemas.T.StructType([schemas.T.StructField("job_id", schemas.T.StringType()), schemas.T.StructField("status", schemas.T.StringType())])
    assert writers.index_health(spark, f"{tmp_path}/index") == {"exists": False, "count": 0}
    writers.write_index(docs, f"{tmp_path}/index", schema)
    old = writers.read_index(spark, f"{tmp_path}/index")
    bad = writers.write_index(spark.createDataFrame([("2", "new"), (None, "lost")], docs.schema), f"{tmp_path}/index", schema)
    assert sorted(map(tuple, writers.read_index(spark, f"{tmp_path}/index").collect())) == [("1", "ok"), ("2", "new")]
    assert [tuple(r) for r in bad.collect()] == [(None, "lost", "no key")]
    assert old.count() == 2 and writers.index_health(spark, f"{tmp_path}/index") == {"exists": True, "count": 2}
    writers.write_index(docs, f"{tmp_path}/index", schema)
    assert len([n for n in os.listdir(f"{tmp_path}/index") if n.startswith("v-")]) == 2
    numbers = schemas.T.StructType([schemas.T.StructField("job_id", schemas.T.StringType()), schemas.T.StructField("n", schemas.T.IntegerType())])
    odd = writers.rejected(spark.createDataFrame([("1", "7"), ("2", "x"), ("3", None)], "job_id string, n string"), numbers)
    assert [tuple(r) for r in odd.collect()] == [("2", "x", "n is no int")]
    with pytest.raises(schemas.SchemaMismatch):
        writers.write_index(docs.withColumn("more", F.lit(1)), f"{tmp_path}/index", schema)
    writers.write_id_list(docs.orderBy(F.desc("job_id")), f"{tmp_path}/ids")
    writers.write_tsv(docs, f"{tmp_path}/tsv")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/ids").collect()] == ["1", "2"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/tsv").collect()) == ["1\tok", "2\tfailed", "job_id\tstatus"]


def test_every_broken_rule_is_asked_again(spark):
    """Each kind of fault in the first answer leads to a second call, and a good one to none."""
    faults = [answer(skills=[MENTION | {"skill": "x" * 61}]), answer(extra=1), answer(years_experience_min=51), answer(seniority="Mid"), "prose"]
    df = spark.createDataFrame([(str(i), f"t{i}", "d") for i in range(len(faults) + 1)], "job_id string, title string, description_clean string").coalesce(1)
    good = answer()

    def provider(prompt, most, seen={}):  # noqa: B006
        seen[prompt] = seen.get(prompt, 0) + 1
        which = next((i for i in range(len(faults)) if f"Title: t{i}\n" in prompt), None)
        return (faults[which] if which is not None and seen[prompt] == 1 else good), {"input_tokens": seen[prompt]}

    out = {r["job_id"]: (r["status"], r["attempt"], r["input_tokens"]) for r in enrich.enrich(df, provider, pause_s=0.0).collect()}
    assert out == {**{str(i): ("ok", 2, 2) for i in range(len(faults))}, str(len(faults)): ("ok", 1, 1)}


def test_a_provider_sees_each_prompt_once(spark, tmp_path, monkeypatch):
    """The index query reads records twice and calls the model once a posting."""
    from millrace.plans import queries

    class Counting(enrich.RuleProvider):
        def __call__(self, prompt, max_tokens):
            with open(f"{tmp_path}/{hash(prompt)}", "a") as handle:
                handle.write("x")
            return super().__call__(prompt, max_tokens)

    monkeypatch.setattr(queries.enrich, "RuleProvider", Counting)
    n = queries.index_documents(spark, "/root/testdata/sf0.001").count()
    calls = [len(open(f"{tmp_path}/{f}").read()) for f in os.listdir(tmp_path)]
    assert n > 0 and set(calls) == {1} and len(calls) >= n


def test_lazy_provider_names_what_is_unset(spark):
    made = []
    connect = lambda settings: made.append(settings) or (lambda prompt, most: (prompt + settings["model"], {}))
    with pytest.raises(RuntimeError, match="not set: key"):
        enrich.LazyProvider(connect, {"key": None, "model": "m"})("p", 1)
    provider = enrich.LazyProvider(connect, {"key": "k", "model": "m"})
    assert made == [] and provider("p", 1)[0] == "pm" and provider("q", 1)[0] == "qm" and len(made) == 1
    df = spark.createDataFrame([("1", "t", "d")], "job_id string, title string, description_clean string")
    unset = enrich.LazyProvider(connect, {"key": ""})
    assert enrich.enrich(df, unset, pause_s=0.0).first()["error"] == "RuntimeError: not set: key"


def test_advice_and_progress(spark):
    hits = spark.createDataFrame([("2", "dev", 0.5, ["Go"]), ("1", "lead", 0.9, ["SQL", "dbt"])], "job_id string, title string, score double, missing array<string>")
    assert "'lead'" in enrich.advise(hits, lambda prompt, most: (prompt, {})) and "SQL, dbt" in enrich.advise(hits, lambda prompt, most: (prompt, {}))
    with pytest.raises(ValueError, match="no match"):
        enrich.advise(hits.filter("false"), lambda prompt, most: (prompt, {}))
    records = spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")
    assert enrich.progress(records, 9, 1.5) == {"done": 3, "total": 9, "ok": 2, "failed": 1, "rate": 2.0, "seconds_left": 3}
    assert enrich.progress(None, 9, 0.0)["seconds_left"] is None


def test_replay_sends_every_line_once(spark, tmp_path):
    lines = spark.range(0, 25, 1, 3).select(F.col("id").cast("string").alias("value")).union(spark.createDataFrame([(None,)], "value string"))

    def connect():
        import uuid

        handle = open(f"{tmp_path}/{uuid.uuid4().hex}", "w")

        class Sender:
            def __call__(self, value):
                handle.write(value + "\n")

            def flush(self):
                handle.close()

        return Sender()

    assert writers.replay(lines, connect, every=5, pause_s=0.0) == 25
    assert sorted(int(x) for f in os.listdir(tmp_path) for x in open(f"{tmp_path}/{f}")) == list(range(25))


def published(spark):
    """Pairs with the published confusion: gold by prediction, 20 gold keys unseen, 25 predictions off the list, 6 spurious."""
    cells = {("required", "required"): 156, ("required", "preferred"): 14, ("required", "boilerplate"): 5, ("preferred", "required"): 7, ("preferred", "preferred"): 40, ("preferred", "not_expected"): 1, ("boilerplate", "required"): 2, ("boilerplate", "boilerplate"): 4}
    unseen = {"required": 14, "preferred": 5, "boilerplate": 1}
    rows = [(g, p) for (g, p), n in cells.items() for _ in range(n)] + [(g, None) for g, n in unseen.items() for _ in range(n)] + [("spurious", None)] * 6 + [(None, "required")] * 25
    return spark.createDataFrame([(str(i % 40), f"s{i}", g, p) for i, (g, p) in enumerate(rows)], "job_id string, skill string, label string, attribution string")


def test_published_evaluation(spark):
    pairs = published(spark)
    mapping = spark.createDataFrame([(547, 265, 282)], "n_mentions long, n_mapped long, n_unmapped long")
    report = reports.evaluation_report(pairs, mapping)
    for piece in ("255 labelled mentions in 40 records: 249 to score, 6 spurious", "282 not (51.6%)", "229    25    20      0.902   0.920  0.911", "249     6     0      0.976   1.000  0.988", "175/229  76.4%", "200/229  87.3%", "189/249  75.9%", "200/249  80.3%", "gold 189, predicted too 175, alike 156", "gold 0, predicted too 0, alike 0"):
        assert piece in report, piece
    moved = {(r["gold"], r["predicted"]): r["n"] for r in scoring.transitions(pairs).collect()}
    assert moved == {("required", "preferred"): 14, ("required", "boilerplate"): 5, ("preferred", "required"): 7, ("boilerplate", "required"): 2, ("preferred", "not_expected"): 1}
    rows = scoring.disagreements(pairs).collect()
    assert len(rows) == 29 and [tuple(r)[:2] for r in rows] == sorted(tuple(r)[:2] for r in rows)


def test_insights_report(spark):
    rows = [("1", "ok", [("a", "required", "e", True), ("b", "preferred", "e", False), ("a", "odd", "e", True)], 3, 4), ("2", "ok", [], 1, None), ("3", "failed", None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, skills array<struct<skill:string,attribution:string,evidence:string,grounded:boolean>>, input_tokens long, output_tokens long")
    report = reports.insights_report(df)
    for piece in ("records         : 3", "grounded        : 2 (66.7%)", "a record        : 1.50", "required        : 1 (33.3%)", "other labels    : odd", "majority        : required at 0.3333", "distinct skills : 2"):
        assert piece in report, piece
    assert "majority        : n/a" in reports.insights_report(df.filter("false"))
    assert reports.percent(1, 0) == "n/a" and stats.distinct_records(df).first()[0] == 3


def test_lexicon_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text("- canonical: Go\n  aliases: [Golang]\n  requires_context: true\n- canonical: SQL\n")
    lexicon = Lexicon.from_yaml(str(tmp_path / "l.yaml"))
    assert [(t.canonical, t.surfaces) for t in lexicon.terms] == [("Go", ("Golang",)), ("SQL", ("SQL",))]


def test_lists_are_bounded(spark, tmp_path, monkeypatch):
    (tmp_path / "ids.txt").write_text("a\nb\n")
    monkeypatch.setattr(readers, "MOST_LIST_BYTES", 2)
    with pytest.raises(ValueError, match="at most 2"):
        readers.read_id_list(spark, str(tmp_path / "ids.txt"))


def test_knn_of_many_queries(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0])]
    corpus = spark.createDataFrame(rows, "job_id long, embedding array<float>").repartition(4)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 1.0]), ("b", [0.0, 3.0, 1.0]), ("c", [0.0, 0.0, 0.0]), ("d", None)], "query_id string, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["job_id"] for r in matching.knn_many(corpus, asked, 5).collect()}
    for name, v in (("a", [1.0, 0.0, 1.0]), ("b", [0.0, 3.0, 1.0])):
        one_by_one = [r["job_id"] for r in matching.knn(corpus.filter("size(embedding) = 3"), v, 5).collect()]
        assert [got[name, k] for k in range(1, 6)] == one_by_one
    assert len(got) == 10


def test_export_heads(spark):
    df = readers.numbered(spark.createDataFrame([("7", "Dev", "one two", ["Go", "SQL"])], "job_id string, title string, d string, terms array<string>"), "job_id")
    block = writers.export_readable(df, "job_id", "title", "d", terms="terms", index="i", total=1).first()["block"]
    assert block == "[1/1] 7  Dev\nterms (2): Go, SQL\none two"


def test_samples_in_band_order(spark):
    df = spark.createDataFrame([("2", "b"), ("1", "b"), ("3", "a")], "job_id string, band string")
    assert [r["job_id"] for r in sampling.in_band_order(df, "band").collect()] == ["3", "1", "2"]


def test_a_worker_holds_little_beside_prompts(spark):
    """Texts stay out of Python, and prompts are taken from the batch a few at a time."""
    before = spark.conf.get(BATCH_SETTING)
    good = answer()

    def provider(prompt, most):
        with open("/proc/self/statm") as handle:
            return good, {"input_tokens": int(handle.read().split()[1]) * 4096}

    text = F.concat(F.lit("ш"), F.repeat(F.lit("x"), 11_000))
    df = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("job_id"), F.lit("t").alias("title"), text.alias("description_clean"))
    try:
        spark.conf.set(BATCH_SETTING, "64m")
        rows = enrich.enrich(df, provider, pause_s=0.0).agg(F.count("*").alias("n"), F.max("input_tokens").alias("held"), F.count_if(F.col("status") == "ok").alias("ok")).first()
    finally:
        spark.conf.set(BATCH_SETTING, before)
    assert rows["n"] == rows["ok"] == 5000 and rows["held"] < 240e6, rows["held"] / 1e6


def test_order_and_bound_of_calls_in_flight():
    drawn = []

    def values():
        for i in range(50):
            drawn.append(i)
            yield i

    for workers in (1, 4):
        drawn.clear()
        taken = enrich.in_flight(lambda x: x * x, values(), workers)
        assert next(taken) == 0 and len(drawn) <= 2 * workers
        assert list(taken) == [i * i for i in range(1, 50)]


def test_equal_vectors_tie_wherever_they_lie(spark, monkeypatch):
    """Copies of a vector get one cosine, so the key decides; keys may be strings and batches small."""
    import numpy as np

    monkeypatch.setattr(matching, "QUERIES_SENT", 9)
    kinds = np.random.default_rng(3).normal(size=(7, 61))
    rows = [(f"{i * 7919 % 3001:04}", [float(x) for x in kinds[i % 7]]) for i in range(3001)]
    corpus = spark.createDataFrame(rows, "job_id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in kinds[i % 7] * (1 + i)]) for i in range(20)], "query_id long, embedding array<double>")
    got: dict = {}
    for r in matching.knn_many(corpus, asked, 16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["job_id"]
    copies = [sorted(job for i, (job, _) in enumerate(rows) if i % 7 == kind)[:16] for kind in range(7)]
    assert {q: [ranks[n] for n in range(1, 17)] for q, ranks in got.items()} == {q: copies[q % 7] for q in range(20)}


def test_words_of_rules_are_found_in_one_pass():
    """The first place of each word is what a search for it alone finds, whatever the word and the case."""
    import re

    words = ("the", "THE", "C++", ".NET", "machine learning", "learning", "los", "c", "K8s", "a_b")
    texts = ("LOſ THE the_ the-THE. c++ C++x C# .NET a c++!", "", "Machine Learning, learning; K8s A_B a_bc", "x.NET the")
    for text in texts:
        alone = {w: m.span() for w in words if (m := re.search(rf"\b{re.escape(w)}\b", text, re.IGNORECASE))}
        assert enrich.RuleProvider(words).firsts(text) == alone
