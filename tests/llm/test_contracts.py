"""The queries and stages against plain-Python versions, and every operator against awkward rows and names."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases  # noqa: E402
from test_operators import labelled_corpus, plain_mix  # noqa: E402

from millrace.llm import chat, classifier, decontaminate, kernel, linededup, mixing, neardup, pii, quality, sharding, toxicity  # noqa: E402
from millrace.llm.queries import QUERIES  # noqa: E402

DATA = cases.rows(4, 80)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small data folder with the tables that the queries read."""
    path = str(tmp_path_factory.mktemp("sf"))
    cases.frame(spark, DATA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, (i // 4) % 2, (i // 2) % 2) for i in range(0, 80, 2)] + [(i, 1, 0) for i in range(1, 80, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(DATA[20][1].split()[:14])), (2, "One")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


# Sharding ---------------------------------------------------------------------------------------------------------


def test_sharding_query(spark, folder):
    out = QUERIES["op1_sharding"](spark, folder).collect()
    raw = {d: (t or "").encode() for d, t, *_ in DATA}
    assert len(out) == len(DATA)
    slots = defaultdict(list)
    for r in out:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw[r["doc_id"]]) + 16, zlib.crc32(raw[r["doc_id"]]), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_places_are_uniform(spark):
    """Where a row ends doesn't depend on where it stood: chi-squared of input partition by shard, over seeds."""
    df = spark.range(0, 800, 1, 4)
    table = np.zeros((4, 5))
    halves = np.zeros((4, 2))
    for seed in range(12):
        for r in sharding.shard(df, 5, seed=100 + seed).collect():
            table[r["id"] // 200, r["shard"]] += 1
            halves[r["id"] // 200, int(r["slot"] >= 80)] += 1
    for seen, freedom in ((table, 12), (halves, 3)):
        want = seen.sum(1, keepdims=True) * seen.sum(0, keepdims=True) / seen.sum()
        assert ((seen - want) ** 2 / want).sum() < freedom + 5 * np.sqrt(2 * freedom)


# Quality rules ----------------------------------------------------------------------------------------------------


def bucket(gram):
    word = int.from_bytes(gram, "little")
    word ^= word >> 15
    word = word * 0x2C1B3C6D % 2**32
    word ^= word >> 12
    word = word * 0x297A2D39 % 2**32
    return word >> (32 - quality.BUCKET_BITS)


def test_quality_query(spark, folder):
    """Score, threshold and verdict: log ratio of two multinomials over hashed 4-grams, counted in plain Python."""
    texts = {d: (t or "").encode() for d, t, *_ in DATA}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    grams = {d: [bucket(t[i : i + 4]) for i in range(len(t) - 3)] for d, t in texts.items()}
    raw, trusted = Counter(), Counter()
    for d, gs in grams.items():
        raw.update(gs)
        if marks.get(d) == 1:
            trusted.update(gs)
    size = 1 << quality.BUCKET_BITS
    ratio = lambda g: np.log((trusted[g] + 1) / (sum(trusted.values()) + size)) - np.log((raw[g] + 1) / (sum(raw.values()) + size))
    score = {d: sum(map(ratio, gs)) / (len(gs) + quality.PRIOR_GRAMS) for d, gs in grams.items()}
    known = sorted(marks)
    cut = cases.best_cut(np.round([score[d] for d in known], 9), np.array([marks[d] == 1 for d in known]), quality.MAX_LOSS)
    for r in QUERIES["op7_quality"](spark, folder).collect():
        assert abs(r["score"] - score[r["doc_id"]]) < 1e-8
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert abs(r["score"] - cut) < 1e-7 or r["kept"] == (not r["base_failed"] and r["score"] >= cut)


# Classifier -------------------------------------------------------------------------------------------------------


def nested_strength(groups):
    """Of (parent, scores) lists: noise over spread by nested analysis of variance, from the single scores."""
    parents = defaultdict(list)
    for p, xs in groups:
        parents[p] += xs
    n, k = sum(len(xs) for _, xs in groups), len(groups)
    noise = sum(sum((x - np.mean(xs)) ** 2 for x in xs) for _, xs in groups) / (n - k)
    between = sum(len(xs) * (np.mean(xs) - np.mean(parents[p])) ** 2 for p, xs in groups)
    own = sum(len(xs) ** 2 / len(parents[p]) for p, xs in groups)
    spread = (between - (k - len(parents)) * noise) / (n - own)
    return min(max(noise / spread, classifier.STRENGTH[0]), classifier.STRENGTH[1]) if spread > 0 else classifier.STRENGTH[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_site_posteriors(spark, seed):
    """Hosts and paths of a URL, sparse ones among them, against the formulas over single scores."""
    rng = random.Random(seed)
    rows = []
    for host in range(12):
        mean = rng.uniform(0.2, 0.9)
        for path in range(rng.randint(1, 4)):
            inner = min(max(mean + rng.gauss(0, 0.15 if seed < 3 else 0), 0.05), 0.95)
            rows += [(f"h{host}.org", f"/p{path}", round(min(max(rng.gauss(inner, 0.1), 0.0), 1.0), 9)) for _ in range(rng.choice([1, 2, 30]))]
    urls = spark.createDataFrame([(f"https://{h}{p}/x{i}.html", s) for i, (h, p, s) in enumerate(rows)], "url string, doc_score double")
    site = urls.select(F.expr("parse_url(url, 'HOST')").alias("host_key"), F.regexp_extract("url", r"^https://([^/]+/[^/]+)/", 1).alias("site"), "doc_score")
    got, mean = classifier.site_posteriors(site)
    got = {r["site"]: (r["host_posterior"], r["path_posterior"], r["n"]) for r in got.collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, s in rows:
        hosts[h].append(s)
        paths[h, p].append(s)
    whole = np.mean([s for *_, s in rows])
    assert abs(mean - whole) < 1e-9
    a, b = nested_strength([(0, xs) for xs in hosts.values()]), nested_strength([(h, xs) for (h, _), xs in paths.items()])
    shrink = lambda xs, prior, k: (sum(xs) + k * prior) / (len(xs) + k)
    for (h, p), xs in paths.items():
        host = shrink(hosts[h], whole, a)
        assert got[h + p] == pytest.approx((host, shrink(xs, host, b), len(xs)), rel=1e-5)


def test_classifier_query(spark, folder):
    """Verdicts from the document scores and the posteriors of source and language, null a site of its own."""
    out = QUERIES["op8_classifier"](spark, folder).collect()
    place = {d: (s, lang) for d, _, lang, s, *_ in DATA}
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in out:
        hosts[place[r["doc_id"]][0]].append(r["doc_score"])
        paths[place[r["doc_id"]]].append(r["doc_score"])
    mean = np.mean([r["doc_score"] for r in out])
    a, b = nested_strength([(0, xs) for xs in hosts.values()]), nested_strength([(h, xs) for (h, _), xs in paths.items()])
    clipped = lambda p: min(max(p, classifier.CLIP), 1 - classifier.CLIP)
    odds = lambda p: np.log(clipped(p) / (1 - clipped(p)))
    for r in out:
        h = place[r["doc_id"]][0]
        host = (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)
        xs = paths[place[r["doc_id"]]]
        path = (sum(xs) + b * host) / (len(xs) + b)
        score = 1 / (1 + np.exp(-(odds(r["doc_score"]) + odds(path) - odds(mean))))
        assert r["quality_score"] == pytest.approx(score, abs=1e-4) and r["kept"] == (r["quality_score"] >= 0.5)


def test_logistic_fit():
    """Newton's optimum: the penalised gradient, summed plainly, is nothing."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=3000) > 0.2).astype(float)
    mean, scale, w = classifier.fit(x, y)
    z = np.hstack([np.ones((3000, 1)), (x - x.mean(0)) / (x.std(0) + 1e-6)])
    p = 1 / (1 + np.exp(-z @ w))
    gradient = z.T @ (y - p) - np.concatenate(([1e-3], np.full(5, classifier.RIDGE))) * w
    assert np.abs(gradient).max() < 1e-2


# Toxicity ---------------------------------------------------------------------------------------------------------


def plain_loss(x, dense, grade, penalty, levels):
    """Penalised negative log-likelihood of ordered grades, a text at a time."""
    w, raw = x[: dense.shape[1]], x[dense.shape[1] :]
    theta, out = [raw[0]], 0.5 * sum(p * v * v for p, v in zip(penalty, w, strict=True))
    for gap in raw[1:]:
        theta.append(theta[-1] + np.exp(gap))
    over = lambda eta, k: 1.0 if k == 0 else 0.0 if k > levels else 1 / (1 + np.exp(theta[k - 1] - eta))
    for row, g in zip(dense, grade, strict=True):
        out -= np.log(over(row @ w, g) - over(row @ w, g + 1))
    return out


def test_ordinal_fit_is_the_cumulative_link_optimum():
    rng = np.random.default_rng(7)
    dense = (rng.random((300, 6)) < 0.4) * rng.uniform(0.5, 2, (300, 6))
    grade = np.digitize(dense @ np.array([2, -1, 1, 0, 0, 0.5]) + rng.logistic(size=300), [1.0, 2.5])
    starts = np.concatenate(([0], np.cumsum((dense > 0).sum(1))))
    penalty = np.full(6, 0.7)
    w, theta = toxicity.fit(starts, np.nonzero(dense)[1], dense[dense > 0], 6, grade, penalty, steps=500)
    assert theta[0] < theta[1]
    x = np.concatenate((w, [theta[0], np.log(theta[1] - theta[0])]))
    best = plain_loss(x, dense, grade, penalty, 2)
    for _ in range(200):
        assert plain_loss(x + rng.normal(0, 0.02, len(x)), dense, grade, penalty, 2) > best - 1e-3
    step = 1e-5
    slopes = [(plain_loss(x + step * e, dense, grade, penalty, 2) - plain_loss(x - step * e, dense, grade, penalty, 2)) / (2 * step) for e in np.eye(len(x))]
    assert np.abs(slopes).max() < 0.1


def test_no_supported_feature_is_left_out():
    """Features that go with clean texts get weights too, below nothing."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("river", "stone", "cloud")) for _ in range(12)) + (" vile" if i % 3 == 0 else " gentle") for i in range(90)]
    columns, values = toxicity.packed(kernel.pa.array(texts))
    starts = np.concatenate(([0], np.cumsum(columns.value_lengths().to_numpy(), dtype=np.int64)))
    w, theta = toxicity.learnt(starts, columns.flatten().to_numpy(), values.flatten().to_numpy(), np.array([int(i % 3 == 0) for i in range(90)]))
    slab = next(kernel.slabs(kernel.pa.array(["vile", "gentle"])))
    rows, names, _ = toxicity.buckets_of(slab)
    assert (w[names[rows == 0]] > 0).all() and (w[names[rows == 1]] < 0).all()
    every = set(columns.flatten().to_numpy().tolist())
    assert {k for k in every if w[k] == 0} == set()


def test_toxicity_query(spark, folder):
    """Expected severity is the sum of the chances over the thresholds, the grade the number at or over a half."""
    out = QUERIES["op9_toxicity"](spark, folder).collect()
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    w, theta = toxicity.train(docs, marks, "toxic", "quality", toxicity.MOST_LABELLED)
    assert len(theta) == 2
    texts = {d: t for d, t, *_ in DATA}
    for r in out:
        slab = next(kernel.slabs(kernel.pa.array([texts[r["doc_id"]]], kernel.pa.string())))
        eta = sum(float(w[c]) * v for c, v in zip(*toxicity.buckets_of(slab)[1:], strict=True))
        chances = 1 / (1 + np.exp(theta - eta))
        assert r["expected_severity"] == pytest.approx(chances.sum(), abs=1e-6) and r["toxic_probability"] == pytest.approx(chances[0], abs=1e-6)
        assert r["toxic"] == (r["toxic_probability"] >= 0.5) and abs(chances - 0.5).min() < 1e-6 or r["severity"] == (chances >= 0.5).sum()


# Personal data ----------------------------------------------------------------------------------------------------


def plain_entities(text):
    spans = [(a, b, text[a:b], True, True) for found in cases.pii_spans(text).values() for a, b in found]
    spans += [(m.start(), m.end(), m[0], True, False) for m in re.finditer(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", text) if re.search("[A-Fa-f]", m[0]) and re.search("[0-9]", m[0])]
    spans += [(m.start(), m.end(), m[0], False, False) for m in re.finditer(r"[^ \t\n\x0b\f\r]{6,}", text) if "@" in m[0] or len(re.findall("[0-9]", m[0])) >= 3]
    out = []
    for a, b, v, seed, base in sorted(spans, key=lambda s: (s[0], s[1])):
        if out and a < out[-1]["end"]:
            out[-1] |= {"end": max(b, out[-1]["end"]), "seed": seed or out[-1]["seed"], "base": base or out[-1]["base"]}
        else:
            out.append({"start": a, "end": b, "first": v, "seed": seed, "base": base})
    return out


def plain_patterns(text):
    es = plain_entities(text)
    white = lambda s: re.sub(r"[\t\n\x0b\f\r]", " ", s)
    for i, e in enumerate(es):
        before = white(text[es[i - 1]["end"] if i else 0 : e["start"]])
        after = white(text[e["end"] : es[i + 1]["start"] if i + 1 < len(es) else len(text)])
        left = before[: len(before) - len(before.split(" ")[-1])].rstrip(" ").split(" ")[-1].lower()
        right = after[len(after.split(" ")[0]) :].lstrip(" ").split(" ")[0].lower()
        key = re.match(r"[\"'`(\[<]*([^\W\d]|[_-])+[=:]", e["first"])
        key = re.sub(r"^[\"'`(\[<]*", "", key[0]) if key else (re.search(r"(?<![^\W\d])(?<![_-])((?:[^\W\d]|[_-])+ *[=:]) *[\"'`(\[<]*$", before) or [None, ""])[1].replace(" ", "")
        yield e, {p + w for p, w in (("L ", left), ("R ", right), ("K ", key.lower())) if w}


def plain_found(texts, rounds=pii.ROUNDS):
    nodes = [(d, e, ps) for d, t in texts.items() for e, ps in plain_patterns(t or "")]
    uses = Counter()
    for t in texts.values():
        low = re.sub(r"[\t\n\x0b\f\r]", " ", t or "").lower()
        for w in filter(None, low.split(" ")):
            uses["L " + w] += 1
            uses["R " + w] += 1
        for m in re.finditer(r"(?<![^\W\d])(?<![_-])((?:[^\W\d]|[_-])+ *[=:])", low):
            uses["K " + m[1].replace(" ", "")] += 1
    value = lambda d, e: texts[d][e["start"] : e["end"]]
    told, seen = {}, None
    for _ in range(rounds):
        score = [1.0 if e["seed"] else told.get(i, 0.0) for i, (_, e, _) in enumerate(nodes)]
        total, number, sure = Counter(), Counter(), defaultdict(set)
        for i, (d, e, ps) in enumerate(nodes):
            for p in ps:
                total[p] += score[i]
                number[p] += 1
                if score[i] >= pii.CONFIDENT:
                    sure[p].add(value(d, e))
        conf = {p: min(0.999, total[p] / (total[p] + max(uses[p] - number[p], 0) + pii.UNKNOWN * (number[p] - total[p]) + pii.DOUBT)) for p in total}
        told = {i: 1 - np.prod([1 - conf[p] for p in ps if len(sure[p]) >= pii.MIN_SEEDS]) for i, (_, _, ps) in enumerate(nodes)}
        found = sum(v >= pii.CONFIDENT for v in told.values())
        if found == seen:
            break
        seen = found
    out = defaultdict(list)
    for i, v in told.items():
        d, e, _ = nodes[i]
        if v >= pii.CONFIDENT and not e["base"]:
            out[d].append((e["start"], e["end"]))
    return {d: sorted(v) for d, v in out.items()}


def chained_texts():
    """Mails give "mailto" away, its other words give "ref:" away, and those "badge"."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    texts, at = {}, 0
    for i in range(90):
        texts[(at := at + 1)] = f"{word()} mailto user{i}@mail.org {word()}"
    for i in range(30):
        texts[(at := at + 1)] = f"{word()} mailto ref:QX{100 + i}Z {word()}"
    for i in range(14):
        texts[(at := at + 1)] = f"{word()} badge ref:QW{200 + i}Z {word()}"
    for i in range(2):
        texts[(at := at + 1)] = f"{word()} badge YY-{300 + i}-T {word()}"
    for i in range(8):
        texts[(at := at + 1)] = f"{word()} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {word()}"
    texts[(at := at + 1)] = f'{word()} token = "hunter-{word()}-4711" {word()} and 12345678 {word()}'
    texts[(at := at + 1)] = f"commit {hashlib.sha1(b'c').hexdigest()} {word()} in 2024-10-11, see 555-1234"
    texts[(at := at + 1)] = None
    texts[(at := at + 1)] = "x" * 9000 + " badge " + "y" * 9000 + "123 badge ZZ-999-T" + " z" * 5000
    return texts


@pytest.mark.parametrize(("sent", "chars"), [(0, 64), (250_000, 64), (250_000, 3)])
def test_found_words_against_plain_python(spark, monkeypatch, sent, chars):
    """Whichever way words are counted, and whether patterns go by words or by digests of them."""
    monkeypatch.setattr(pii, "WORDS_SENT", sent)
    monkeypatch.setattr(pii, "WORD_CHARS", chars)
    texts = chained_texts()
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    want = plain_found(texts)
    assert {d: v for d, v in got.items() if v} == want
    picked = {texts[d][a:b] for d, v in want.items() for a, b in v}
    assert {"ref:QX100Z", "ref:QW200Z", "YY-300-T", "ZZ-999-T"} <= picked and any("hunter" in p for p in picked)
    assert not any(p.startswith(("555", "2024", hashlib.sha1(b"c").hexdigest())) for p in picked)
    one = plain_found(texts, rounds=1)
    assert "YY-300-T" not in {texts[d][a:b] for d, v in one.items() for a, b in v}


def test_pii_query(spark, folder, tmp_path):
    texts = chained_texts()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_found(texts)
    for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect():
        base = cases.pii_spans(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        found = [f"id:{a}:{b}" for a, b in want.get(r["doc_id"], [])]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and r["spans"] == ",".join(listed + found)
        assert (r["n_found"], r["n_spans"]) == (len(found), len(listed + found))


def test_recall_of_planted_kinds(spark):
    """Mails, addresses, cards, phones and keys in the driver's table: a plain look for each finds no document that is missed."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    look = r"[a-z]\.[0-9]{2}@mail[0-9]\.example\.com|token = \"[0-9a-f]{40}|\+1 \([0-9]{3}\) 555-[0-9]{4}"
    planted = {r["doc_id"] for r in docs.filter(F.lower("text").rlike(look)).collect()}
    caught = {r["doc_id"] for r in pii.find(docs, carry=["doc_id"]).filter(F.size(F.concat("email", "ip", "card", "phone")) + F.size("found") > 0).collect()}
    assert len(planted) > 200 and len(planted - caught) <= 0.01 * len(planted)


# Awkward rows and names -------------------------------------------------------------------------------------------

NAMES = "_ _id _h _p _rid _sub _place _start _n _part _parts _copies _copy _drop _text _kernel_text _m _c _group row rid sub place start n part parts th es id ids t s s2 k k1 k2 last gone batch host_key site key value pattern ids places items spans n_hit n_words label score size source_size target rate copies taken units lambda shard slot kept node bucket component member centre doc_score host_posterior path_posterior quality_score expected_severity severity toxic toxic_probability email ip card phone found text_kept n_lines n_dropped n_shingles component_id".split()


def awkward(spark, with_rows=True):
    """Null and repeated ids, null and empty texts, a long one, equal rows; a column for every working name."""
    rng = random.Random(1)
    body = [" ".join(rng.choice(("river", "stone", "cloud", "tree", "field")) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \n", *body, body[0], "call +1 (017) 555-7713 or a.b@c.de", "word " * 30_000]
    rows = [(k if k % 4 else None, t, rng.choice(["en", None]), rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [rows[0]] * 2 + [(5, "another text of the same id", "en", "a")]
    df = spark.createDataFrame(rows if with_rows else [], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    names = list(dict.fromkeys(NAMES))
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in names if c not in df.columns])


def operators(spark):
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing of this kind stands anywhere in any of the rows here"), (2, None)], "item_id long, text string")
    return {
        "sharding": (lambda d: sharding.shard(d, 3), {"shard", "slot"}),
        "linededup": (linededup.dedup_lines, {"text_kept", "n_lines", "n_dropped"}),
        "decontaminate_hits": (lambda d: decontaminate.hits(d, benchmark), {"n_words", "n_hit", "items", "spans"}),
        "decontaminate_blocks": (lambda d: decontaminate.hits(d, benchmark.union(benchmark.selectExpr("item_id + 9", "concat(text, ' too')")), block_bytes=40), {"n_words", "n_hit", "items", "spans"}),
        "decontaminate": (lambda d: decontaminate.decontaminate(d, benchmark), set()),
        "decontaminate_spans": (lambda d: decontaminate.decontaminate(d, benchmark, "spans"), set()),
        "neardup": (lambda d: neardup.near_duplicates(d, carry=True), {"n_shingles", "component_id", "kept"}),
        "mixing": (lambda d: mixing.with_copies(d.withColumn("size", F.size(F.split("text", " "))).drop("rate")), {"size", "source_size", "target", "rate", "copies", "taken"}),
        "quality": (lambda d: quality.quality_rules(d, labels), {*quality.COUNTS, "score", "base_failed", "kept"}),
        "classifier": (lambda d: classifier.classify(d, labels), set(classifier.NAMES)),
        "toxicity": (lambda d: toxicity.severity(d, labels), {"expected_severity", "severity", "toxic_probability", "toxic"}),
        "pii": (pii.find, {*pii.KINDS, "found"}),
    }


@pytest.mark.parametrize("name", ["sharding", "linededup", "decontaminate_hits", "decontaminate_blocks", "decontaminate", "decontaminate_spans", "neardup", "mixing", "quality", "classifier", "toxicity", "pii"])
def test_columns_pass_unchanged(spark, name):
    run, new = operators(spark)[name]
    docs = awkward(spark)
    out = run(docs)
    old = [c for c in docs.columns if c not in new]
    assert set(out.columns) == set(old) | new and len(out.columns) == len(set(out.columns))
    assert Counter(map(tuple, out.select(*old).collect())) == Counter(map(tuple, docs.select(*old).collect()))
    none = run(awkward(spark, with_rows=False))
    assert none.count() == 0 and set(none.columns) == set(out.columns)


def test_mixed_rows_pass_unchanged(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    assert mixing.mixed(awkward(spark, with_rows=False)).count() == 0


def test_pairs_keep_columns(spark):
    rows = spark.createDataFrame([(1, [("user", "x")], [("user", "x"), ("assistant", "y")], "p", "n")], f"conv_id long, chosen_turns {chat.TURNS}, rejected_turns {chat.TURNS}, _n string, n string")
    out = chat.preference_pairs(rows).first()
    assert (out["_n"], out["n"], out["n_prefix_turns"], out["rejected"]) == ("p", "n", 1, "<|assistant|>\ny<|end|>\n")
    blank = spark.createDataFrame([(1, None, None)], f"conv_id long, chosen_turns {chat.TURNS}, rejected_turns {chat.TURNS}")
    row = chat.preference_pairs(blank).first()
    assert (row["prompt"], row["chosen"], row["rejected"], row["n_prefix_turns"]) == ("", "", "", 0)


# Pipeline ---------------------------------------------------------------------------------------------------------


def written(spark, path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(benchmark, "item_id long, text string"))):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage on all that the one before kept: verdicts that the labels fix, components, windows, copies, shard sizes."""
    import corpus_pipeline

    docs, labels = labelled_corpus(spark)
    copies = docs.filter("doc_id % 4 <> 0").withColumn("doc_id", F.col("doc_id") + 1000)
    leak = docs.filter("doc_id = 1").first()["text"]
    path = written(spark, tmp_path, docs.union(copies), labels, [(1, leak)])
    at, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in at.collect()]
        at = stage(spark, at, path)
        assert k == 4 or at.columns == docs.columns
        got = Counter(r["doc_id"] for r in at.collect())
        if k == 0:
            assert set(got) == {r[0] for r in rows if r[0] % 4}
        elif k == 1:
            assert set(got) == {d for d, v in cases.components(rows, 5, 80).items() if v[2]}
        elif k == 2:
            assert set(got) == {d for d, v in cases.contamination(rows, [(1, leak)]).items() if not v[1]} and 1 not in got
        elif k == 3:
            want = plain_mix([(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))) for r in rows])[1]
            assert got == Counter({d: c for d, c in want.items() if c})
        else:
            assert got == Counter(r[0] for r in rows)
            sizes = Counter(r["shard"] for r in at.collect())
            assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
        kept.append(sum(got.values()))
    whole = corpus_pipeline.run(spark, path)
    assert whole.count() == kept[-1]


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Every stage takes null, empty, repeated and long rows and any name; what it keeps is as it came."""
    import corpus_pipeline

    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    path = written(spark, tmp_path, awkward(spark), labels, [(1, None)])
    at = spark.read.parquet(f"{path}/documents.parquet")
    rows, seen = Counter(map(tuple, at.collect())), []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, path)
        if name == "shard":
            assert set(at.columns) == {*before.columns, "shard", "slot"}
            break
        assert at.columns == before.columns and set(map(tuple, at.collect())) <= set(rows)
        seen.append(at.count())
    assert seen[0] == sum(rows.values()) and seen[2] == seen[1]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = written(spark, tmp_path, awkward(spark, with_rows=False), labels, [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_intermediate_tables_go(spark, tmp_path):
    """After a run only the last stage's table is left in the shared folder."""
    import corpus_pipeline

    from millrace.workspace import shared_root

    root = shared_root(spark).removeprefix("file://")
    docs, labels = labelled_corpus(spark)
    path = written(spark, tmp_path, docs, labels, [(1, "a b")])
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, path)
    left = [d for d in os.listdir(root) if d not in before]
    assert len(left) == 1 and left[0].startswith("stage-shard")
