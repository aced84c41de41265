import hashlib
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases  # noqa: E402

from millrace.llm import chat, classifier, decontaminate, kernel, labelled, linededup, mixing, neardup, pii, quality, sharding, skew, toxicity  # noqa: E402
from millrace.llm.components import connected_components  # noqa: E402

DATA = cases.rows()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, DATA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(0, 60)] + [(999, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


# Sharding ---------------------------------------------------------------------------------------------------------


def test_draws_of_large_counts_follow_the_law(monkeypatch):
    """Rare good balls: the law is as good as Poisson's, far from a normal one; below 10^9 it is numpy's."""
    rng = np.random.default_rng(5)
    seen = Counter(sharding.draw(rng, 1_000_000, 1_999_000_000, 2000) for _ in range(20_000))
    for k in range(6):
        want = np.exp(-1) / np.prod(np.arange(1, k + 1))
        assert abs(seen[k] / 20_000 - want) < 5 * np.sqrt(want / 20_000) + 0.001, k
    for good, bad, take in ((30, 50, 20), (5, 100, 60), (100, 5, 60), (1, 1, 1), (3000, 4000, 6900)):
        low, high = max(0, take - bad), min(good, take)
        ways = [math.comb(good, k) * math.comb(bad, take - k) for k in range(low, high + 1)]
        upto = [sum(ways[: i + 1]) / sum(ways) for i in range(len(ways))]
        for u in rng.random(200):
            assert sharding.inverted(u, good, bad, take) == low + int(np.searchsorted(upto, u, side="right"))
    big = [sharding.draw(rng, 3 * 10**11, 7 * 10**11, 10**10) for _ in range(300)]
    assert abs(np.mean(big) - 3e9) < 5 * 45_600 / 300**0.5 and 0.8 < np.std(big) / 45_600 < 1.2
    monkeypatch.setattr(sharding, "NUMPY_BALLS", 0)
    matrix = sharding.communication_matrix([400, 0, 77, 1000], sharding.shard_sizes(1477, 40), 3)
    assert matrix.sum(1).tolist() == [400, 0, 77, 1000] and matrix.sum(0).tolist() == sharding.shard_sizes(1477, 40)


def test_shards_have_exact_sizes_and_gapless_slots(spark):
    df = spark.range(0, 1003, 1, 7).withColumn("shard", F.lit("old"))
    out = sharding.shard(df, 8).collect()
    assert sorted(r["id"] for r in out) == list(range(1003))
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [125] * 5 + [126] * 3
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_is_repeatable_and_mixes(spark):
    df = spark.range(0, 4000, 1, 4)
    first, second = (sorted(map(tuple, sharding.shard(df, 4).collect())) for _ in range(2))
    assert first == second
    share = Counter(s for i, s, _ in first if i < 1000)
    assert all(180 < n < 320 for n in share.values())


def test_arrow_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(kernel.BATCH_SETTING)
    df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    try:
        spark.conf.set(kernel.BATCH_SETTING, "64m")
        sizes = kernel.map_texts(df, "rows long", lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())])
        assert spark.conf.get(kernel.BATCH_SETTING) == "64m"
        kernel.tuned(spark)
        assert sizes.agg(F.max("rows")).first()[0] * 10_000 < 2 * kernel.BATCH_BYTES
        spark.conf.set(kernel.BATCH_SETTING, "1m")
        kernel.tuned(spark)
        assert spark.conf.get(kernel.BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(kernel.BATCH_SETTING, before)


def morse(n):
    """Two strings of two letters each, complements, that agree under every polynomial hash modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_span_hashes_depend_on_all_bytes_and_on_nothing_else():
    rng = np.random.default_rng(3)
    blob = rng.integers(0, 3, 5000).astype(np.uint8)
    seen = {}
    for size in (0, 1, 7, 8, 9, 63, 64, 65, 511, 512, 513, 1024, 1025, 4000):
        found = set()
        for before in range(9):
            data = np.concatenate([rng.integers(0, 256, before).astype(np.uint8), blob[:size], rng.integers(0, 256, 5).astype(np.uint8)])
            twice = np.concatenate([data, data])
            starts = np.array([before, len(data) + before])
            found |= set(kernel.hash_spans(twice, starts, starts + size).tolist())
        assert len(found) == 1
        seen[size] = found.pop()
        for at in rng.integers(0, size, 5) if size else []:
            other = blob[:size].copy()
            other[at] ^= 1
            assert int(kernel.hash_spans(other, np.array([0]), np.array([size]))[0]) != seen[size]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_made_to_collide_stay_apart(spark, n):
    t, u = morse(n)
    data = [(i, t, *[None] * 6) for i in range(3)] + [(i, u, *[None] * 6) for i in (3, 4)]
    docs = cases.frame(spark, data)
    assert {r["n_dropped"] for r in linededup.dedup_lines(docs).collect()} == {0}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    counted = quality.quality_rules(cases.frame(spark, [(0, f"{t}\n{u}\n{t[:-1]}", *[None] * 6)]), spark.createDataFrame([], "doc_id long, quality int"))
    assert counted.first()["n_dup_lines"] == 0


def test_matrix_sums():
    m = sharding.communication_matrix([5, 0, 17, 1], sharding.shard_sizes(23, 6), 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 1] and m.sum(axis=0).tolist() == [4, 4, 4, 4, 4, 3]
    big = sharding.communication_matrix([3 * 10**9, 10**9], sharding.shard_sizes(4 * 10**9, 3), 3)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and big.min() >= 0


def test_shard_repeats_nulls_and_empty(spark, docs, empty):
    twice = docs.union(docs).union(cases.frame(spark, [(None,) * 8]))
    assert sharding.shard(twice, 3).count() == 2 * len(DATA) + 1
    assert sharding.shard(empty, 3).count() == 0


# Lines ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 5, 7])
def test_lines_against_plain_python(docs, parts):
    batches = [docs.filter(F.col("doc_id") % parts == k) for k in range(parts)]
    out = linededup.dedup_lines(docs, batches).select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == cases.lines_dropped(DATA)
    assert sum(r[2] for r in out) > 5


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_every_key_is_in_one_run(spark, fanout):
    rng = random.Random(fanout)
    batches = [[(rng.randrange(40), rng.randrange(2)) for _ in range(rng.randrange(60))] for _ in range(6)]
    store = linededup.LineRuns(spark, buckets=4, fanout=fanout)
    for rows in batches:
        store.add(spark.createDataFrame(rows, "k1 long, k2 long"))
    held = [tuple(r)[:2] for run in store.runs() for r in run.collect()]
    want = Counter(key for rows in batches for key in rows)
    assert len(held) == len(set(held)) and set(held) == set(want)
    assert {tuple(r) for r in store.shared(5).collect()} == {key for key, n in want.items() if n >= 5}
    plan = store.shared(5)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert all(len(level) < fanout for level in store.levels)
    store.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_lines_where_keys_travel(docs):
    """The road beyond the bound on sent keys gives the same."""
    out = linededup.dedup_lines(docs, keys_sent=0).select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == cases.lines_dropped(DATA)


def test_lines_count_documents_and_not_rows(spark):
    line = "a line that is quite long enough to be a key of its own"
    rows = [(1, line, *[None] * 6)] * 4 + [(2, line, *[None] * 6)] + [(None, line, *[None] * 6)] * 9
    assert {r["n_dropped"] for r in linededup.dedup_lines(cases.frame(spark, rows)).collect()} == {0}
    more = rows + [(k, line, *[None] * 6) for k in (3, 4, 5)]
    out = linededup.dedup_lines(cases.frame(spark, more)).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out) == [(0, 0)] * 9 + [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]


def test_lines_edges(spark, docs, empty):
    assert linededup.dedup_lines(empty).count() == 0
    odd = linededup.dedup_lines(cases.frame(spark, [(None, "x" * 50, *[None] * 6)] * 6)).collect()
    assert [r["n_dropped"] for r in odd] == [0] * 6
    same = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("old")))
    assert dict(same.dtypes)["n_lines"] == "bigint"


# Benchmark --------------------------------------------------------------------------------------------------------

ITEMS = [(1, " ".join((DATA[20][1] or "a b").split()[:14])), (2, "One"), (3, None), (4, "!!"), (5, (DATA[9][1])[1000:1300]), (11, "one TWO")]


@pytest.mark.parametrize(("block", "passes"), [(1 << 20, 4), (40, 10**6), (40, 1)])
def test_hits_against_plain_python(spark, docs, monkeypatch, block, passes):
    """One block, a pass for each of many, and windows that travel."""
    monkeypatch.setattr(decontaminate, "MOST_PASSES", passes)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.hits(docs, benchmark, block_bytes=block, carry=["doc_id", "text"]).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in out}
    assert got == cases.contamination(DATA, ITEMS)
    assert sum(v[1] > 0 for v in got.values()) > 4


def test_hits_of_several_blocks_keep_every_row(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    twice = docs.union(docs).withColumns({"items": F.lit("old"), "id": F.lit("own"), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    look = lambda b: [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["spans"], r["id"]) for r in decontaminate.hits(twice, benchmark, block_bytes=b).collect()]
    one, joined = look(1 << 20), look(40)
    monkeypatch.setattr(decontaminate, "MOST_PASSES", 10**6)
    many = look(40)
    key = lambda r: (r[0], r[1], r[2])
    assert len(many) == 2 * len(DATA) and sorted(one, key=key) == sorted(many, key=key) == sorted(joined, key=key)


def test_long_items_are_cut_with_overlap(spark, docs):
    """Pieces of seven words give the windows of the whole item; equal items, and ones without words, weigh nothing."""
    items = [(1, DATA[9][1]), (1, DATA[9][1]), (2, " !! "), (3, None), (4, "One")]
    rows = decontaminate.item_blocks(spark.createDataFrame(items, "item_id long, text string"), 10, 1 << 20, piece_words=7).numbered
    pieces = [r["t"].split(" ") for r in rows.filter("i = '1'").collect()]
    windows = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    whole = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", DATA[9][1].translate(cases.LOWER))
    assert set().union(*map(windows, pieces)) == windows(whole) and max(map(len, pieces)) == 16
    assert {r["i"] for r in rows.collect()} == {"1", "4"}


def test_windows_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    """Every window gets the same hash, so the words alone decide."""
    from millrace.llm import kernel

    monkeypatch.setattr(kernel, "ngram_hashes", lambda words, n: np.full(max(0, len(words) - n + 1), 5, np.uint64))
    index = decontaminate.build_index([("a", "x y z"), ("b", "y z w"), ("c", "Y z, w q"), ("d", "x y z")], 3)
    slab = next(kernel.slabs(pa.array(["z w q y z w", "x y z", "x y", "q x"])))
    n_words, n_hit, ids, spans = decontaminate.scan(slab, index)
    assert n_words.tolist() == [6, 3, 2, 2] and n_hit.tolist() == [6, 3, 0, 0]
    assert ids == {0: {"b", "c"}, 1: {"a", "d"}} and spans == {0: [(0, 11)], 1: [(0, 5)]}


def test_decontaminate_keeps_columns_and_clean_rows(spark, docs, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {d for d, v in cases.contamination(DATA, ITEMS).items() if not v[1]}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, "spans").collect()}
    assert cut[0] is None and cut[5] == "" and cut[12] is not None and len(cut) == len(DATA)
    texts = {d: t for d, t, *_ in DATA}
    assert all(cut[d] == texts[d] for d in want)
    assert decontaminate.hits(empty, benchmark).count() == 0
    assert decontaminate.hits(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


# Near duplicates --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (1, 60, 3), (3, 70, 4)])
def test_components_against_all_pairs(spark, n, percent, seed):
    data = cases.rows(seed, 90)
    out = neardup.near_duplicates(cases.frame(spark, data).repartition(4), n, percent).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == cases.components(data, n, percent)


def test_edited_copies_in_one_bucket(spark):
    """Copies of one text with edits of their own: many are linked only with some, and blocks must find what stars miss."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    data = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(60)] = f"e{rng.randrange(9)}"
        data.append((i, " ".join(words), *[None] * 6))
    want = cases.components(data, 3, 85)
    assert len({v[1] for v in want.values()}) > 3
    out = neardup.near_duplicates(cases.frame(spark, data), 3, 85).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == want


@pytest.mark.parametrize(("block", "shingles"), [(6, 10**6), (1024, 90)])
def test_block_grid_is_whole(spark, block, shingles):
    sets = spark.createDataFrame([(i, list(range(i, i + 30)), 30) for i in range(40)], "node long, shingles array<long>, n_set int")
    rows = spark.createDataFrame([(7, i, i, True, 40) for i in range(40)], "bucket long, node long, component long, outside boolean, size long")
    rows = rows.withColumn("part", skew.part(skew.parts(F.col("size"), 9), "node"))
    links = neardup.block_links(rows, sets, 85, 9, block=block, shingles=shingles)
    assert connected_components(links).select("component").distinct().count() == 1


def test_near_duplicate_edges(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    null_id = [(None, "a b c", *[None] * 6), (None, "a b c", *[None] * 6), (4, "a b c", *[None] * 6), (4, "d e f", *[None] * 6), (9, "d e f", *[None] * 6)]
    out = neardup.near_duplicates(cases.frame(spark, null_id), 3, 85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == [(-1, -1, True)] * 2 + [(4, 4, True)] * 2 + [(9, 4, False)]
    carried = neardup.near_duplicates(docs, 3, 85, carry=True)
    assert set(carried.columns) == {*docs.columns, "n_shingles", "component_id"} and carried.count() == len(DATA)


def test_large_buckets_are_split(spark, monkeypatch):
    """Parts of three rows: all joins by bucket and by centre meet split keys, and nothing changes."""
    monkeypatch.setattr(neardup, "most_rows", lambda total: 3)
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    monkeypatch.setattr(skew, "most_rows", lambda total, least=3: 3)
    data = cases.rows(2, 90)
    out = neardup.near_duplicates(cases.frame(spark, data).repartition(4), 3, 85).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == cases.components(data, 3, 85)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_joins(spark, how):
    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), i) for i in range(500)]
    small = [(0, "a"), (2, "c"), (9, "z")]
    a, b = spark.createDataFrame(rows, "k int, v int"), spark.createDataFrame(small, "k int, w string")
    got = Counter(map(tuple, skew.spread_join(a, b, ["k"], ["v"], 500, least=20, how=how).select("k", "v", "w").collect()))
    assert got == Counter(map(tuple, a.join(b, ["k"], how).select("k", "v", "w").collect()))


@pytest.mark.parametrize(("union", "percent"), [(20, 85), (40, 85), (100, 85), (400, 85), (2000, 85), (20, 80), (300, 80)])
def test_recall_of_bands_at_the_threshold(union, percent):
    """Pairs of random sets of just the similarity that links: short sets lean on densification most."""
    rng = np.random.default_rng(union + percent)
    bins = neardup.BANDS * neardup.rows_per_band(percent)
    ranks = neardup.donor_ranks(bins)
    shared = -(-percent * union // 100)
    missed = 0
    for _ in range(400):
        values = np.unique(kernel.mix(rng.integers(0, 1 << 62, union).astype(np.uint64)))
        own = (len(values) - shared) // 2
        sets = (values[rng.permutation(len(values))], )
        a, b = np.sort(sets[0][: shared + own]), np.sort(np.concatenate([sets[0][:shared], sets[0][shared + own :]]))
        bands = [neardup.band_hashes(neardup.signature(x, bins, ranks), neardup.BANDS) for x in (a, b)]
        missed += not np.intersect1d(*bands).size
    assert missed == 0


def test_band_rows_hold_the_miss_bound():
    assert all((1 - (p / 100) ** neardup.rows_per_band(p)) ** 32 <= 1e-6 for p in (80, 85, 90))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


# Chat -------------------------------------------------------------------------------------------------------------


def test_pairs_share_one_prompt(spark):
    turn = lambda r, t: {"role": r, "text": t}
    rows = [(1, [turn("user", "hé"), turn("assistant", "a"), turn("user", "q")], [turn("user", "hé"), turn("assistant", "b")]), (2, [turn("user", "x")], [turn("user", "x")]), (3, [], [turn("assistant", "z")])]
    df = spark.createDataFrame(rows, f"k int, chosen_turns {chat.TURNS}, rejected_turns {chat.TURNS}")
    out = {r["k"]: r for r in chat.preference_pairs(df).collect()}
    assert out[1]["prompt"] == "<|user|>\nhé<|end|>\n" and out[1]["n_prefix_turns"] == 1
    assert out[1]["chosen"] == "<|assistant|>\na<|end|>\n<|user|>\nq<|end|>\n"
    assert [out[1]["chosen"][s["start"] : s["end"]] for s in out[1]["chosen_mask"]] == ["a<|end|>\n"]
    assert (out[2]["chosen"], out[2]["rejected"], out[2]["chosen_mask"]) == ("", "", [])
    assert (out[3]["prompt"], out[3]["rejected"]) == ("", "<|assistant|>\nz<|end|>\n")


def test_swapped_answers_edges(spark):
    rows = [(2, 0, "user", "u"), (2, 1, "assistant", None), (2, 2, "user", "tail"), (3, 0, "assistant", "r"), (4, 0, "user", "x"), (None, 0, "user", "x"), (6, 0, "assistant", "alone"), (2, 1, "assistant", None)]
    out = {r["conv_id"]: r for r in chat.preference_pairs(chat.swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(out) == {2, 3}
    assert out[2]["rejected"] == "<|assistant|>\nr<|end|>\n" and out[2]["chosen"] == "<|assistant|>\n<|end|>\n"


# Mixing -----------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, most=3):
    """Reshare the excess by weight until none is above."""
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def plain_mix(data, most=3, group_rows=mixing.GROUP_ROWS):
    """Copies of (id, source, size) rows with distinct ids: lambda by bisection, then two passes over each group."""
    sizes, docs = Counter(), defaultdict(list)
    for d, s, n in data:
        sizes[s] += n or 0
        docs[s].append((d, n or 0))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill({s: sizes[s] for s in sizes}, {s: i % 3 + 1 for i, s in enumerate(order)}, most) if sum(sizes.values()) else {s: 0 for s in sizes}
    copies = {}
    for s, rows in docs.items():
        if sizes[s] == 0:
            copies |= {d: 0 for d, _ in rows}
            continue
        if target[s] >= most * sizes[s]:
            rate = lambda n: float(most)
        else:
            low, high = -60.0, 2.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(n * min(most, math.exp(mid * n)) for _, n in rows) < target[s] else (low, mid)
            rate = lambda n, t=(low + high) / 2: min(most, math.exp(t * n))
        groups = defaultdict(list)
        for d, n in rows:
            groups[int(hashlib.md5(f"{'' if d is None else d}:{n}".encode()).hexdigest()[:8], 16) % -(-len(rows) // group_rows)].append((d, n))
        for group in groups.values():
            group.sort(key=lambda x: (-x[1], x[0] is None, x[0]))
            owed, taken = 0, []
            for _, n in group:
                units = math.floor(rate(n) * mixing.UNIT + 0.5)
                whole, more = divmod(units, mixing.UNIT)
                c = whole + (more > 0 and 2 * (owed + more * n) >= mixing.UNIT * n)
                owed += units * n - c * mixing.UNIT * n
                taken.append(c)
            for i, (_, n) in enumerate(group):
                fit = int(math.copysign(abs(owed) // (mixing.UNIT * n), owed)) if n else 0
                change = max(-taken[i], min(most - taken[i], fit))
                owed -= change * mixing.UNIT * n
                taken[i] += change
            copies |= {d: c for (d, _), c in zip(group, taken, strict=True)}
    return target, copies


@pytest.mark.parametrize(("seed", "group_rows"), [(1, 1024), (2, 50), (3, 7)])
def test_mix_against_plain_python(spark, seed, group_rows):
    rng = random.Random(seed)
    data = [(i, rng.choice("abcdefg") if rng.random() < 0.9 else None, rng.choice([0, 1, 5, 40, 90, 900, None])) for i in range(400)] + [(900 + i, "big", 1 + i % 77) for i in range(800)] + [(3000, "void", 0)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long")
    out = mixing.with_copies(df, group_rows=group_rows).collect()
    target, copies = plain_mix(data, group_rows=group_rows)
    assert {r["doc_id"]: r["copies"] for r in out} == copies and len(out) == len(data)
    taken, sizes = Counter(), defaultdict(list)
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] == r["copies"] * (r["size"] or 0) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        sizes[r["source"]].append(r["size"] or 0)
    # Groups of seven rows leave more behind than ones of the size in use.
    assert group_rows < 50 or all(abs(taken[s] - target[s]) <= max(0.01 * target[s], np.median(sizes[s])) for s in sizes)
    again = mixing.with_copies(df.repartition(7), group_rows=group_rows).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mix_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    out = mixing.with_copies(docs.select("doc_id", "source", mixing.token_size(F.col("text")).alias("size")))
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.percentile("size", 0.5).alias("m")).collect():
        assert abs(r["t"] - r["w"]) <= max(0.01 * r["w"], r["m"])


def test_mix_of_one_id_repeated(spark):
    """Rows of one null id fall into one hash group, which is dealt again."""
    df = spark.range(0, 5000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.lit(7).cast("long").alias("size"))
    out = mixing.with_copies(df, group_rows=100).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in out) == [1000, 4000] and all(abs(r["t"] - r["w"]) <= 50 * 7 for r in out)


def test_mixed_repeats_rows_unchanged(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3
    want = plain_mix([(d, s, len((t or "").split())) for d, t, _, s, *_ in [(r[0], (r[1] or "").replace("\x0b", " "), r[2], r[3]) for r in DATA]])[1]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: c for d, c in want.items() if c})
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


# Quality, classifier, toxicity ------------------------------------------------------------------------------------


def test_base_counts_against_plain_python(docs, labels):
    out = quality.quality_rules(docs, labels, carry=["doc_id"]).collect()
    for r in out:
        assert tuple(r[c] for c in quality.COUNTS) == cases.counts(DATA[r["doc_id"]][1]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def labelled_corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    data, marks = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(80)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            text[7 : 7 + 1 + i % 3] = ["vilest" + rng.choice("abc") for _ in range(1 + i % 3)]
        data.append((i, " ".join(text) if good else " ".join(w.upper() + "!!" for w in text), "en", f"s{i % 3}", None, "s", "k", "z"))
        if i % 2 == 0 or i % 5 == 0:
            marks.append((i, int(good), int(toxic)))
    return cases.frame(spark, data), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_models_on_held_out_rows(spark):
    docs, labels = labelled_corpus(spark)
    for df in (quality.quality_rules(docs, labels), classifier.classify(docs, labels)):
        assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in df.collect())
    out = toxicity.severity(docs, labels).collect()
    wrong = [r["doc_id"] for r in out if r["toxic"] != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 4
    mean = lambda k: np.mean([r["expected_severity"] for r in out if r["doc_id"] % 5 == 0 and r["doc_id"] % 3 == k])
    assert mean(0) < mean(2)


@pytest.mark.parametrize("run", [quality.quality_rules, classifier.classify, toxicity.severity])
def test_models_edges(spark, docs, empty, labels, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(empty, labels).count() == 0
    assert run(docs, none).count() == len(DATA)
    twice = run(docs.union(docs).union(cases.frame(spark, [(None,) * 8])), labels)
    assert twice.count() == 2 * len(DATA) + 1 and "text" in twice.columns


def test_trusted_grams_are_of_all_labelled_texts(spark, monkeypatch):
    """More trusted rows than a model is fitted on, one of them in an alphabet of its own."""
    rng = random.Random(4)
    n = labelled.MOST_LABELLED + 400
    body = [" ".join(rng.choice(("river", "stone", "cloud", "tree")) for _ in range(8)) for _ in range(50)]
    docs = spark.createDataFrame([(i, body[i % 50]) for i in range(n)], "doc_id long, text string").repartition(8).cache()
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(n)], "doc_id long, quality int")
    seen = []
    count = quality.count_grams
    monkeypatch.setattr(quality, "count_grams", lambda df: seen.append(count(df)) or seen[-1])
    assert quality.quality_rules(docs, labels, carry=["doc_id"]).count() == n
    want = sum(len(body[i % 50]) - 3 for i in range(n) if i % 9)
    assert seen[0].sum() == want and seen[1].sum() == sum(len(body[i % 50]) - 3 for i in range(n))


def test_threshold_against_plain_numpy(spark):
    rng = np.random.default_rng(2)
    for n, bad, spread in ((2000, 700, 0.4), (1, 5, 1.0), (40, 0, 1.0), (0, 9, 1.0), (3000, 3000, 3.0), (999, 50, 0.01)):
        values = np.round(np.concatenate([rng.normal(1, spread, n), rng.normal(0, spread, bad)]), 3)
        good = np.arange(n + bad) < n
        held = spark.createDataFrame([(int(g), float(v)) for g, v in zip(good, values)], "label int, score double").repartition(5)
        for loss in (0.002, 0.05):
            assert quality.threshold(held, loss) == cases.best_cut(values, good, loss), (n, bad, loss)


def test_the_filter_of_ids_loses_none(spark):
    docs = spark.range(0, 50_000).select(F.col("id").alias("doc_id"))
    known = docs.filter("doc_id % 7 = 3")
    out = labelled.likely(docs, known)
    assert out.join(known, "doc_id", "left_semi").count() == known.count() and out.count() < known.count() + 50_000 / 15


def test_features_of_a_text_are_its_own():
    texts = ["", "a", "ab", "abc!", None, "one two three four", "é|é\n\nx", "", "ABC abc 12"]
    together = np.concatenate([classifier.features(slab) for slab in kernel.slabs(pa.array(texts))])
    alone = np.concatenate([classifier.features(slab) for t in texts for slab in kernel.slabs(pa.array([t], pa.string()))])
    assert np.array_equal(together, alone)


@pytest.mark.parametrize("run", [quality.quality_rules, classifier.classify, toxicity.severity])
def test_models_do_not_depend_on_the_order_of_rows(spark, run):
    docs, labels = labelled_corpus(spark)
    seen = [
        sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in run(d, labels, carry=["doc_id"]).collect())
        for d in (docs.orderBy("doc_id").coalesce(1), docs.repartition(7, F.xxhash64("doc_id")))
    ]
    assert seen[0] == seen[1]


def test_sparse_sites_shrink_to_the_prior(spark):
    docs, labels = labelled_corpus(spark)
    lone = docs.withColumn("source", F.when(F.col("doc_id") == 4, "lone").otherwise(F.col("source")))
    out = classifier.classify(lone, labels)
    low = out.filter("source = 'lone'").first()
    assert low["doc_score"] < 0.1 and low["host_posterior"] > low["doc_score"] + 0.05


# Personal data ----------------------------------------------------------------------------------------------------


def pii_texts():
    rng = random.Random(3)
    pieces = ["a.b@c.d", "x@y", "@z.com", "a@b.com.x_y@z.org", "é@ä.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5",
              "12", "+1 (555) 123-4567", "+49 30 1234", "+1234567890123456", "+1", "+1 +2 345 678 90", "--", "9" * 40, "0.0.0.0@1.2.3.4", "5500 0000 0000 0004+1 800 555 0199", "ß", "\n", "\t", "a" * 30]
    return [None, "", *["".join(rng.choice([*pieces, " ", " word "]) for _ in range(rng.randint(1, 12))) for _ in range(300)], "7" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1" + " " * 20_000, "x@y.z " * 300]


def test_base_spans_against_plain_python(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(df, carry=["doc_id"]).collect():
        got = {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.KINDS}
        assert got == cases.pii_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_contexts_give_unseen_identifiers_away(spark):
    rows = [(i, f"note mailto user{i}@mail.org done") for i in range(30)] + [(50, "note mailto user77(at)mail987.org done"), (51, "about 20240 things here12345"), (None, "mailto abc12345xyz now"), (None, None)]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is not None}
    assert [(s["start"], s["end"]) for s in out[50]["found"]] == [(12, 33)]
    assert not out[51]["found"] and not out[3]["found"] and len(out[3]["email"]) == 1
    assert pii.find(spark.createDataFrame([], "doc_id long, text string, found string")).count() == 0


def test_seeds_are_whole_entities(spark):
    """A phone or card with blanks gives the word before it, none from inside."""
    numbers = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 0091", "6011 0000 0000 0004"]
    cards = [n for n in numbers if cases.pii_spans(n)["card"]]
    assert len(cards) >= 3
    rows = [(i, f"please dial +1 (017) 555-77{i}3, and then wait") for i in range(10, 30)]
    rows += [(100 + i, f"pay with plastic tok:{c}, here {i}") for i, c in enumerate(cards * 3)]
    rows += [(200, "please dial QX-99812-B and see"), (201, "no plastic QX-99812-C but more"), (202, "what tok:QX99812D is"), (203, "see 555 QX-99812-E more")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = texts.select("doc_id", F.explode(pii.instances(F.col("text"), F.concat(*pii.base_spans(F.col("text")).values()))).alias("e")).select("doc_id", "e.*")
    got = {(r["doc_id"], r["value"]): (r["left"], r["right"], r["key"], r["seed"]) for r in found.collect()}
    assert got[10, "+1 (017) 555-77103"] == ("dial", "and", None, True)
    assert got[100, cards[0]] == ("plastic", "here", "tok:", True)
    assert not [k for k in got if k[1].startswith("555")]
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[200] == [(12, 22)] and found[201] == [(11, 21)] and found[202] == [(5, 17)] and found[203] == []
    assert not any(found[i] for i, _ in rows[:-4])
