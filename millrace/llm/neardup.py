"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Texts with equal shingle sets are one node from the start. A node's set is cut into bins by hash; each bin keeps its least
value, an empty bin borrows from the full bin that comes first in a random order of its own (optimal densification), and
runs of bins make the band hashes. In each bucket of nodes that share a band, candidates are a star around the node
with most bucket mates, so pairs grow with the bucket and not with its square. What the stars leave apart is settled
exactly: where a bucket still spans several components, the members outside its largest are compared in
bounded blocks, in memory, and only the links found come out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.components import connected_components
from millrace.llm.skew import in_parts, most_rows, part, parts, spread_join
from millrace.workspace import discard, materialise

BANDS = 32
#: The most that a linked pair may be missed by all bands.
MISS = 1e-6
#: Rows of each side of a block that one task compares in memory.
BLOCK = 512
#: Shingles (8 bytes each) of one side of a block, about; long texts make smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: Candidate ids (8 bytes each) up to which they are sent to the tasks that hold the texts; with more, texts travel to the ids.
IDS_SENT = 2_000_000
EMPTY = np.iinfo(K.U).max


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    """The longest band at which a pair of exactly ``percent`` similarity is missed with probability ``miss`` at most."""
    fit = [r for r in range(1, 13) if (1 - (percent / 100) ** r) ** bands <= miss]
    return max(fit, default=1)


def shingle_sets(slab: K.Slab, n: int):
    """Sorted distinct n-word shingle hashes of each text; fewer words make one shingle, none make none."""
    data = K.LOWER[slab.data]
    starts, ends, first = K.spans(data, slab.bounds, K.WHITE)
    words = K.hash_spans(data, starts, ends)
    shingles = K.ngram_hashes(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(shingles[a : b - n + 1])
        elif b > a:
            yield K.mix(K.ngram_hashes(words[a:b], b - a) + K.U(b - a))
        else:
            yield np.empty(0, K.U)


def donor_ranks(bins: int) -> np.ndarray:
    """For each bin an order of all bins; an empty bin takes the first full one of its order."""
    return np.random.default_rng(bins).permuted(np.tile(np.arange(bins, dtype=np.int32), (bins, 1)), axis=1)


def signature(shingles: np.ndarray, bins: int, ranks: np.ndarray) -> np.ndarray:
    where = ((shingles >> K.U(32)) * K.U(bins) >> K.U(32)).astype(np.int64)
    # Sorted hashes have sorted bins, so a bin's values lie together; they are mixed before the least is taken.
    out = np.full(bins, EMPTY, K.U)
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    out[where[edges]] = np.minimum.reduceat(K.mix(shingles ^ K.U(0x5851F42D4C957F2D)), edges)
    empty = np.flatnonzero(out == EMPTY)
    if len(empty):
        full = np.flatnonzero(out != EMPTY)
        out[empty] = out[full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(bands, -1)
    weights = K.mix(np.arange(1, parts.shape[1] + 1, dtype=K.U))
    return K.mix((parts * weights).sum(axis=1, dtype=K.U) ^ K.mix(np.arange(bands, dtype=K.U) + K.U(1 << 20)))


def sketch(texts, n: int, bins: int, bands: int) -> list[pa.Array]:
    ranks = donor_ranks(bins)
    sizes, s1, s2, banded = [], [], [], []
    for slab in K.slabs(texts):
        for shingles in shingle_sets(slab, n):
            sizes.append(len(shingles))
            s1.append(K.mix(shingles).sum(dtype=K.U))
            s2.append(K.mix(shingles ^ K.U(0x2545F4914F6CDD1D)).sum(dtype=K.U))
            banded.append(band_hashes(signature(shingles, bins, ranks), bands) if len(shingles) else np.zeros(0, K.U))
    flat = np.concatenate(banded) if banded else np.empty(0, K.U)
    ends = np.cumsum([0, *map(len, banded)]).astype(np.int32)
    longs = lambda x: pa.array(np.array(x, K.U).view(np.int64), pa.int64())
    return [pa.array(sizes, pa.int64()), longs(s1), longs(s2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))]


def sets_of(texts, n: int) -> list[pa.Array]:
    sets = [x for slab in K.slabs(texts) for x in shingle_sets(slab, n)]
    flat = np.concatenate(sets) if sets else np.empty(0, K.U)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))]


def linked(a, b, percent: int):
    inter = F.size(F.array_intersect(a, b)).cast("long")
    return F.lit(100) * inter >= F.lit(percent) * (F.size(a) + F.size(b) - inter)


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (centre, member) whose full sets are similar enough. A centre of many edges is split, its set copied."""
    with_member = edges.join(sets.select(F.col("node").alias("member"), F.col("shingles").alias("_m")), "member")
    degree = edges.groupBy("centre").agg(F.count("*").alias("n"))
    centres = degree.select("centre").join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("_c")), "centre")
    both = spread_join(with_member, centres, ["centre"], ["member"], edges.count(), degree)
    return both.filter(linked(F.col("_c"), F.col("_m"), percent)).select(F.col("centre").alias("a"), F.col("member").alias("b"))


def bucket_members(banded: DataFrame, sizes: DataFrame, total: int, most: int) -> DataFrame:
    """(bucket, part, node, n) of the buckets in ``sizes`` (bucket, n); those of more than ``most`` members are in parts."""
    # A node of several rows, one doc_id with several texts, counts once.
    members = spread_join(banded, sizes, ["bucket"], ["node"], total, sizes, most).dropDuplicates(["bucket", "node"])
    return members.withColumn("part", part(parts(F.col("n"), most), "node"))


def star_edges(members: DataFrame, most: int) -> DataFrame:
    """(centre, member) of each bucket, the centre being the node with most bucket mates over all its buckets."""
    mates = members.groupBy("node").agg(F.sum("n").alias("mates"))
    ranked = members.join(mates, "node")
    centres = ranked.groupBy("bucket").agg(F.max_by("node", F.struct(F.col("mates"), -F.col("node"))).alias("centre"), F.max("n").alias("n"))
    spread = in_parts(centres, F.col("n"), most).drop("n")
    pairs = members.join(spread, ["bucket", "part"]).filter("node <> centre")
    # One direction for each pair, whichever was the centre more often known: the least mate count varies by bucket.
    return pairs.select("centre", F.col("node").alias("member")).groupBy(F.least("centre", "member").alias("lo"), F.greatest("centre", "member").alias("hi")).agg(F.min("centre").alias("centre")).select(
        "centre", F.when(F.col("centre") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("member")
    )


def unresolved(members: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """Rows (bucket, part, node, component, outside) of buckets of three or more that span several components.

    ``outside``: not of the bucket's largest component. Every pair that isn't yet settled has such a member.
    Of buckets with the same members only one is kept.
    """
    labelled = members.filter("n >= 3").join(components, "node", "left").select("bucket", "part", "node", F.coalesce("component", "node").alias("component"))
    per = labelled.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"))
    top = per.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("m"), F.bit_xor("x").alias("x"))
    open_ = top.filter("k >= 2").groupBy("x", "m").agg(F.min_by(F.struct("bucket", "top"), F.col("bucket")).alias("b"), F.max("m").alias("size"))
    kept = in_parts(open_.select("b.bucket", "b.top", "size"), F.col("size"), most)
    return labelled.join(kept, ["bucket", "part"]).select("bucket", "part", "node", "component", (F.col("component") != F.col("top")).alias("outside"), "size")


def block_links(rows: DataFrame, sets: DataFrame, percent: int, most: int, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between outside members and members of other components, found in blocks of bounded size.

    A bucket of m members makes a grid of (m / block) squared cells, or more where its sets together hold more than
    ``shingles`` a line; a row is copied once for each cell of its line.
    """
    weights = rows.join(sets.select("node", "n_set"), "node").groupBy("bucket").agg(F.sum("n_set").alias("weight"), F.max("size").alias("size"))
    rows = rows.join(in_parts(weights, F.col("size"), most).drop("size"), ["bucket", "part"])
    side = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / shingles))
    own = F.pmod(F.xxhash64("node", F.lit(5)), side)
    line = F.sequence(F.lit(0).cast("long"), side - 1)
    cells = F.transform(line, lambda k: F.struct(own.alias("i"), k.alias("j"), F.lit(False).alias("query")))
    queries = F.when(F.col("outside"), F.transform(line, lambda k: F.struct(k.alias("i"), own.alias("j"), F.lit(True).alias("query")))).otherwise(F.slice(cells, 1, 0))
    dealt = rows.select("bucket", "node", "component", F.explode(F.concat(cells, queries)).alias("cell")).select("bucket", "node", "component", "cell.*")
    full = dealt.join(sets.select("node", "shingles"), "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        ask = frame["query"].to_numpy(bool)
        if ask.any() and not ask.all():
            found = compare_block(frame[ask], frame[~ask], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return full.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def compare_block(queries: pd.DataFrame, others: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """One link for each query and component that it reaches. Sets are coded once, then each query is one pass over all."""
    sets = [np.asarray(s) for s in others["shingles"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    component, node = others["component"].to_numpy(), others["node"].to_numpy()
    found = []
    for q, own, shingles in zip(queries["node"], queries["component"], queries["shingles"], strict=True):
        shingles = np.asarray(shingles)
        mark = np.zeros(len(vocabulary), np.int64)
        at = np.searchsorted(vocabulary, shingles)
        at[at == len(vocabulary)] = 0
        mark[at[vocabulary[at] == shingles]] = 1
        sums = np.concatenate(([0], np.cumsum(mark[codes])))
        inter = sums[starts[1:]] - sums[starts[:-1]]
        hit = (100 * inter >= percent * (sizes + len(shingles) - inter)) & (component != own)
        at = np.flatnonzero(hit)
        found += [(int(q), int(node[i])) for i in at[np.unique(component[at], return_index=True)[1]]]
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, carry: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; with ``carry`` all its other columns too.

    Words are runs of non-whitespace (ASCII), A-Z lower-cased. Texts are linked where ``percent`` of the union of their
    shingle sets is shared; component_id is the least doc_id reachable. A text without words, or null, is linked with
    nothing; a very long one is taken whole. Rows of one doc_id count as one document; a row without doc_id is left alone,
    with component_id null and kept true. An empty table gives an empty result. Columns of ``docs`` with the new names are
    replaced; with ``carry`` all others pass unchanged, whatever their names.
    """
    bins = bands * rows_per_band(percent, bands)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialise(K.map_texts(texts, "n_shingles long, s1 long, s2 long, bands array<long>", lambda t: sketch(t, shingle, bins, bands), carry=["doc_id"]), "sketch")

    usable = sketched.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = materialise(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    sizes = materialise(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n >= 2"), "bucket-sizes")
    total = nodes.count() * bands
    most = most_rows(total)
    members = materialise(bucket_members(banded, sizes, total, most), "buckets")

    wanted = materialise(members.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    again = texts.join(F.broadcast(wanted) if wanted.count() <= IDS_SENT else wanted, "doc_id", "left_semi")
    sets = materialise(K.map_texts(again, "shingles array<long>", lambda t: sets_of(t, shingle), carry=["doc_id"]).select(F.col("doc_id").alias("node"), "shingles", F.size("shingles").alias("n_set")), "sets")

    edges = materialise(star_edges(members, most), "star-edges")
    star = materialise(confirm(edges, sets, percent), "star-links")
    first = connected_components(star)
    rest = materialise(block_links(materialise(unresolved(members, first, most), "unresolved"), sets, percent, most), "block-links")
    discard(sets, members, wanted, sizes, edges)
    shared = usable.select("doc_id", "s1", "s2").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    # Rows of one doc_id with different texts tie their nodes together.
    ties = shared.filter("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a <> b").select("a", "b")
    components = connected_components(star.unionByName(rest).unionByName(ties))

    least = nodes.join(components, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    labelled = sketched.select("doc_id", "n_shingles", "s1", "s2").join(least, ["s1", "s2"], "left")
    result = labelled.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    result = result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    result = materialise(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull())), "near-duplicates")
    discard(sketched, nodes, star, rest)
    if not carry:
        return result.select("doc_id", "n_shingles", "component_id", "kept")
    names = K.others(docs, ("n_shingles", "component_id", "kept"))
    per_id = result.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.bool_and("kept").alias("kept"))
    rows = docs.select(K.boxed(names), F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(per_id.hint("shuffle_hash"), "doc_id", "left")
    return joined.select(*K.unboxed(names), "n_shingles", "component_id", F.coalesce("kept", F.lit(True)).alias("kept"))
