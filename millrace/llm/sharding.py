"""Uniform shuffle into shards of exact sizes.

1. The rows of each input partition get their place in it.
2. The driver draws, from the partitions' counts alone, how many rows of each go to each shard: a multivariate
   hypergeometric matrix whose row sums are the partitions' counts and whose column sums are the shard sizes.
3. Each partition deals its rows by a random permutation of those labels, rows travel once, and each shard permutes again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import kernel as K
from millrace.workspace import materialise

#: Entries of the matrix that the driver draws and broadcasts (8 bytes each). More partitions are coalesced to fit.
MAX_ENTRIES = 1 << 22
#: Rows that one task permutes in the second pass.
ROWS_PER_SORT = 2_000
PLACE_BITS = 33
#: Numpy's hypergeometric draw takes fewer balls than this.
NUMPY_BALLS = 1_000_000_000


def draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """A hypergeometric count. Beyond numpy's range the law is inverted."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    if good + bad < NUMPY_BALLS:
        return int(rng.hypergeometric(good, bad, take))
    return inverted(rng.random(), good, bad, take)


def inverted(u: float, good: int, bad: int, take: int) -> int:
    """The count at which the hypergeometric law passes ``u``.

    Weights come from the ratios of neighbouring counts, outwards from the mode, so no factorial of a large number loses
    figures. They end where what is left is less than a double of ``u`` can tell.
    """
    low, high = max(0, take - bad), min(good, take)
    mode = min(high, max(low, (good + 1) * (take + 1) // (good + bad + 2)))
    up = outward(mode, high, lambda k: (good - k) / (k + 1) * ((take - k) / (bad - take + k + 1)))
    down = outward(mode, low, lambda k: k / (good - k + 1) * ((bad - take + k) / (take - k + 1)))
    upto = np.cumsum(np.concatenate((down[::-1], [1.0], up)))
    return mode - len(down) + min(int(np.searchsorted(upto, u * upto[-1], side="right")), len(upto) - 1)


def outward(mode: int, end: int, ratio) -> np.ndarray:
    """Weights of the counts beyond ``mode`` as far as ``end``, that of ``mode`` being 1; ``ratio`` leads from each to the next."""
    step, parts, last, k = (1 if end > mode else -1), [], 1.0, mode
    # The ratios fall, so all that follow weigh less than a geometric series.
    while k != end and (not parts or last * ratio(k) / max(1 - ratio(k), 1e-300) > 1e-18):
        n = min(abs(end - k), 256 * 2 ** min(len(parts), 12))
        parts.append(last * np.cumprod(ratio(k + step * np.arange(n, dtype=np.float64))))
        last, k = float(parts[-1][-1]), k + step * n
    return np.concatenate(parts) if parts else np.empty(0)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows: partitions, columns: shards. Sums are exact in both directions."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for i, count in enumerate(counts):
        need, rest = count, sum(left)
        for j in range(len(left)):
            rest -= left[j]
            out[i, j] = draw(rng, left[j], rest, need)
            need -= out[i, j]
        for j in range(len(left)):
            left[j] -= int(out[i, j])
    return out


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def shard(df: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard); row counts of shards differ by one at most.

    Every row counts, repeated rows and rows of nulls, empty or very long texts included; an empty table gives an empty
    result. Which of equal rows goes where is as random as for others. A shard or slot column of ``df`` is replaced; all
    others pass unchanged, whatever their names. Rows are written once to the shared folder, so that a lost executor
    can't change what the counts were drawn for.
    """
    names = K.others(df, ("shard", "slot"))
    rows = df.select(K.boxed(names)).coalesce(max(1, MAX_ENTRIES // shards))
    staged = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("rid", PLACE_BITS)
    counted = staged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row a partition
    index = {row["p"]: i for i, row in enumerate(counted)}
    total = sum(row["n"] for row in counted)
    matrix = communication_matrix([row["n"] for row in counted], shard_sizes(total, shards), seed)
    shared = staged.sparkSession.sparkContext.broadcast((index, matrix))

    @F.pandas_udf("int")
    def deal(rid: pd.Series) -> pd.Series:
        index, matrix = shared.value
        ids = rid.to_numpy()
        parts, places = ids >> PLACE_BITS, ids & ((1 << PLACE_BITS) - 1)
        out = np.empty(len(ids), np.int32)
        for p in np.unique(parts):
            here = parts == p
            out[here] = labels(seed, int(p), index, matrix)[places[here]]
        return pd.Series(out)

    dealt = staged.withColumn("shard", deal("rid"))
    parts = max(1, -(-total // (shards * ROWS_PER_SORT)))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.lit(parts)))
    sizes = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "sub").orderBy(F.xxhash64(F.lit(seed + 1), F.col("rid")), "rid")
    placed = dealt.withColumn("place", F.row_number().over(order) - 1).join(starts, ["shard", "sub"])
    return placed.select(*K.unboxed(names), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


_kept: dict = {}


def labels(seed: int, part: int, index: dict[int, int], matrix: np.ndarray) -> np.ndarray:
    """The shard of each place of one partition; the last partition's are kept between batches."""
    row = matrix[index[part]]
    key = (seed, part, row.tobytes())
    if _kept.get("key") != key:
        rng = np.random.default_rng([seed, part])
        _kept.update(key=key, labels=rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row)))
    return _kept["labels"]
