"""Mixing sources to target weights by entropy balancing.

Rates r of the documents minimise sum(r log r - r) under one token constraint a source, sum(size * r) = target, with
rates of ``most`` at most. The dual is convex with one number lambda a source, and its solution tilts each document
by its own size: r = min(most, exp(lambda * size)). Newton steps run over the documents, all sources at once: gradient and
Hessian are grouped sums. Rates become whole copies, of which each is a neighbour of its rate but for a few that
settle what rounding left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import kernel as K
from millrace.llm.skew import spread_join
from millrace.workspace import discard, materialise

MOST_COPIES = 3
#: Newton ends where every source's tokens are met to this share; steps that leave the bracket halve it, so it does end.
TOLERANCE = 1e-12
NEWTON_STEPS = 200
#: Rows of one rounding group, about; sorted and rounded within one row of arrays.
GROUP_ROWS = 1024
#: Rates are rounded to whole millionths, so that sums along a group are exact.
UNIT = 1_000_000
NEW = ("source_size", "target", "rate", "copies", "taken")


def token_size(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def source_weights(sources: DataFrame) -> DataFrame:
    """1, 2, 3, repeating, over sources by code point, null last. The table has one row a source."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))


def with_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Adds target: weight's share of all tokens, stopped at ``most`` times the source, the excess reshared by weight.

    That is target = min(cap, level * weight) with one level for all: along sources sorted by cap / weight, it is the
    level left by the capped ones before the first source that it doesn't cap.
    """
    cap = F.lit(most) * F.col("source_size")
    ratio = cap / F.col("weight")
    # Windows over the table of sources, one row each.
    order = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    t = sources.withColumns({"_cap": cap, "_ratio": ratio})
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("_level", left / share)
    open_ = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("_null"), "source", "_level"))
    t = t.withColumn("_level", F.min(open_).over(whole)["_level"])
    return t.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))).drop("_cap", "_ratio", "_level")


def solved(histogram: DataFrame, plan: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(s, lambda) of the sources whose target lies strictly between 0 and their cap.

    ``histogram`` (s, size, n) holds the documents of a source by size, so a step sums over all documents. A step is
    Newton's on the logarithm of the sum, which is nearly straight; it stays between the bounds known so far.
    """
    spans = histogram.filter("size > 0").groupBy("s").agg(F.min("size").alias("least"))
    # At log(most) / least every document is at its bound; below 0 there is no such end, so the lower one moves down.
    state = plan.filter((F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))).join(spans, "s")
    state = state.select("s", "target", F.lit(0.0).alias("l"), F.lit(float("-inf")).alias("low"), (F.log(F.lit(float(most))) / F.col("least")).alias("high"), F.lit(False).alias("done"))
    state = materialise(state, "mix-lambda")
    for _ in range(NEWTON_STEPS):
        tilted = F.exp(F.col("l") * F.col("size"))
        mass = F.col("n") * F.col("size") * F.least(F.lit(float(most)), tilted)
        slope = F.when(tilted < most, F.col("n") * F.col("size") * F.col("size") * tilted).otherwise(0.0)
        sums = histogram.join(state.select("s", "l"), "s").groupBy("s").agg(F.sum(mass).alias("f"), F.sum(slope).alias("g"))
        now = state.join(sums, "s")
        gap = F.log("f") - F.log("target")
        now = now.withColumn("done", F.col("done") | (F.abs(gap) <= TOLERANCE))
        now = now.withColumns({"low": F.when(gap < 0, F.col("l")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("l")).otherwise(F.col("high"))})
        newton = F.col("l") - gap * F.col("f") / F.col("g")
        inside = (F.col("g") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        now = now.withColumn("next", F.when(F.col("done"), F.col("l")).when(inside, newton).otherwise(middle))
        # Where doubles run out between the bounds, no step is left.
        ended = F.col("done") | (F.col("next") == F.col("l"))
        after = materialise(now.select("s", "target", F.col("next").alias("l"), "low", "high", ended.alias("done")), "mix-lambda")
        discard(state)
        state = after
        if state.filter("NOT done").isEmpty():
            return state.select("s", F.col("l").alias("lambda"))
    raise RuntimeError("rates did not settle")


def rounded(rows: Column, most: int) -> Column:
    """Copies, in order, of a group's rows: an array of structs with size and whole rate units.

    Along the rows, largest first, what was wanted and not yet taken decides whether a rate goes up or down to its
    neighbour. What is then left is settled in a second pass: every row takes, or gives back, as many copies as
    fit, between 0 and ``most``.
    """
    unit = F.lit(UNIT).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("owed"), F.array().cast("array<long>").alias("c"))

    def near(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + x["units"] * x["size"]
        floor = F.floor(x["units"] / unit)
        spare = owed - floor * unit * x["size"]
        up = (x["units"] > floor * unit) & (2 * spare >= unit * x["size"])
        c = floor + F.when(up, 1).otherwise(0)
        return F.struct((owed - c * unit * x["size"]).alias("owed"), F.array_append(acc["c"], c).alias("c"))

    first = F.aggregate(rows, start, near)

    def settled(acc: Column, pair: Column) -> Column:
        size, c = pair["size"], pair["c"]
        # Towards zero, in whole numbers.
        fit = F.when(size == 0, zero).otherwise(F.signum(acc["owed"]).cast("long") * F.floor(F.abs(acc["owed"]) / (unit * size)))
        change = F.greatest(-c, F.least(F.lit(most) - c, fit))
        return F.struct((acc["owed"] - change * unit * size).alias("owed"), F.array_append(acc["c"], c + change).alias("c"))

    pairs = lambda a: F.zip_with(rows, a["c"], lambda x, c: F.struct(x["size"].alias("size"), c.alias("c")))
    second = lambda a: F.aggregate(pairs(a), F.struct(a["owed"].alias("owed"), F.array().cast("array<long>").alias("c")), settled, lambda acc: acc["c"])
    return F.transform(F.array(first), second)[0]


def with_copies(sized: DataFrame, most: int = MOST_COPIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(…, doc_id, source, size) with source_size, target, rate, copies and taken. Same rows in, same copies out.

    Every row counts, repeated ones each for itself. A row of size 0 or null has rate 1 and takes no words; a source
    without words has rate 0. Null is a source of its own, the last; null ids are fine. An empty table gives an empty
    result. Columns of the new names are replaced; all others pass unchanged, whatever their names.

    Within a source, rows are dealt into groups by a hash of id and size and rounded there, largest first; a group that
    repeated rows swell is dealt again by row.
    """
    names = K.others(sized, NEW)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    rows = sized.select(K.boxed(names), key.alias("s"), F.col("source"), F.col("doc_id").alias("id"), size.alias("size"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "mix-sizes")
    histogram = materialise(rows.groupBy("s", "source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = histogram.groupBy("s", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    targets = materialise(with_targets(source_weights(sources), most), "mix-plan")
    lambdas = solved(histogram.select("s", "size", "n"), targets, most)
    fixed = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most))
    plan = materialise(targets.join(lambdas, "s", "left").select("s", "source_size", "target", "lambda", fixed.alias("fixed"), F.ceil(F.col("n_rows") / group_rows).alias("groups"), "n_rows"), "mix-rates")
    total = rows.count()
    joined = spread_join(rows.drop("source"), plan.drop("n_rows"), ["s"], ["rid"], total, plan.select("s", F.col("n_rows").alias("n")))
    rate = F.coalesce(F.col("fixed"), F.least(F.lit(float(most)), F.exp(F.col("lambda") * F.col("size"))))
    told = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    hashed = F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long")
    rated = joined.select("row", "s", "id", "size", "rid", "source_size", "target", rate.alias("rate"), F.pmod(hashed, F.col("groups")).alias("g"))
    rated = materialise(rated, "mix-rated")
    discard(rows, histogram, targets, plan)
    full = rated.groupBy("s", "g").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * group_rows)
    again = full.select("s", "g", F.ceil(F.col("n") / group_rows).alias("subs"))
    dealt = spread_join(rated, again, ["s", "g"], ["rid"], total, how="left")
    dealt = dealt.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("subs")), F.lit(0).cast("long")))
    order = (-F.col("size")).alias("o"), F.col("id").isNull().alias("none"), "id", "rid"
    units = F.round(F.col("rate") * UNIT).cast("long")
    one = F.struct(*order, "size", units.alias("units"), F.struct("row", "source_size", "target", "rate").alias("kept"))
    grouped = dealt.groupBy("s", "g", "sub").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    copies = grouped.select("rows", rounded(F.transform("rows", lambda x: F.struct(x["size"].alias("size"), x["units"].alias("units"))), most).alias("c"))
    each = copies.select(F.explode(F.arrays_zip("rows", "c")).alias("z")).select("z.rows.kept.*", F.col("z.rows.size").alias("words"), F.col("z.c").alias("copies"))
    return each.select(*K.unboxed(names), "source_size", "target", "rate", "copies", (F.col("copies") * F.col("words")).alias("taken"))


def mixed(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` in the mix: each row as many times as its copies say, columns unchanged.

    Null and empty texts have no words, are neutral to the sums and stay once; very long texts are counted whole. A source
    without words gives nothing. Null is a source of its own, the last; null, tied or repeated ids are fine, and repeated
    rows are copied each for itself. An empty table gives an empty mix. No column's name gets in the way.
    """
    rows = docs.select(K.boxed(docs.columns), F.col("doc_id"), F.col("source"), F.col("text"), F.monotonically_increasing_id().alias("rid"))
    staged = materialise(rows.select("row", "doc_id", "source", token_size(F.col("text")).alias("size"), "rid"), "mix-rows")
    copies = with_copies(staged.select("doc_id", "source", "size", "rid"), most).filter("copies > 0").select("rid", "copies")
    repeated = staged.select("row", "rid").join(copies.hint("shuffle_hash"), "rid")
    return repeated.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*K.unboxed(docs.columns))
