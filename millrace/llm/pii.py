"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped context.

Entities of the fixed kinds, blanks in them included, and long hexadecimal keys are seeds. The words around them, and a
key before ``=`` or ``:``, are lexical patterns. Patterns are scored by how much of what they stand beside, over the whole
corpus, is an identifier, and other identifier-like words by their patterns. Words that reach a high score seed the next
round, with patterns of their own, and become spans of kind ``id``; so do keys that their contexts confirm. All of it is
DataFrame work: what is joined is small against the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.skew import spread_join
from millrace.workspace import discard, materialise

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
LOCAL = "A-Za-z0-9._%+-"
#: Leftmost non-overlapping matches in linear time: a match may begin at the last one's end or where its first run of
#: characters begins, and runs aren't given back.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators; runs of fewer than 16 or more than 19 digits can't pass, so they aren't matched.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WHITE = r" \x09-\x0D"
#: A whole word that looks like an identifier: three digits or an @ in six characters or more.
WORD = rf"(?<![^{WHITE}])(?=[^{WHITE}]{{6}})(?=[^{WHITE}@]*+@|[^{WHITE}0-9]*+[0-9](?:[^{WHITE}0-9]*+[0-9]){{2}})[^{WHITE}]++"
#: A seed besides the fixed kinds: a run of so many hexadecimal digits, letters and figures among them, as keys have.
SECRET_CHARS = 32
SECRET = rf"(?<![0-9A-Za-z])[0-9A-Fa-f]{{{SECRET_CHARS},}}+(?![0-9A-Za-z])"
#: A key with its sign: right before an entity, at an entity's own beginning, and anywhere.
KEY_BEFORE = r"(?<![\p{L}_-])([\p{L}_-]++ *+[=:]) *+[\"'`(\[<]*+$"
KEY_INSIDE = r"^[\"'`(\[<]*+([\p{L}_-]++[=:])"
KEY_USE = r"(?<![\p{L}_-])([\p{L}_-]++ *+[=:])"
#: Words of patterns up to which they are sent to the texts, so that other words aren't counted; with more, all are.
WORDS_SENT = 250_000
#: Code points of a pattern's word; a longer word goes by its SHA-256, so that what is sent has a bound in bytes too.
WORD_CHARS = 64
#: Code points of a piece; contexts are taken from pieces, so that a very long text isn't scanned for each entity.
PIECE = 4096
PATTERNS = (("left", "L "), ("right", "R "), ("key", "K "))
SPAN = "array<struct<start: long, end: long, value: string>>"
MIN_SEEDS = 3
ROUNDS = 8
CONFIDENT = 0.8
#: Unseen other uses that every pattern is charged with.
DOUBT = 1.0
#: What an identifier-like word of no score counts against a pattern; any other word beside it counts 1.
UNKNOWN = 0.25


def located(text: Column, pattern: str) -> Column:
    """Matches with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    pairs = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.get(gaps, i)).alias("before")))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["before"]
        end = begin + F.length(p["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["spans"]))


def blanked(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def last_word(text: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(blanked(text)), " ", -1))


def first_word(text: Column) -> Column:
    return F.lower(F.substring_index(F.ltrim(blanked(text)), " ", 1))


def named_by(word: Column) -> Column:
    """A word as patterns name it: itself, or its digest where it is long."""
    return F.when(F.length(word) > WORD_CHARS, F.sha2(word, 256)).otherwise(word)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def parts_fit(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    size = lambda v: F.length(digits(v))
    holds = lambda mark, spans: F.when(mark, spans).otherwise(F.array().cast(SPAN))
    return {
        "email": holds(F.contains(text, F.lit("@")), located(text, EMAIL)),
        "ip": holds(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda s: parts_fit(s["value"]))),
        "card": holds(text.rlike("[0-9][ -]?[0-9]"), F.filter(located(text, CARD), lambda s: luhn(s["value"]))),
        "phone": holds(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda s: size(s["value"]).between(8, 15))),
    }


def entities(words: Column, base: Column, secrets: Column) -> Column:
    """Base spans, secrets and identifier-like words in order, those that overlap as one: start, end, value, first, seed, base.

    ``base``: a base span is in it; ``seed``: a base span or a secret is; ``value`` is then that one's. ``first`` is what
    it begins with.
    """
    fields = "start: long, end: long, value: string, first: string, seed: boolean, base: boolean"

    def tagged(spans: Column, seed: bool, kind: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["value"].alias("first"), F.lit(seed).alias("seed"), F.lit(kind).alias("base")))

    start = F.struct(F.lit(None).cast(f"struct<{fields}>").alias("open"), F.array().cast(f"array<struct<{fields}>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["open"]
        surer = (x["base"] & ~last["base"]) | (x["seed"] & ~last["seed"])
        value = F.when(surer, x["value"]).otherwise(last["value"])
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), value.alias("value"), last["first"].alias("first"), (last["seed"] | x["seed"]).alias("seed"), (last["base"] | x["base"]).alias("base"))
        meets = F.coalesce(x["start"] < last["end"], F.lit(False))
        done = F.when(meets | last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last))
        return F.struct(F.when(meets, both).otherwise(x).cast(f"struct<{fields}>").alias("open"), done.alias("done"))

    every = F.array_sort(F.concat(tagged(base, True, True), tagged(secrets, True, False), tagged(words, False, False)))
    return F.aggregate(every, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def instances(text: Column, base: Column) -> Column:
    """Entities of a text with their contexts: array of (start, end, value, left, right, key, seed).

    Left and right are the next whole words outside, the rest of a word that a span begins or ends in left out; there is
    none where the next entity comes first. Key is a word before ``=`` or ``:``, blanks and an opening quote aside.
    """
    words = F.when(text.rlike(r"[0-9@]"), located(text, WORD)).otherwise(F.array().cast(SPAN))
    secrets = F.filter(F.when(text.rlike(f"[0-9A-Fa-f]{{{SECRET_CHARS}}}"), located(text, SECRET)).otherwise(F.array().cast(SPAN)), lambda s: s["value"].rlike("[A-Fa-f]") & s["value"].rlike("[0-9]"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        i = F.floor(a / PIECE)
        near = F.array_join(F.slice(chunks, (i + 1).cast("int"), (F.floor(b / PIECE) - i + 1).cast("int")), "")
        return blanked(near.substr((a - i * PIECE + 1).cast("int"), (b - a).cast("int")))

    def contexts(both: Column) -> Column:
        es, chunks = both["es"], both["chunks"]

        def beside(e: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(es, i - 1)["end"])
            finish = F.when(i == F.size(es) - 1, F.length(text).cast("long")).otherwise(F.get(es, i + 1)["start"])
            return F.struct(*[e[c].alias(c) for c in ("start", "end", "value", "first", "seed", "base")], between(chunks, begin, e["start"]).alias("before"), between(chunks, e["end"], finish).alias("after"))

        def named(e: Column) -> Column:
            before, after = e["before"], e["after"]
            head, tail = F.substring_index(before, " ", -1), F.substring_index(after, " ", 1)
            left = last_word(before.substr(F.lit(1), F.length(before) - F.length(head)))
            right = first_word(after.substr(F.length(tail) + 1, F.length(after)))
            inside = F.regexp_extract(e["first"], KEY_INSIDE, 1)
            key = F.lower(F.translate(F.when(inside != "", inside).otherwise(F.regexp_extract(before, KEY_BEFORE, 1)), " ", ""))
            return F.struct(*[e[c].alias(c) for c in ("start", "end", "value")], named_by(left).alias("left"), named_by(right).alias("right"), named_by(F.nullif(key, F.lit(""))).alias("key"), e["seed"].alias("seed"), e["base"].alias("base"))

        return F.transform(F.transform(es, beside), named)

    both = F.transform(F.array(entities(words, base, secrets)), lambda es: F.struct(es.alias("es"), F.when(F.size(es) > 0, pieces).alias("chunks")))
    return F.transform(both, contexts)[0]


def pattern_rows(found: DataFrame) -> DataFrame:
    """One row for each instance and pattern beside it, of rows (doc_id, th, e)."""
    one = F.col("e")
    patterns = F.array(*[F.when(F.coalesce(one[c], F.lit("")) != "", F.concat(F.lit(p), one[c])) for c, p in PATTERNS])
    return found.select("doc_id", "th", *[one[c].alias(c) for c in ("start", "end", "value", "seed", "base")], F.explode(F.array_compact(patterns)).alias("pattern"))


def word_uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, uses): how often the pattern's word or key stands anywhere in the corpus; one pass over the texts."""
    text = F.lower(blanked(F.col("text")))
    words = F.split(text, " ")
    # A blank before a key tells it from words.
    found = F.when(text.rlike("[=:]"), F.regexp_extract_all(text, F.lit(KEY_USE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(found, lambda k: F.concat(F.lit(" "), named_by(F.translate(k, " ", ""))))
    wanted = patterns.select("pattern", F.when(F.col("pattern").startswith("K "), F.expr("substring(pattern, 2)")).otherwise(F.expr("substring(pattern, 3)")).alias("w"))
    said = docs.select(F.explode(F.concat(words, keys)).alias("w"))
    said = said.select(F.when(F.col("w").startswith(" "), F.col("w")).otherwise(named_by(F.col("w"))).alias("w"))
    asked = wanted.select("w").distinct()
    if asked.count() <= WORDS_SENT:
        said = said.join(F.broadcast(asked), "w", "left_semi")
    # Uses combine within each task before they travel.
    counted = said.filter("w <> ''").groupBy("w").agg(F.count("*").alias("uses"))
    return wanted.join(counted, "w").select("pattern", "uses")


def bootstrapped(docs: DataFrame, marked: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, start, end) of entities that reach CONFIDENT by their patterns and hold no base span.

    Seeds have score 1. In each round, patterns beside MIN_SEEDS distinct confident values are taken up, so what a round
    finds brings in patterns of its own. A pattern's confidence sets the score of what it stands beside against its other
    uses; an entity's score follows from its patterns'. Rounds end when nothing new is found, or after ``rounds``.
    """
    graph = materialise(pattern_rows(marked.select("doc_id", "th", F.explode("es").alias("e"))), "pii-graph")
    # What stands beside too few values can't be taken up in any round.
    often = graph.groupBy("pattern", "value").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    often = materialise(often.filter(F.col("k") >= MIN_SEEDS).select("pattern", "n"), "pii-patterns")
    uses = materialise(word_uses(docs, often.select("pattern")), "pii-uses")
    node = ["doc_id", "th", "start", "end"]
    total = graph.count()
    edges = materialise(spread_join(graph, often.select("pattern"), ["pattern"], ["th", "start"], total, often), "pii-edges")
    discard(graph)
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = edges.select("pattern", "value", *node, "seed", "base", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    tables, seen = [edges], None
    for _ in range(rounds):
        sure = scores.filter(F.col("score") >= CONFIDENT).select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("k")).filter(F.col("k") >= MIN_SEEDS)
        summed = scores.groupBy("pattern").agg(F.sum(F.round("score", 9).cast("decimal(38,9)")).cast("double").alias("s"), F.count("*").alias("n"))
        against = F.greatest(F.col("uses") - F.col("n"), F.lit(0)) + UNKNOWN * (F.col("n") - F.col("s")) + DOUBT
        confidence = summed.join(sure, "pattern").join(uses, "pattern").select("pattern", F.least(F.lit(0.999), F.col("s") / (F.col("s") + against)).alias("conf"))
        told = spread_join(scores, confidence, ["pattern"], ["th", "start"], total, sizes, how="left")
        # An entity has three patterns at most, so its score is a product over three rows at most, in their order.
        one = F.struct("pattern", F.coalesce("conf", F.lit(0.0)).alias("conf"))
        doubt = told.groupBy(*node, "value", "seed", "base").agg(F.array_sort(F.collect_set(one)).alias("ps"))
        by_patterns = 1 - F.aggregate("ps", F.lit(1.0), lambda d, p: d * (1 - p["conf"]))
        scored = doubt.select(*node, "value", "seed", "base", "ps", by_patterns.alias("told"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.col("told")).alias("score")
        scores = materialise(scored.select(F.explode("ps.pattern").alias("pattern"), "value", *node, "seed", "base", "told", score), "pii-scores")
        discard(*tables[1:])
        tables = [edges, scores]
        found = scores.filter(F.col("told") >= CONFIDENT).count()
        if found == seen:
            break
        seen = found
    if "told" not in scores.columns:
        scores = scores.withColumn("told", F.lit(0.0))
    out = materialise(scores.filter(~F.col("base") & (F.col("told") >= CONFIDENT)).select(*node).distinct(), "pii-found")
    discard(*tables, often, uses)
    return out


def find(docs: DataFrame, carry=None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with one array of spans (start, end, value) a base kind, and ``found`` for entities that contexts gave away.

    Null and empty texts hold nothing; very long ones are read whole. Rows of one doc_id and equal text get equal spans;
    repeated rows and null ids are fine. An empty table gives an empty result. Columns of the new names are replaced; all
    others pass unchanged, null texts and all, whatever their names.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {*KINDS, "found"}]
    rows = docs.select(K.boxed(names), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = rows.select("row", "doc_id", F.xxhash64("text").alias("th"), "text", *[spans.alias(kind) for kind, spans in base_spans(F.col("text")).items()])
    marked = kinds.select("row", "doc_id", "th", *KINDS, instances(F.col("text"), F.concat(*KINDS)).alias("es"))
    marked = materialise(marked, "pii-spans")
    extra = bootstrapped(rows.select("text"), marked.select("doc_id", "th", "es"), rounds)
    per_row = extra.groupBy(F.col("doc_id").alias("id"), "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
    joined = marked.join(per_row.withColumnRenamed("th", "t"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left")
    return joined.select(*K.unboxed(names), *KINDS, F.coalesce("found", F.array().cast("array<struct<start: long, end: long>>")).alias("found"))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
