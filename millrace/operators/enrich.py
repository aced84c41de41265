"""Model calls on records: prompt, call, validate, ground. The model is a pluggable provider."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.schemas import ATTRIBUTIONS, ENRICHED, EXTRACTION, SENIORITIES

#: A provider takes (prompt, max_tokens) and returns (answer, {"input_tokens": n, "output_tokens": n}).
Provider = Callable[[str, int], tuple[str, dict]]

PROMPT = """List the technologies that this posting names and what it says of each.
Answer with one JSON object and nothing else:
{"skills": [{"skill": "...", "attribution": "...", "evidence": "..."}], "seniority": "...", "years_experience_min": null}
attribution: required (must have), preferred (welcome), boilerplate (only describes the employer) or not_expected (said not to be needed);
where several hold, the first in that order. evidence: the shortest unbroken quotation that shows it, whole words, under 25 words.
seniority: junior, mid, senior or unspecified. years_experience_min: the smallest number of years demanded, else null.
At most 25 skills, technologies only.

Title: {title}

{description}
"""
PROFILE_PROMPT = 'Answer with one JSON object {"role": "...", "skills": ["..."]}: the role and the technologies that this CV claims, none added.\n\n'
MAX_TOKENS = 2500
MAX_ERROR = 300
WORKERS = 8
PAUSE_S = 2.0

# Lengths and ranges that a valid extraction keeps.
SKILL_CHARS, EVIDENCE_CHARS, MAX_YEARS = 60, 400, 50
MENTION_KEYS = ("skill", "attribution", "evidence")
EXTRACTION_KEYS = ("skills", "seniority", "years_experience_min")


def prompt_column(title: Column, description: Column) -> Column:
    return X.fill_template(PROMPT, title=title, description=description.substr(1, X.PROMPT_CHARS))


def validated(raw: Column) -> Column:
    """``struct<ok, reason, extraction>`` for a model answer, in expressions only.

    Fences are dropped first. A record fails as a whole on text that isn't an object, an unknown or missing key,
    a value outside its enum, length or range. Years may come as a whole number in digits, quoted or with ``.0``.
    """
    loose = lambda body: F.from_json(body, "skills string, seniority string, years_experience_min string")
    parts = lambda body: F.struct(F.json_object_keys(body).alias("keys"), loose(body).alias("loose"))
    listed = lambda p: F.struct(p["keys"].alias("keys"), p["loose"].alias("loose"), F.from_json(p["loose"]["skills"], "array<map<string,string>>").alias("items"))
    return X.bound(X.strip_fences(raw), lambda body: X.bound(parts(body), lambda p: X.bound(listed(p), verdict)))


def verdict(parsed: Column) -> Column:
    """``validated`` for an answer taken apart into its keys, its fields as strings and its mentions as maps."""
    keys, loose, items = parsed["keys"], parsed["loose"], parsed["items"]
    years = loose["years_experience_min"]
    whole = F.regexp_extract(years, r"^(-?\d{1,9})(?:\.0+)?$", 1)
    length_ok = lambda v, most: F.coalesce((F.length(v) >= 1) & (F.length(v) <= most), F.lit(False))
    item_ok = lambda m: (
        (F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in MENTION_KEYS]))) == 0)
        & length_ok(F.try_element_at(m, F.lit("skill")), SKILL_CHARS)
        & F.coalesce(F.try_element_at(m, F.lit("attribution")).isin(*ATTRIBUTIONS), F.lit(False))
        & length_ok(F.try_element_at(m, F.lit("evidence")), EVIDENCE_CHARS)
    )
    reason = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in EXTRACTION_KEYS]))) > 0, "unknown key")
        .when(items.isNull(), "skills is not a list of objects")
        .when(~F.forall(items, lambda m: F.coalesce(item_ok(m), F.lit(False))), "invalid mention")
        .when(~F.coalesce(loose["seniority"].isin(*SENIORITIES), F.lit(False)), "invalid seniority")
        .when(years.isNotNull() & (whole == ""), "years is not a whole number")
        .when(years.isNotNull() & ~F.coalesce(F.try_to_number(whole, F.lit("S999999999")).between(0, MAX_YEARS), F.lit(False)), "years out of range")
    )
    mention = lambda m: F.struct(*[F.try_element_at(m, F.lit(k)).alias(k) for k in MENTION_KEYS])
    good = F.struct(
        F.transform(items, mention).alias("skills"),
        loose["seniority"].alias("seniority"),
        F.when(years.isNotNull(), whole.try_cast("int")).alias("years_experience_min"),
    ).cast(EXTRACTION)
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), good).alias("extraction"))


def grounded_mentions(skills: Column, source: Column) -> Column:
    """Each mention with whether its evidence stands in the full text, which is folded once; none is dropped."""
    mention = lambda m, folded: F.struct(m["skill"].alias("skill"), m["attribution"].alias("attribution"), m["evidence"].alias("evidence"), X.is_grounded(m["evidence"], source, folded).alias("grounded"))
    return X.bound(X.without_spaces(source), lambda folded: F.transform(skills, lambda m: mention(m, folded)))


def fault(text: str | None) -> str | None:
    """``validated`` in plain Python, for the provider's loop: why an answer is no good, or None."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = body.partition("\n")[2] if "\n" in body else body[3:]
    try:
        data = json.loads(body.removesuffix("```"))
    except ValueError:
        return "not a JSON object"
    if not isinstance(data, dict):
        return "not a JSON object"
    items, years = data.get("skills"), data.get("years_experience_min")
    if set(data) - set(EXTRACTION_KEYS):
        return "unknown key"
    if not isinstance(items, list) or not all(isinstance(m, dict) for m in items):
        return "skills is not a list of objects"
    fits = lambda v, most: isinstance(v, str) and 1 <= len(v) <= most
    if not all(not set(m) - set(MENTION_KEYS) and fits(m.get("skill"), SKILL_CHARS) and m.get("attribution") in ATTRIBUTIONS and fits(m.get("evidence"), EVIDENCE_CHARS) for m in items):
        return "invalid mention"
    if data.get("seniority") not in SENIORITIES:
        return "invalid seniority"
    if years is None:
        return None
    whole = re.fullmatch(r"(-?[0-9]{1,9})(\.0+)?", str(years))
    if whole is None:
        return "years is not a whole number"
    return None if 0 <= int(whole[1]) <= MAX_YEARS else "years out of range"


def in_flight(call: Callable, values: Iterable, workers: int) -> Iterator:
    """``call`` of each value in order, ``workers`` at a time and twice as many begun; one worker calls in place."""
    if workers == 1:
        yield from map(call, values)
        return
    begun: deque = deque()
    with ThreadPoolExecutor(workers) as pool:
        for value in values:
            begun.append(pool.submit(call, value))
            if len(begun) >= 2 * workers:
                yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()


def call_model(df: DataFrame, provider: Provider, workers: int = WORKERS, attempts: int = 2, pause_s: float = PAUSE_S, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds raw, attempt, error, input_tokens and output_tokens to rows with a ``prompt``.

    The calls wait on a network, so each task keeps ``workers`` in flight. A call that fails, or whose answer breaks any
    rule, is made again; a failure in the end is a value, never an exception. Calls are made whenever the result is
    evaluated, so write it before more than one reader takes it. Only prompts travel to Python, where they stay Arrow
    data but for those in flight; so a worker holds one Arrow batch of prompts and its answers.
    """

    def one(prompt: str):
        error = None
        for attempt in range(1, attempts + 1):
            try:
                answer, usage = provider(prompt, max_tokens)
                if fault(answer) is None or attempt == attempts:
                    return answer, attempt, None, usage.get("input_tokens", 0), usage.get("output_tokens", 0)
            except Exception as failure:
                error = f"{type(failure).__name__}: {failure}"[:MAX_ERROR]
            if attempt < attempts:
                time.sleep(pause_s)
        return None, attempts, error, 0, 0

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"raw": pa.string(), "attempt": pa.int32(), "error": pa.string(), "input_tokens": pa.int64(), "output_tokens": pa.int64()}
        for prompts in batches:
            made: list[list] = [[] for _ in kinds]
            for answer in in_flight(one, (p.as_py() for p in prompts), workers):
                for values, value in zip(made, answer, strict=True):
                    values.append(value)
            yield pa.StructArray.from_arrays([pa.array(values, kind) for values, kind in zip(made, kinds.values(), strict=True)], list(kinds))

    # Not deterministic: Catalyst must neither repeat nor move the calls.
    call = F.arrow_udf(run, "raw string, attempt int, error string, input_tokens long, output_tokens long").asNondeterministic()
    return df.select("*", call("prompt").alias("_call")).select(*[F.col(f"`{c}`") for c in df.columns], "_call.*")


def enrich(df: DataFrame, provider: Provider, **how) -> DataFrame:
    """Postings (job_id, title, description_clean) to enriched records; failed ones keep their error."""
    asked = df.select("job_id", "title", "description_clean", prompt_column(F.col("title"), F.col("description_clean")).alias("prompt"))
    called = call_model(asked, provider, **how).withColumn("_v", validated(F.col("raw")))
    ok = F.coalesce(F.col("_v.ok"), F.lit(False)) & F.col("error").isNull()
    ext = F.col("_v.extraction")
    return called.select(
        F.col("job_id").cast("string").alias("job_id"),
        "title",
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(ok, F.col("attempt")).alias("attempt"),
        F.when(ok, grounded_mentions(ext["skills"], F.col("description_clean"))).alias("skills"),
        F.when(ok, ext["seniority"]).alias("seniority"),
        F.when(ok, ext["years_experience_min"]).alias("years_experience_min"),
        F.when(ok, F.col("input_tokens")).alias("input_tokens"),
        F.when(ok, F.col("output_tokens")).alias("output_tokens"),
        F.when(~ok, F.coalesce("error", F.concat(F.lit("invalid answer: "), F.col("_v.reason"))).substr(1, MAX_ERROR)).alias("error"),
    ).to(ENRICHED)


def progress(records: DataFrame | None, total: int, seconds: float) -> dict:
    """How far a run is, from the records written so far: done, ok, failed, a rate a second and seconds to go."""
    counts = {} if records is None else {r["status"]: r["n"] for r in records.groupBy("status").agg(F.count("*").alias("n")).collect()}
    done = sum(counts.values())
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "ok": counts.get("ok", 0), "failed": counts.get("failed", 0), "rate": round(rate, 1), "seconds_left": round((total - done) / rate) if rate else None}


def advice_prompt(title: str, missing: list[str]) -> str:
    """What to ask a model on how to close a computed gap."""
    gap = ", ".join(missing) or "none"
    return f"Someone wants the job '{title}' and lacks these skills that it demands: {gap}. Say in three short bullet points how to get them."


def advise(matches: DataFrame, provider: Provider, max_tokens: int = 1024) -> str:
    """The model's advice for the best match of ``operators.matching.match``: generated text, apart from what is computed."""
    best = matches.orderBy(F.desc("score"), "job_id").select("title", "missing").first()
    if best is None:
        raise ValueError("no match to advise on")
    return provider(advice_prompt(best["title"] or "", list(best["missing"] or [])), max_tokens)[0]


def parse_profile(answers: DataFrame, column: str = "raw") -> DataFrame:
    """role and skills out of a model's answer to ``PROFILE_PROMPT``; prose around the object is ignored."""
    parsed = F.from_json(X.json_slice(F.col(column)), "role string, skills array<string>")
    return answers.select(F.coalesce(parsed["role"], F.lit("")).alias("role"), F.coalesce(parsed["skills"], F.array().cast("array<string>")).alias("skills"))


class LazyProvider:
    """A provider whose client is made at the first call in each process, so a missing setting is an error of that call.

    ``connect(settings)`` returns the provider; ``settings`` with null or empty values are named in the error.
    """

    def __init__(self, connect: Callable[[dict], Provider], settings: dict[str, str | None]) -> None:
        self.connect, self.settings, self._client = connect, dict(settings), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def __call__(self, prompt: str, max_tokens: int) -> tuple[str, dict]:
        if self._client is None:
            unset = [name for name, value in self.settings.items() if not value]
            if unset:
                raise RuntimeError(f"not set: {', '.join(unset)}")
            self._client = self.connect(self.settings)
        return self._client(prompt, max_tokens)


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")


class RuleProvider:
    """Answers by rules instead of a model: a stand-in for runs without a network, not a quality claim."""

    # Wording that decides an attribution, strongest first within a sentence.
    CUES = (("not_expected", ("not required", "not needed", "no need")), ("preferred", ("a plus", "nice to have", "preferred", "ideally")), ("required", ("must", "required", "experience with", "proficient", "you have")))

    def __init__(self, words, cues=CUES) -> None:
        self.words, self.cues = tuple(words), cues
        # A match of a word of word characters only is a whole run of them, so such matches don't overlap and one pass finds all.
        self.plain = tuple(w for w in self.words if re.fullmatch(r"\w+", w))
        self.any_plain = re.compile(rf"\b(?:{'|'.join(map(re.escape, self.plain)) or '(?!)'})\b", re.IGNORECASE)
        self.others = tuple((w, re.compile(rf"\b{re.escape(w)}\b", re.IGNORECASE)) for w in self.words if w not in self.plain)
        #: The words that a match spells; there are as many as ways to write the words in capitals and small letters.
        self.spelled: dict[str, tuple[str, ...]] = {}

    def firsts(self, text: str) -> dict[str, tuple[int, int]]:
        """Where each of the words that occur in ``text`` first does, in the order of the words."""
        at: dict[str, tuple[int, int]] = {}
        for m in self.any_plain.finditer(text):
            words = self.spelled.get(m[0])
            if words is None:
                words = self.spelled[m[0]] = tuple(w for w in self.plain if re.fullmatch(re.escape(w), m[0], re.IGNORECASE))
            for word in words:
                at.setdefault(word, m.span())
        for word, pattern in self.others:
            if m := pattern.search(text):
                at[word] = m.span()
        return {word: at[word] for word in self.words if word in at} if at else at

    def __call__(self, prompt: str, max_tokens: int) -> tuple[str, dict]:
        body = prompt.split("Title: ", 1)[-1]
        title, _, description = body.partition("\n\n")
        found: dict[str, tuple[int, str, str]] = {}
        for sentence in SENTENCE_END.split(description):
            spots = self.firsts(sentence)
            if not spots:
                continue
            lowered = sentence.lower()
            label = next((name for name, cues in self.cues if any(cue in lowered for cue in cues)), "boilerplate")
            for word, (start, end) in spots.items():
                quote = sentence[max(0, start - 40) : end + 40].strip()[:EVIDENCE_CHARS]
                found[word] = min(found.get(word, (99, "", "")), (ATTRIBUTIONS.index(label), label, quote))
        years = [int(x) for x in re.findall(r"\b(\d{1,2})\+? years", description)]
        level = next((name for name in SENIORITIES if name in title.lower()), "unspecified")
        skills = [{"skill": w, "attribution": a, "evidence": q} for w, (_, a, q) in found.items()][:25]
        answer = json.dumps({"skills": skills, "seniority": level, "years_experience_min": min(years, default=None)})
        return answer, {"input_tokens": len(prompt) // 4, "output_tokens": len(answer) // 4}


class ReplayProvider:
    """Stored answers by prompt, for tests and reruns."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = dict(answers)

    def __call__(self, prompt: str, max_tokens: int) -> tuple[str, dict]:
        return self.answers[prompt], {"input_tokens": 0, "output_tokens": 0}
