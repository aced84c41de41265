"""Text expressions. All are Catalyst expressions except ``wrap_lines``, which only lays out exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words whose presence marks a text as English.
STOPWORDS = (
    "the", "and", "for", "with", "you", "our", "are", "will", "have", "this",
    "that", "your", "from", "work", "team", "role", "experience", "skills", "who", "all",
)
MIN_STOPWORDS = 5
MIN_CHARS = 200
PROMPT_CHARS = 12_000

# Typographic characters and their plain forms.
TYPOGRAPHIC = "‘’“”–—"
PLAIN = "''\"\"--"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it and wherever Catalyst moves it.

    It leaves generated code, so it is for expressions that do so anyway or are small; ``with_once`` stays in it.
    """
    return F.transform(F.array(value), use)[0]


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that are evaluated once: no filter or projection above is moved below them."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def clean_html(text: Column) -> Column:
    """Tags become one space, then whitespace runs become one space; ends trimmed. Entities stay as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: what stands between word boundaries. One pass over the text."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def stopword_hits(text: Column, words=STOPWORDS) -> Column:
    """How many of ``words`` occur in the lower-cased text. Null text gives 0."""
    return F.coalesce(F.size(F.array_intersect(tokens(F.coalesce(text, F.lit(""))), F.array(*[F.lit(w) for w in words]))), F.lit(0))


def is_present(text: Column) -> Column:
    """Not null and more than spaces. A lone newline counts as present."""
    return text.isNotNull() & (F.trim(text) != "")


def is_blank(text: Column) -> Column:
    """Null, empty or any Unicode whitespace only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def word_count(text: Column) -> Column:
    """Whitespace-separated words; null or blank text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    return F.size(F.filter(parts, lambda part: part != ""))


def fold_typography(text: Column) -> Column:
    return F.translate(text, TYPOGRAPHIC, PLAIN)


def normalise(text: Column) -> Column:
    """Plain quotes and dashes, lower case, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(fold_typography(text)), r"(?U)\s+", " "))


def without_spaces(text: Column) -> Column:
    """``normalise`` and every space gone, in one pass."""
    return F.regexp_replace(F.lower(fold_typography(text)), r"(?U)\s+", "")


def is_grounded(evidence: Column, source: Column, folded: Column | None = None) -> Column:
    """Whether ``evidence`` stands in ``source``, whitespace and typography aside.

    Null or empty on either side is false; evidence of spaces only is true, as it holds no character to miss. ``folded``
    is ``without_spaces(source)`` where a caller has it already.
    """
    usable = F.coalesce((F.length(evidence) > 0) & (F.length(source) > 0), F.lit(False))
    return F.when(usable, F.contains(without_spaces(source) if folded is None else folded, without_spaces(evidence))).otherwise(False)


def strip_fences(text: Column) -> Column:
    """Drop a leading code-fence line and a trailing fence around a model answer."""
    fence = "```"
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    after_line = F.when(F.instr(body, "\n") > 0, body.substr(F.instr(body, "\n") + 1, F.length(body))).otherwise(body.substr(F.lit(4), F.length(body)))
    opened = F.when(body.startswith(fence), after_line).otherwise(body)
    closed = F.when(opened.endswith(fence), opened.substr(F.lit(1), F.length(opened) - 3)).otherwise(opened)
    return F.regexp_replace(closed, r"(?U)^\s+|\s+$", "")


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null where there is no such object."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    whole = (first > 0) & (F.instr(text, "}") > 0) & (last >= first)
    return F.when(whole, text.substr(first, last - first + 1))


def phrase_mask(text: Column, pattern: str) -> Column:
    """Case-insensitive regex test; null text is false."""
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def context_snippet(text: Column, needle: str, before: int = 90, after: int = 60) -> Column:
    """The first occurrence of ``needle`` with its surroundings, newlines as spaces; null without one."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(F.lit(1), at - before)
    piece = text.substr(start, at + after - start)
    return F.when(at > 0, F.regexp_replace(piece, r"\n", " "))


def composite_text(title: Column, skills: Column) -> Column:
    """What an encoder sees of a record. Without a title only the skill list remains."""
    listed = F.concat(F.lit("Skills: "), F.array_join(F.coalesce(skills, F.array().cast("array<string>")), ", "))
    return F.when(F.coalesce(title, F.lit("")) == "", listed).otherwise(F.concat(title, F.lit(". "), listed))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def fill_template(template: str, **values: Column) -> Column:
    """Replace each ``{name}`` by its column. Values aren't scanned for names again."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        pieces += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def wrap_lines(text: Column, width: int = 90) -> Column:
    """Paragraph fill for human-readable exports."""
    @F.pandas_udf("string")
    def fill(values: pd.Series) -> pd.Series:
        import textwrap

        return values.map(lambda value: None if value is None else textwrap.fill(value, width))

    return fill(text)
