"""Text reports over the counts of the other operators. Each collects a few rows of totals and lays them out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import scoring, stats
from millrace.schemas import ATTRIBUTIONS, SPURIOUS


def percent(part: int, whole: int) -> str:
    return "n/a" if whole == 0 else f"{100.0 * part / whole:.1f}%"


def evaluation_report(pairs: DataFrame, mapping: DataFrame | None = None, classes=ATTRIBUTIONS, key: str = "job_id") -> str:
    """Detection, accuracy, confusion and class counts of ``scoring.paired`` rows; ``mapping`` of ``scoring.mapping_counts``."""
    gold = pairs.filter(pairs["label"].isNotNull())
    n, records = gold.count(), stats.distinct_records(gold, key).first()[0]
    spurious = gold.filter(gold["label"] == SPURIOUS).count()
    out = [f"{n} labelled mentions in {records} records: {n - spurious} to score, {spurious} spurious"]
    if mapping is not None:
        m = mapping.first()
        out.append(f"{m['n_mentions']} predicted mentions: {m['n_mapped']} mapped, {m['n_unmapped']} not ({percent(m['n_unmapped'], m['n_mentions'])})")
    out += ["", f"{'detection':<12}{'TP':>6}{'FP':>6}{'FN':>6}{'precision':>11}{'recall':>8}{'F1':>7}"]
    for r in scoring.detection(pairs, classes).collect():
        out.append(f"{r['system']:<12}{r['tp']:>6}{r['fp']:>6}{r['fn']:>6}{r['precision']:>11.3f}{r['recall']:>8.3f}{r['f1']:>7.3f}")
    out += ["", "accuracy"]
    for r in scoring.accuracy(pairs, classes).collect():
        out.append(f"{r['scope']:<12}{r['system']:<10}{r['correct']:>5}/{r['total']:<5}{percent(r['correct'], r['total'])}")
    cells = {(r["gold"], r["predicted"]): r["n"] for r in scoring.confusion(pairs, classes).collect()}
    out += ["", f"{'gold':<14}" + "".join(f"{c:>14}" for c in classes)]
    out += [f"{g:<14}" + "".join(f"{cells[g, p]:>14}" for p in classes) for g in classes]
    counts = {r["label"]: r for r in scoring.per_class(pairs, classes).collect()}
    out.append("")
    for c in classes:
        r = counts.get(c)
        out.append(f"{c:<14}gold {r['n_gold'] if r else 0}, predicted too {r['n_common'] if r else 0}, alike {r['n_correct'] if r else 0}")
    return "\n".join(out) + "\n"


def insights_report(records: DataFrame) -> str:
    """Totals, grounding, attributions and tokens of enriched records."""
    row = stats.status_counts(records).first()
    shares = stats.attribution_distribution(records)
    best = stats.majority_class(shares).first()
    mentions = stats.mentions(records)
    odd = [r["attribution"] for r in stats.off_schema(mentions, "attribution", ATTRIBUTIONS).orderBy("attribution").collect()]
    names = mentions.select("skill").distinct().count()
    each = "n/a" if row["n_ok"] == 0 else f"{row['n_mentions'] / row['n_ok']:.2f}"
    lines = [
        ("records", row["n_records"]),
        ("ok", row["n_ok"]),
        ("failed", row["n_error"]),
        ("without skills", row["n_zero_skill"]),
        ("mentions", row["n_mentions"]),
        ("grounded", f"{row['n_grounded']} ({percent(row['n_grounded'], row['n_mentions'])})"),
        ("not grounded", row["n_mentions"] - row["n_grounded"]),
        ("a record", each),
        *[(r["label"], f"{r['n']} ({percent(r['n'], row['n_mentions'])})") for r in shares.orderBy("ord").collect()],
        ("other labels", ", ".join(odd) or "none"),
        ("majority", "n/a" if row["n_mentions"] == 0 else f"{best['majority']} at {best['share']:.4f}"),
        ("input tokens", row["input_tokens"]),
        ("output tokens", row["output_tokens"]),
        ("distinct skills", names),
    ]
    return "".join(f"{name:<16}: {value}\n" for name, value in lines)
