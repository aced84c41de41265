"""Small tables with the awkward rows, and plain-Python versions of the contracts."""

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("shard", T.StringType()), ("kept", T.StringType()), ("size", T.StringType()))])


def rows(seed=1, n=60):
    """Texts with shared lines, copies, edits, blanks, nulls, wide characters, one long text; columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["Élan", "x1", "ABC"]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = ["  " + line(14) + " ", line(12), line(30)]
    texts = [None, "", " ", "\n\n", "one", "one two", "ONE two", "a\x0bb\x0cc d", " x ", line(5000)]
    base = line(40)
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0:
            words = base.split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind == 1 and texts[-1]:
            texts.append(texts[-1])
        else:
            parts = [line(rng.randint(0, 20)) for _ in range(rng.randint(1, 4))]
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared) if rng.random() < 0.6 else line(9))
            texts.append("\n".join(parts if rng.random() < 0.7 else [p.upper() for p in parts]))
    out = [(i, t, rng.choice(["en", None, "fr"]), rng.choice(["b", "a", None, "c"]), None, "s", "k", "z") for i, t in enumerate(texts)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\f\r"


def lines_dropped(data, min_chars=40, min_docs=5):
    key = lambda s: s.strip(WHITE).translate(LOWER)
    held = {}
    for d, text, *_ in data:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(d)
    out = {}
    for d, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and d < max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(data, n, percent):
    sets = {d: shingles(t, n) for d, t, *_ in data}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def contamination(data, items, window=10):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        w = rx.findall((text or "").translate(LOWER))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for d, text, *_ in data:
        w = rx.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                if g := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    ids |= g
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    again = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(figures):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(figures)))) % 10 == 0


def pii_spans(text):
    out = {}
    for kind, rx in PII.items():
        found = []
        for m in re.finditer(rx.replace(r"[\x20-]", "[ -]"), text or ""):
            figures = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(figures) <= 19 and luhn(figures), "phone": lambda: 8 <= len(figures) <= 15}[kind]()
            if ok:
                found.append((m.start(), m.end()))
        out[kind] = found
    return out


def best_cut(values, good, max_loss):
    """The threshold of quality over all values at once."""
    import numpy as np

    if not good.any():
        return float("-inf")
    highest = float(np.quantile(values[good], max_loss, method="lower"))
    if good.all():
        return highest
    cuts = np.unique(values[values <= highest])
    bad = np.sort(values[~good])
    trusted = np.sort(values[good])
    gain = np.searchsorted(bad, cuts) / len(bad) - np.searchsorted(trusted, cuts) / len(trusted)
    best = float(cuts[np.flatnonzero(gain == gain.max())[0]])
    below = values[values < best]
    return (best + float(below.max())) / 2 if len(below) else best
