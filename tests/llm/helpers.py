"""Small documents with every awkward case, and plain versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, part string, kind string, component_id string, shard string, n_words string"


def vocabulary(seed, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 8))) for _ in range(n)]


def documents(seed=0, near=40):
    """Rows with copies, near copies around a hub, a shared passage, a long text, nulls, empties and repeated rows."""
    r = random.Random(seed)
    v = vocabulary(seed)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    texts = [prose(r.randint(1, 120)) for _ in range(30)]
    passage = prose(90)
    texts += [prose(30) + "\n" + passage + " " + prose(30) for _ in range(8)]
    base = prose(120).split()
    for _ in range(near):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            k = r.randrange(len(w))
            if r.random() < 0.5:
                w[k] = r.choice(v)
            else:
                del w[k]
        texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [texts[31]] * 2 + ["", " \n\t ", None, None, "x", "one two three", "one two three", "ONE two three", prose(6000), "ab " * 900]
    rows = [(i * 3 + 1, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None, "s2"])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[2], "en", "s1"), (None, None, None, None)]
    r.shuffle(rows)
    return [(*row, None, "a", "b", "c", "d", "e", "f", "g") for row in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def substring_removal(rows, window=20):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k, at = tuple(w[i : i + window]), (float("-inf") if d is None else d, i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("-inf") if d is None else d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def byte_removal(rows, length=400):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shingles(t, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_classes(rows):
    """Counter of (doc_id, size, component): rows without an id or words stand alone."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            near = Counter(j for g in s for j in held[g])
            for j, n in near.items():
                e, other = sets[j]
                if 100 * n >= 75 * (len(s) + len(other) - n):
                    a, b = root(d), root(e)
                    up[max(a, b)] = min(a, b)
            for g in s:
                held[g].append(i)
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)
