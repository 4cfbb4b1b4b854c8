"""Language identification by hierarchical discrimination.

A document's language family is predicted first; within the family, one-versus-one
linear support vector machines vote. Families are learned: languages whose letter
profiles lie close are merged bottom up. Features are hashed byte n-grams of the
lower-cased text, so scores are sums of table look-ups over whole texts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import lean_batches, settle, small_side
from ._text import _LOWER, parts, utf8

#: Hash buckets of the n-grams.
BITS = 12
DIM = 1 << BITS
#: Most labelled documents of a language that the classifier is fitted on, and of all languages together: the bound of the sample. Many languages share the latter, with about LEAST_PER_LANG each at least, as none is left out.
PER_LANG, SAMPLE, LEAST_PER_LANG = 250, 16000, 20
#: One in so many sampled documents of a language is kept from the machines and sets the slopes that turn margins to chances.
CALIBRATE = 5
#: Bytes of text handled at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: A text of n bytes is of no learned language if its familiarity is SLACK + SPREAD / sqrt(n) below what all but LEAST_SHARE of the training documents reach; the mean over few n-grams strays more.
LEAST_SHARE, SLACK, SPREAD = 0.01, 0.2, 3.0
#: Folds of crc32(doc_id as text); the held-out one never trains.
FOLDS, HELD_OUT = 4, 2
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _CLASS[_b] = _LOWER[_b] if chr(_b).isalpha() and _b < 128 or _b >= 128 else (0x20 if _b != 0x27 else 0x27)


def _grams(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each of the first n bytes; digits and marks read as blanks.

    ends are the positions of the last byte of each row: what would follow it reads as blanks, whatever row comes next.
    """
    x = _CLASS[data].astype(np.uint32)
    y = np.append(x[1:], np.uint32(32))
    z = np.append(y[1:], np.uint32(32))
    y[ends] = z[ends] = z[ends[ends > 0] - 1] = 32
    x, y, z = x[:n], y[:n], z[:n]
    out = [x + 17, (x * 251 + y * 7919 + 11), (x * 40503 + y * 2654435 + z * 97 + 5)]
    return [(g * np.uint32(2654435761)) >> np.uint32(32 - BITS) for g in out]


def profile(text_bytes: np.ndarray) -> np.ndarray:
    """Relative n-gram frequencies of one text."""
    counts = np.zeros(DIM)
    for i in range(0, len(text_bytes), CHUNK):
        part = text_bytes[i : i + CHUNK + 2]
        last = np.array([len(part) - 1] if i + CHUNK >= len(text_bytes) - 2 else [], np.int64)
        for g in _grams(part, last, CHUNK):
            counts += np.bincount(g, minlength=DIM)
    return (counts / max(1, counts.sum())).astype(np.float32)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine under squared hinge loss, by accelerated full gradients; y is +1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c, rate = w.copy(), b, np.float32(1.0 / (2.0 * ((x * x).sum(1) + 1).max() + penalty))
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c))
        g = (weight * slack * y * 2).astype(np.float32)
        w2, b2 = v + rate * (x.T @ g - np.float32(penalty) * v), c + rate * g.sum()
        m = t / (t + 3)
        v, c, w, b = w2 + np.float32(m) * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that turns margins to chances (no offset: 0 stays one half)."""
    slopes = np.geomspace(0.5, 20, 40)
    loss = [np.logaddexp(0, -s * y * margin).mean() for s in slopes]
    return float(slopes[int(np.argmin(loss))])


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages: average-link merging by cosine down to about the square root of their number."""
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


class Model:
    """Weights of all machines in one table: a column each of the bucket weights."""

    def __init__(self, langs, groups, tables, bias, slopes, jobs):
        self.langs, self.groups, self.tables, self.bias, self.slopes, self.jobs = langs, groups, tables, bias, slopes, jobs
        self.usual, self.least = np.zeros(DIM, np.float32), -np.inf

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> Model:
        langs = sorted(set(labels))
        y = np.array([langs.index(v) for v in labels], int)
        if not langs:
            return Model([], [], np.zeros((DIM, 0), np.float32), np.zeros(0), np.zeros(0), [])
        groups = families(np.stack([x[y == i].mean(0) for i in range(len(langs))]))
        spread = (1.0 / np.sqrt(x.var(0) + 1e-8)).astype(np.float32)
        z = x * spread
        z, scale = (z / (s := np.sqrt((z * z).sum(1).mean()) or 1.0)).astype(np.float32), spread / s
        jobs = [("family", f, None) for f in range(len(groups))] if len(groups) > 1 else []
        jobs += [(f, a, b) for f, g in enumerate(groups) for a, b in itertools.combinations(g, 2)]
        tables, bias, slopes = [], [], []
        # Of each language every CALIBRATE-th row, where it has as many, is kept from the machines and calibrates them.
        place = np.zeros(len(y), int)
        for i in range(len(langs)):
            place[y == i] = np.arange((y == i).sum())
        apart = place % CALIBRATE == CALIBRATE - 1
        for job in jobs:
            if job[0] == "family":
                rows = np.ones(len(y), bool)
                sign = np.where(np.isin(y, groups[job[1]]), 1.0, -1.0)
            else:
                rows = np.isin(y, job[1:])
                sign = np.where(y == job[1], 1.0, -1.0)
            w, b = _svm(z[rows & ~apart], sign[rows & ~apart])
            tables.append(w * scale)
            bias.append(b)
            test = rows & apart if len(set(sign[rows & apart])) == 2 else rows
            slopes.append(_platt(z[test] @ w + b, sign[test]))
        model = Model(langs, groups, np.stack(tables, 1).astype(np.float32) if jobs else np.zeros((DIM, 0), np.float32), np.array(bias), np.array(slopes), jobs)
        model.usual = np.log(x.mean(0) + 1e-6).astype(np.float32)
        model.least = float(np.quantile(x @ model.usual, LEAST_SHARE)) - SLACK
        return model

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed margins of every machine for every row, and the mean log frequency, in the training documents, of the row's n-grams."""
        n, tables = len(offsets) - 1, np.column_stack([self.tables, self.usual])
        sums, total = np.zeros((n, len(self.jobs) + 1)), 3.0 * np.maximum(1, np.diff(offsets))
        for i in range(0, len(data), CHUNK):
            part, stop = data[i : i + CHUNK + 2], min(len(data), i + CHUNK)
            ends = offsets[1:][np.diff(offsets) > 0] - 1 - i
            grams = _grams(part, ends[(ends >= 0) & (ends < len(part))], stop - i)
            lo, hi = int(np.searchsorted(offsets, i, "right")) - 1, int(np.searchsorted(offsets, stop, "left"))
            at = np.clip(offsets[lo : hi + 1] - i, 0, stop - i)
            full = np.flatnonzero(np.diff(at) > 0)
            for k in range(sums.shape[1]):
                table = np.ascontiguousarray(tables[:, k])
                each = table[grams[0]] + table[grams[1]] + table[grams[2]]
                sums[lo + full, k] += np.add.reduceat(each, at[full])
        sums /= total[:, None]
        return sums[:, :-1] + self.bias, sums[:, -1]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence, and whether the n-grams are as usual as those of the training documents; machines are sure of any text, of unknown languages too."""
        n = len(offsets) - 1
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        m, usual = self.margins(data, offsets)
        sure = 1 / (1 + np.exp(-np.clip(m * self.slopes, -60, 60)))
        first = [k for k, j in enumerate(self.jobs) if j[0] == "family"]
        family, score = (m[:, first].argmax(1), sure[:, first].max(1)) if first else (np.zeros(n, int), np.ones(n))
        pick = np.zeros(n, int)
        for f, group in enumerate(self.groups):
            rows = np.flatnonzero(family == f)
            votes, chance = np.zeros((len(rows), len(self.langs))), np.ones((len(rows), len(self.langs)))
            for k, (g, a, b) in enumerate(self.jobs):
                if g == f and g != "family":
                    won = m[rows, k] >= 0
                    votes[:, a] += won
                    votes[:, b] += ~won
                    chance[:, a] = np.minimum(chance[:, a], sure[rows, k])
                    chance[:, b] = np.minimum(chance[:, b], 1 - sure[rows, k])
            best = max(group, key=lambda i: 0) if len(group) == 1 else None
            pick[rows] = best if best is not None else np.array(group)[(votes + chance)[:, group].argmax(1)]
            score[rows] *= chance[np.arange(len(rows)), pick[rows]]
        return [self.langs[i] for i in pick], score, usual >= self.least - SPREAD / np.sqrt(np.maximum(1, np.diff(offsets)))


def _lowest(most: int):
    """Rows (lang, h) to the `most` lowest different h of each language of a task."""

    def run(batches):
        low: dict[str, np.ndarray] = {}
        for b in batches:
            names, at = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            h = b.column(1).to_numpy()
            for i, name in enumerate(names.tolist()):
                low[name] = np.unique(np.append(low.get(name, h[:0]), h[at == i]))[:most]
        for name, h in low.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h)], ["lang", "h"])

    return run


def _sample(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """lang, h, text of at most PER_LANG different labelled training documents of each language (fewer where SAMPLE is shared by many), those of the lowest hash of key and text.

    Copies of a chosen document, rows of equal key and text, come as often as they are;
    no language is left out, whatever its keys are.
    """
    named = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = named.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("k"))).select("lang", F.xxhash64(F.lit(5), "k", "text").alias("h"), "text")
    langs = known.select("lang").distinct().count()
    most = int(max(LEAST_PER_LANG, min(PER_LANG, SAMPLE / max(1, langs))))
    low = known.select("lang", "h").mapInArrow(_lowest(most), "lang string, h long").distinct()
    # A task has at most `most` rows of a language, and the window's own limit cuts them again before they meet.
    chosen = settle(low.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("i") <= most).select("lang", "h"))
    return known.join(small_side(chosen, SAMPLE + LEAST_PER_LANG * 1000), ["lang", "h"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The classifier, from a bounded hash sample of the rows outside the held-out fold.

    Sampled texts are profiled whole, on the executors, the copies of one only once in a
    task; the driver gets one vector of DIM numbers a sampled document.
    """

    def profiles(batches):
        seen = set()
        for b in batches:
            data, at = utf8(b.column(2))
            new = []
            for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            rows = [profile(data[at[i] : at[i + 1]]).tobytes() for i in new]
            took = pa.array(new, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(rows, pa.binary())], ["lang", "h", "x"])

    rows = _sample(docs, key, text, lang).select("lang", "h", "text").mapInArrow(profiles, "lang string, h long, x binary").dropDuplicates(["lang", "h"]).toArrow()
    if rows.num_rows == 0:
        return Model.fit(np.zeros((0, DIM), np.float32), [])
    raw = sorted(zip(rows.column("lang").to_pylist(), rows.column("x").to_pylist(), strict=True))
    return Model.fit(np.stack([np.frombuffer(v, np.float32) for _, v in raw]), [label for label, _ in raw])


def identify(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred, score and familiar (whether the text reads like the learned languages).

    lang_pred is a learned language, or `und` with score 0 where the text is null or has
    no letter, or nothing could be learned. A null key counts as not held out. Clashing
    columns are replaced. Rows stay as they are, repeated ones included.
    """
    lean_batches(docs.sparkSession)
    model = model or fit(docs, key, text, lang)

    @F.arrow_udf("struct<lang_pred:string,score:double,familiar:boolean>")
    def of(t: pa.Array) -> pa.Array:
        data, at = utf8(t)
        langs, scores, known = [], [np.zeros(0)], [np.zeros(0, bool)]
        for i, j in parts(at, CHUNK):
            span = data[at[i] : at[j]]
            got, sure, usual = model.predict(span, at[i : j + 1] - at[i])
            letters = prefix_letters(span, at[i : j + 1] - at[i])
            for k in np.flatnonzero(~letters):
                if not any(c.isalpha() for c in bytes(data[at[i + k] : at[i + k + 1]]).decode("utf-8", "replace")):
                    got[k], sure[k] = UNKNOWN, 0.0
            langs += got
            scores.append(sure)
            known.append(usual)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(known))], ["lang_pred", "score", "familiar"])

    return docs.withColumn("held_out", held_out(F.col(key))).withColumn("_l", of(F.col(text))).withColumns({c: F.col(f"_l.{c}") for c in ("lang_pred", "score", "familiar")}).drop("_l")


_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def prefix_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has an ASCII letter."""
    seen = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    return seen[offsets[1:]] > seen[offsets[:-1]]


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
