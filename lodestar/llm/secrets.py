"""Secret scans: patterns, and a character convolutional network over every candidate.

Base spans come from three patterns. The network reads every candidate (a long run of
key characters) over its whole length, in overlapping pieces with the characters around
them, and adds the runs of which the likeliest piece's calibrated chance passes a
threshold set for recall on held-out labelled findings.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import frugal, lean_batches

#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "model")
#: A candidate for the network: a run of key characters of at least this length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of a piece of a candidate, and of the text before and after it, that the network reads; and from one piece to the next.
PIECE, BEFORE, AFTER, STRIDE = 48, 32, 16, 24
WIDTH, FILTERS, DIMS = 5, 24, 12
#: Share of held-out secrets that the threshold must keep.
RECALL = 0.97
_ALPHABET = np.zeros(128, np.int64)
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_=-.:\"' ,;@#$%&*()<>[]{}|\\\n\t"):
    _ALPHABET[ord(_c)] = _i + 2
_SYMBOLS = int(_ALPHABET.max()) + 1


def encode(before: str, piece: str, after: str) -> np.ndarray:
    """Symbol numbers of the piece and what is around it; 0 pads, 1 is any other character."""
    raw = before[-BEFORE:].rjust(BEFORE, "\0") + piece.ljust(PIECE, "\0") + after[:AFTER].ljust(AFTER, "\0")
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, _ALPHABET[np.minimum(codes, 127)], 1)
    return np.where(codes == 0, 0, np.maximum(out, 1))


def pieces(s: int, e: int) -> list[tuple[int, int]]:
    """Overlapping pieces that cover s to e; any stretch of PIECE - STRIDE characters is whole in one."""
    return [(i, min(e, i + PIECE)) for i in [*range(s, e - PIECE, STRIDE), max(s, e - PIECE)]]


def encode_at(text: str, s: int, e: int) -> np.ndarray:
    return encode(text[max(0, s - BEFORE) : s], text[s:e], text[e : e + AFTER])


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of labelled findings: random keys in settings, headers and prose, some of them behind or before paths and slugs; and look-alikes such as words in either case, paths, numbers, dates and rules.

    Of a key it is the piece that holds most of it, of a look-alike any.
    """
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    word = lambda: pick(string.ascii_lowercase, int(r.integers(2, 10)))
    xs, ys = [], []
    for _ in range(n):
        secret = bool(r.random() < 0.5)
        lead, tail = "", ""
        if secret:
            chars = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, "0123456789ABCDEF", "0123456789abcdef"][int(r.integers(6))]
            candidate = pick(chars, int(r.integers(20, 65))) + ("=" * int(r.integers(0, 3)) if "+" in chars else "")
            if r.random() < 0.3:
                candidate = str(r.choice(["ghp_", "sk-", "xoxb-", "glpat-", "AIza", "sk_live_"])) + candidate
            if r.random() < 0.25:
                joint = str(r.choice(["/", "_", "-"]))
                slug = "".join(word() + joint for _ in range(int(r.integers(1, 20))))
                lead, tail = (slug, "") if r.random() < 0.8 else ("", joint + slug)
        else:
            kind = int(r.integers(9))
            if kind == 0:
                candidate = "".join(word() for _ in range(5))
            elif kind == 1:
                candidate = "/".join(word() for _ in range(int(r.integers(4, 24 if r.random() < 0.4 else 7))))
            elif kind == 2:
                candidate = pick(string.digits, int(r.integers(16, 24)))
            elif kind == 3:
                candidate = str(r.choice(list("=-_/+"))) * int(r.integers(16, 60))
            elif kind == 4:
                candidate = "-".join([pick(string.digits, 4), pick(string.digits, 2), pick(string.digits, 2)]) + "_" + word() + "_" + word()
            elif kind == 5:
                candidate = (str(r.choice(["_", "-"]))).join(word() for _ in range(int(r.integers(3, 20 if r.random() < 0.3 else 6))))
            elif kind == 6:
                candidate = "".join(word().capitalize() for _ in range(4))
            elif kind == 7:
                candidate = "".join(word() for _ in range(int(r.integers(2, 5)))).upper()
            else:
                candidate = "_".join(word() for _ in range(int(r.integers(2, 6)))).upper()
            candidate = candidate.ljust(16, "E" if candidate.isupper() else "e")
        setting = str(r.choice(["key", "Authorization: Bearer", "auth", "credential", "private_key", "access", "signature", "pwd"]))
        before = " ".join(word() for _ in range(6)) + " "
        if r.random() < (0.7 if secret else 0.1):
            before += setting + str(r.choice([" = ", ": ", '="', "=", " "]))
        after = str(r.choice(["", '"', "'", " ", "\n", ". ", ", ", '",\n']))
        if after and r.random() < 0.8:
            after += " ".join(word() for _ in range(3))
        start, stop = len(before) + len(lead), len(before) + len(lead) + len(candidate)
        every = pieces(len(before), stop + len(tail))
        at = max(every, key=lambda p: min(p[1], stop) - max(p[0], start)) if secret else every[int(r.integers(len(every)))]
        xs.append(encode_at(before + lead + candidate + tail + after, *at))
        ys.append(secret)
    return np.stack(xs), np.array(ys, float)


class Network:
    """Embedding, convolution, rectifier, maximum and mean over the piece and over the text on each side, one unit out."""

    #: Windows that begin in the text before, in the piece, and later.
    SIDES = (slice(0, BEFORE - WIDTH + 1), slice(BEFORE - WIDTH + 1, BEFORE + PIECE - WIDTH + 1), slice(BEFORE + PIECE - WIDTH + 1, None))

    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (_SYMBOLS, DIMS)), "w": r.normal(0, 0.15, (WIDTH * DIMS, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * len(self.SIDES) * FILTERS), "c": np.zeros(1)}
        self.p["e"][0] = 0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        p = self.p
        e = p["e"][x]
        n, t = len(x), x.shape[1] - WIDTH + 1
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, t, WIDTH * DIMS)
        h = np.maximum(cols @ p["w"] + p["b"], 0)
        sides = [h[:, s] for s in self.SIDES]
        f = np.concatenate([s.max(1) for s in sides] + [s.mean(1) for s in sides], 1)
        return f @ p["v"] + p["c"][0], (cols, h, f)

    def grads(self, x, y):
        z, (cols, h, f) = self.forward(x)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"v": f.T @ d, "c": np.array([d.sum()])}
        df = d[:, None] * self.p["v"]
        dh = np.zeros_like(h)
        for k, s in enumerate(self.SIDES):
            part = h[:, s]
            top = part.argmax(1)
            np.put_along_axis(dh[:, s], top[:, None, :], np.take_along_axis(dh[:, s], top[:, None, :], 1) + df[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
            k += len(self.SIDES)
            dh[:, s] += df[:, None, k * FILTERS : (k + 1) * FILTERS] / part.shape[1]
        dh *= h > 0
        g["w"] = np.tensordot(cols, dh, ([0, 1], [0, 1]))
        g["b"] = dh.sum((0, 1))
        dc = (dh @ self.p["w"].T).reshape(*h.shape[:2], WIDTH, DIMS)
        de = np.zeros_like(self.p["e"])
        for k in range(WIDTH):
            np.add.at(de, x[:, k : k + h.shape[1]].ravel(), dc[:, :, k].reshape(-1, DIMS))
        de[0] = 0
        return g | {"e": de}

    def train(self, x, y, rounds: int = 5, batch: int = 64, rate: float = 0.01):
        r = np.random.default_rng(3)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                step += 1
                for k, g in self.grads(x[rows], y[rows]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x, y):
        """Logistic scaling of held-out outputs, then the highest threshold that keeps RECALL of the held-out secrets."""
        z = self.forward(x)[0]
        best = min(((a, b) for a in np.geomspace(0.1, 4, 25) for b in np.linspace(-2, 2, 17)), key=lambda p: np.logaddexp(0, np.where(y > 0, -1, 1) * (p[0] * z + p[1])).mean())
        self.slope, self.shift = best
        chance = np.sort(self.chance(x)[y > 0])
        self.threshold = float(chance[int((1 - RECALL) * len(chance))])

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.forward(x)[0] + self.shift)))


@lru_cache(1)
def network() -> Network:
    """The trained network; a fixed seed gives the same weights everywhere."""
    net = Network()
    net.train(*labelled(4000, 1))
    net.calibrate(*labelled(1500, 2))
    return net


_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings: whole matches whose value is long enough."""
    found = []
    folded = text.lower() if text.isascii() else None
    if folded is None or any(w in folded for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of key characters, whatever they are made of and whether or not a base span touches them."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def scan(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    added: list[dict] = [{} for _ in texts]
    where = ((i, s, e, p) for i, t in enumerate(texts) for s, e in candidates(t) for p in pieces(s, e))
    while part := list(itertools.islice(where, 512)):
        chance = net.chance(np.stack([encode_at(texts[i], *p) for i, _, _, p in part]))
        for (i, s, e, _), c in zip(part, chance, strict=True):
            if c >= net.threshold:
                added[i][s, 3, e] = True
    return [(base_spans(t), list(a)) for t, a in zip(texts, added, strict=True)]


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model of every row.

    A null or empty text has no spans. Each repeated row has its own result. Other
    columns are not read, so their names cannot clash.
    """
    lean_batches(docs.sparkSession)
    net = network()

    @frugal
    def run(batches):
        for b in batches:
            kept, n = [], b.num_rows
            for i in range(0, n, 256):
                kept += scan([t or "" for t in b.column(1).slice(i, 256).to_pylist()], net)
            count = lambda k: pa.array([sum(s[1] == k for s in x[0]) for x in kept], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(_line(x[0]).encode()).hexdigest() for x in kept]), pa.array([_line(x[0] + x[1]) for x in kept]), pa.array([len(x[1]) for x in kept], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def op10(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
