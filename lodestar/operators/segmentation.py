"""Words of texts without spaces: a lexicon learned from the corpus, and the path through it that costs least."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle

# Characters of Chinese and Korean words.
HAN, HANGUL = "㐀-䶿一-鿿豈-﫿", "가-힯"
#: Characters of a word at most, occurrences of a learned word at least, how much more often than by chance its parts stand together, and words of the lexicon at most, the most frequent ones.
LONGEST, LEAST, COHESION, SIZE = 4, 3, 8.0, 200_000


#: Strings that a task counts before it passes them on, and rows whose words are Python's at once.
HELD, SLICE = 1 << 18, 64
#: Characters counted at once, and possible strings up to which each has a counter; characters of a run up to which paths are found side by side, and how many of them.
CHARS, DENSE = 1 << 19, 1 << 22
SHORT, RUNS = 256, 4096


def _script(code: np.ndarray) -> np.ndarray:
    """1 for the characters of HAN, 2 for those of HANGUL, else 0."""
    out = np.zeros(len(code), np.int8)
    for script, ranges in ((1, HAN), (2, HANGUL)):
        for lo, hi in re.findall("(.)-(.)", ranges):
            out[(code >= ord(lo)) & (code <= ord(hi))] = script
    return out


def _grams(text: str, longest: int):
    """The strings of each length up to `longest` inside runs of one script, and how often they occur."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _script(code)
    at = np.flatnonzero(script)
    chars, own = np.unique(code[at], return_inverse=True)
    letter = np.full(len(code), -1, np.int64)
    letter[at] = own
    letters = [chr(c) for c in chars.tolist()]
    grams, which = [""], np.zeros(len(at), np.int64)
    for k in range(longest):
        more = at + k < len(code)
        more[more] = script[at[more] + k] == script[at[more]]
        at, which = at[more], which[more]
        if not len(at):
            return
        key = which * len(letters) + letter[at + k]
        if len(grams) * len(letters) <= DENSE:
            n = np.bincount(key, minlength=len(grams) * len(letters))
            found = np.flatnonzero(n)
            place = np.zeros(len(n), np.int64)
            place[found] = np.arange(len(found))
            which, n = place[key], n[found]
        else:
            found, which, n = np.unique(key, return_inverse=True, return_counts=True)
        grams = [grams[g // len(letters)] + letters[g % len(letters)] for g in found.tolist()]
        yield grams, n.tolist()


def counted(docs: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """gram, n: the strings of up to `longest` characters inside runs of one script, and how often they occur in all texts; counts are summed in tasks before they meet."""
    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            held, size = [], 0
            for i, t in enumerate(b.column(0), 1):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > CHARS or i == b.num_rows:
                    for grams, n in _grams("\0".join(held), longest):
                        counts.update(dict(zip(grams, n, strict=True)))
                    held, size = [], 0
                    if len(counts) > HELD:
                        yield table(counts)
                        counts.clear()
        yield table(counts)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, size: int = SIZE) -> dict[str, float]:
    """Costs (minus log of the share) of the words of a corpus: every character, and what stands together `cohesion` times as often as any two parts of it would by chance.

    The counts are over all texts; the lexicon, a model of at most `size` words, is the driver's.
    """
    grams = settle(counted(docs, text, longest).withColumn("size", F.length("gram")).filter(f"size = 1 or n >= {least}"))
    total = grams.filter("size = 1").agg(F.sum("n").alias("t")).first()["t"]
    if not total:
        return {}
    cuts = grams.filter("size > 1").select("gram", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    cuts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("at")).alias("a"), F.substring(F.col("gram"), F.col("at") + 1, F.lit(longest)).alias("b"))
    part = lambda c: grams.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    # Parts of a gram occur at least as often as itself, so both joins find them.
    bound = cuts.join(part("a"), "a").join(part("b"), "b").groupBy("gram").agg(F.first("n").alias("n"), F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("c"))
    words = grams.filter("size = 1").select("gram", "n").unionByName(bound.filter(F.col("c") >= cohesion).select("gram", "n"))
    rows = words.orderBy(F.desc("n"), "gram").limit(size).collect()
    weight = sum(r["n"] for r in rows)
    return {r["gram"]: -math.log(r["n"] / weight) for r in rows}


#: Costs are compared as whole numbers of this part of one, so that equal sums are equal.
UNIT = 1_000_000


def _prices(costs: dict[str, float]) -> tuple[dict[str, int], int]:
    """The costs as whole numbers, and that of an unknown character."""
    prices = {w: round(c * UNIT) for w, c in costs.items()}
    return prices, max(prices.values(), default=0) + UNIT


def _path(run: str, prices: dict[str, int], unknown: int, longest: int) -> list[str]:
    n = len(run)
    total, words, step = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    # From the end on, so that ties go by the first words, the longer ones first.
    for i in range(n - 1, -1, -1):
        best, fewest, chosen = (unknown if run[i] not in prices else 1 << 62) + total[i + 1], words[i + 1] + 1, 0
        for k in range(min(longest, n - i), 0, -1):
            price = prices.get(run[i : i + k])
            if price is None:
                continue
            cost = price + total[i + k]
            if cost < best or cost == best and (words[i + k] + 1 < fewest or not chosen):
                best, fewest, chosen = cost, words[i + k] + 1, k
        total[i], words[i], step[i] = best, fewest, chosen or 1
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def _tree(prices: dict[str, int], longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The letters of the words and, for each length, the sorted keys (place of the string before among those of its length, letter) of what words begin with, and their prices, -1 for what is no word."""
    letters = sorted({c for w in prices for c in w})
    number = {c: i for i, c in enumerate(letters)}
    levels, above = [], {"": 0}
    for k in range(1, longest + 1):
        keys = {w: above[w[:-1]] * len(letters) + number[w[-1]] for w in {w[:k] for w in prices if len(w) >= k}}
        order = sorted(keys, key=keys.get)
        levels.append((np.array([keys[w] for w in order], np.int64), np.array([prices.get(w, -1) for w in order], np.int64)))
        above = {w: i for i, w in enumerate(order)}
    return np.array([ord(c) for c in letters], np.int64), levels


def _place(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x is in a sorted array, and whether it is."""
    at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
    return at, (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool)


def _paths(runs: list[str], tree: tuple, unknown: int, longest: int) -> list[list[str]]:
    """_path() of many runs at once, all from their ends on; the tree is that of the prices."""
    letters, levels = tree
    size = np.array([len(r) for r in runs], np.int64)
    order = np.argsort(-size, kind="stable")
    end = np.cumsum(size)[order]
    letter, known = _place(letters, np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64))
    price = np.full((longest, len(letter)), -1, np.int64)
    at, node = np.arange(len(letter)), np.zeros(len(letter), np.int64)
    for k, (keys, prices) in enumerate(levels):
        more = at + k < len(letter)
        more[more] = known[at[more] + k]
        at, node = at[more], node[more]
        node, is_there = _place(keys, node * len(letters) + letter[at + k])
        at, node = at[is_there], node[is_there]
        price[k, at] = prices[node]
    top = int(size.max())
    total, words, step = (np.zeros((top + 1, len(runs)), t) for t in (np.int64, np.int32, np.uint8))
    alive = np.searchsorted(-size[order], -np.arange(top + 1), "right")
    for j in range(1, top + 1):
        m = alive[j]
        i = end[:m] - j
        best, fewest, chosen = np.where(price[0, i] < 0, unknown + total[j - 1, :m], 1 << 62), words[j - 1, :m] + 1, np.zeros(m, np.uint8)
        for k in range(min(longest, j), 0, -1):
            p, n = price[k - 1, i], words[j - k, :m] + 1
            cost = p + total[j - k, :m]
            use = (p >= 0) & ((cost < best) | (cost == best) & ((n < fewest) | (chosen == 0)))
            best, fewest, chosen = np.where(use, cost, best), np.where(use, n, fewest), np.where(use, np.uint8(k), chosen)
        total[j, :m], words[j, :m], step[j, :m] = best, fewest, np.maximum(chosen, 1)
    out: list[list[str]] = [[]] * len(runs)
    for r, steps in zip(order.tolist(), np.ascontiguousarray(step.T), strict=True):
        run, steps, i, found = runs[r], steps.tobytes(), 0, []
        n = len(run)
        while i < n:
            found.append(run[i : i + steps[n - i]])
            i += steps[n - i]
        out[r] = found
    return out


def best_path(run: str, costs: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The words of a run whose costs add up to the least; of equal sums the path of fewer words, then that of longer first words. An unknown character is a word that costs more than any known one."""
    return _path(run, *_prices(costs), longest)


def segmented(docs: DataFrame, costs: dict[str, float], key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """key, tokens: runs of Chinese or Korean characters by their best path, other runs of letters and digits whole and in lower case.

    A null or empty text has no tokens; rows stay rows, and other columns are not read.
    """
    pattern = re.compile(f"[{HAN}]+|[{HANGUL}]+|[^\\W_{HAN}{HANGUL}]+")
    own = re.compile(f"[{HAN}{HANGUL}]")

    prices, unknown = _prices(costs)

    def run(batches):
        tree = _tree(prices, longest)
        for b in batches:
            # The words of a whole batch of texts, as Python's strings, would be many times its size.
            for i in range(0, b.num_rows, SLICE):
                found = [pattern.findall(t or "") for t in b.column(1).slice(i, SLICE).to_pylist()]
                runs = sorted({m for ms in found for m in ms if len(m) <= SHORT and own.match(m)}, key=len)
                paths: dict[str, list[str]] = {}
                for r in range(0, len(runs), RUNS):
                    paths |= zip(runs[r : r + RUNS], _paths(runs[r : r + RUNS], tree, unknown, longest), strict=True)
                out = [[w for m in ms for w in (paths.get(m) or (_path(m, prices, unknown, longest) if own.match(m) else [m.lower()]))] for ms in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, SLICE), pa.array(out, pa.list_(pa.string()))], [key, "tokens"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, tokens array<string>")
