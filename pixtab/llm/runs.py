"""Periodic runs of words in a text: seeds on diagonals, extended once for each lag."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixtab.llm.arrow import map_rows

#: Least words of a run, and words of the shortest seed: no run has a shorter overlap with itself.
LEAST, SEED = 12, 6
#: From this lag on, seeds that are periodic in themselves are left to the runs that they lie in.
SPARSE = 32
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def overlap(period: int) -> int:
    """Least length of a run's overlap with itself moved by its period."""
    return max(LEAST - period, period)


def bands(n: int) -> Iterator[tuple[int, int, int]]:
    """``(least lag, lag after the last, words of a seed)``: every run with a lag of the band overlaps itself by a seed."""
    lo = 1
    while 2 * lo <= n:
        hi = min(2 * lo, n // 2 + 1)
        yield lo, hi, lo if lo >= LEAST else min(map(overlap, range(lo, hi)))
        lo *= 2


class Grams:
    """64-bit hashes of k words, for any k; equal grams have equal hashes, the rest is checked word by word."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        if words.size >= Grams.powers.size:
            n = 1 << int(words.size).bit_length()
            Grams.powers, Grams.inverses = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
                                            for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        h = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((h ^ (h >> np.uint64(32))) * Grams.powers[:words.size])])

    def at(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Of the grams that begin at ``lo`` and before ``hi`` (default: all)."""
        hi = self.sums.size - k if hi is None else hi
        return (self.sums[lo + k:hi + k] - self.sums[lo:hi]) * Grams.inverses[lo:hi]


def seeds(grams: np.ndarray, places: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows ``(lag, place)``, in order, of equal grams at ``place`` and ``place + lag`` with a lag of the band.

    Occurrences are met with the next one, the one after that and so on while they are near enough. Of places in a
    row with the same lag only the first is kept: the others lie on its diagonal.
    """
    order = np.argsort(grams, kind="stable")
    key, pos, out, d = grams[order], places[order], [], 0
    here = np.arange(pos.size)
    while here.size:
        d += 1
        here = here[here + d < pos.size]
        lag = pos[here + d] - pos[here]
        near = (key[here + d] == key[here]) & (lag < hi)
        here, lag = here[near], lag[near]
        far = lag >= lo
        i, q = pos[here][far], lag[far]
        if i.size:
            by = np.lexsort((i, q))
            i, q = i[by], q[by]
            first = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)])
            out.append(np.stack([q[first], i[first]], axis=1))
    if not out:
        return np.empty((0, 2), np.int64)
    both = np.concatenate(out)
    return both[np.lexsort((both[:, 1], both[:, 0]))]


def forward(w: np.ndarray, i: int, q: int) -> int:
    """The first place from ``i`` on whose word differs from that ``q`` further on, or has none there."""
    n, size = w.size - q, 64
    while i < n:
        m = min(size, n - i)
        off = np.flatnonzero(w[i:i + m] != w[i + q:i + q + m])
        if off.size:
            return i + int(off[0])
        i, size = i + m, min(2 * size, 1 << 16)
    return max(n, i)


def backward(w: np.ndarray, i: int, q: int) -> int:
    """The least place from which on all words before ``i`` are those ``q`` further on."""
    size = 64
    while i > 0:
        m = min(size, i)
        off = np.flatnonzero(w[i - m:i] != w[i - m + q:i + q])
        if off.size:
            return i - m + int(off[-1]) + 1
        i, size = i - m, min(2 * size, 1 << 16)
    return 0


def touching(grams: Grams, own: list[tuple[int, int]], p: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """``(lag, from, to)`` on diagonals that lead from one run of period ``p`` into the next one, which it touches.

    There all seeds are periodic in themselves. The two runs have the same words in turn at a fixed phase, so the
    lags are known at once, and each of them is that of a run of its own.
    """
    for (b1, e1), (b2, e2) in zip(own, own[1:], strict=False):
        most = min(hi, min(e1 - b1, e2 - b2) + p + 1)
        if e1 < b2 or most <= lo:
            continue
        turn = np.flatnonzero(grams.at(p, b1, b1 + p) == grams.at(p, b2, b2 + 1)[0])
        if turn.size:
            phase = b2 - b1 - int(turn[0])
            for q in range(lo + (phase - lo) % p, most, p):
                a, b = max(b1, b2 - q), min(e1, e2 - q)
                if b - a >= q:
                    yield q, a, b


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs among the word numbers ``w``, by start, then period.

    For each band of lags, grams of the least guaranteed overlap are indexed and occurrences in the band's reach are
    paired; a seed is extended word by word both ways unless the table of its lag says that it is covered already.
    Smaller lags come first, so a stretch gets its smallest period. A seed that repeats itself with a period of
    at most half its length occurs too often to be paired: all runs of such periods are known by then, and a diagonal
    that has no other seed leads from one of them into the next (see ``touching``).
    """
    n = w.size
    if n < LEAST:
        return []
    grams = Grams(w)
    short = grams.at(SEED)
    order = np.argsort(short, kind="stable")
    same = short[order[1:]] == short[order[:-1]]
    if not same.any():
        return []
    places = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])  # all longer seeds begin there
    found: dict[tuple[int, int], int] = {}
    for lo, hi, k in bands(n):
        at = places[places <= n - k]
        diagonals: list[tuple[int, int, int]] = []
        if lo >= SPARSE:
            inside, by_period = np.zeros(n + 1, np.int64), defaultdict(list)
            for (b, e), p in found.items():
                if 2 * p <= k <= e - b:
                    inside[b] += 1
                    inside[e - k + 1] -= 1
                    by_period[p].append((b, e))
            at = at[np.cumsum(inside)[at] == 0]
            diagonals = [x for p, own in by_period.items() for x in touching(grams, sorted(own), p, lo, hi)]
        covered: dict[int, int] = {}
        for q, i in seeds(grams.at(k)[at], at, lo, hi).tolist():
            if i >= covered.get(q, 0):
                diagonals.append((q, i, i))
                covered[q] = forward(w, i, q)
        for q, a, b in sorted(diagonals):
            a, b = backward(w, a, q), forward(w, b, q)
            if b - a >= overlap(q):
                found.setdefault((a, b + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(n: int, own: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    inside = np.zeros(n + 1, np.int64)
    for start, length, period in own:
        inside[start + period] += 1
        inside[start + length] -= 1
    return np.cumsum(inside[:-1]) == 0


def collapse_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  prepare: Callable[..., list[bytes]] | None = None) -> DataFrame:
    """``keep`` columns, ``runs`` (array of start, length, period) and ``collapsed`` text, a row for each row of ``docs``.

    Words are split at ASCII white space and compared as they are. Runs are maximal stretches with smallest period q
    of at least LEAST words and two periods; of each, the first period stays in the collapsed text, whose words are
    joined by one space. Whole texts are searched, with memory and time in proportion to their words (times the
    logarithm of their number). ``prepare(words, *kept)`` may change the words first. Null and empty texts have no runs and an empty
    collapsed text; null ids and repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    def make():
        def one(body, *kept_columns) -> Iterator[tuple]:
            words = (body or b"").split()
            if prepare:
                words = prepare(words, *kept_columns)
            numbers: dict[bytes, int] = {}
            own = runs(np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words)))
            left = [words[i] for i in np.flatnonzero(kept(len(words), own)).tolist()] if own else words
            yield (*kept_columns, [dict(zip(("start", "length", "period"), r, strict=True)) for r in own], b" ".join(left))
        return one
    own_columns = StructType.fromDDL("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    shape = StructType([*docs.select(*keep).schema, *own_columns])
    out = map_rows(docs.select(F.col(text).cast("binary").alias("_text"), *keep), make, shape)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's change of one text in ten: from some word on, the words before the end repeat. Null ids change nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_runs(docs: DataFrame) -> DataFrame:
    own = collapse_runs(docs, prepare=repeated_tail)
    # The longest; of these the one that begins first, then that of the smallest period.
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    said: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = own.withColumn("_top", F.array_min(order))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), (-F.col("_top.n")).alias("length"),
                      F.col("_top.period").alias("period"), F.expr("(-1000 * _top.n) div _top.period").alias("exponent_milli"),
                      F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
