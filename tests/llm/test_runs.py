import hashlib
import random
import time
import zlib

import numpy as np
from helpers import awkward, awkward_texts, nothing, rows_of

from pixtab.llm import runs


def brute_runs(w):
    """The definition: for each period the maximal stretches; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        a = 0
        for i in range(len(w) - q + 1):
            if i == len(w) - q or w[i] != w[i + q]:
                if i - a + q >= max(12, 2 * q):
                    found.setdefault((a, i + q), q)
                a = i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(r):
    yield [0] * 12
    yield [0] * 11
    yield [0] * 300
    yield [0, 1] * 60 + [1, 0] * 60
    yield [0, 0, 1] * 40 + [0, 1, 0] * 40 + [0, 0, 1] * 40
    yield ([0] * 40 + [1]) * 5
    yield ([0] * 40 + [1] + [0] * 40 + [2]) * 4
    u = [r.randrange(3) for _ in range(70)]
    yield u * 2 + u[:69]
    yield [9] + u + u + [8]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    for n in (12, 13, 20, 40, 90, 200, 333):
        for letters in (1, 2, 3, 8):
            yield [r.randrange(letters) for _ in range(n)]
    for _ in range(60):
        w = []
        while len(w) < 260:
            u = [r.randrange(2) for _ in range(r.choice([1, 2, 3, 5, 8, 20, 37, 64]))]
            w += u * r.randint(1, 2 + 80 // len(u)) + u[:r.randrange(len(u))]
        if r.random() < 0.5:
            w = w[:150] * 2
        yield w


def test_runs_as_defined():
    r = random.Random(11)
    for w in texts(r):
        assert runs.runs(np.array(w, np.int64)) == brute_runs(w), w


def test_touching_runs_of_one_period():
    for p, m in ((1, 80), (2, 60), (3, 60), (7, 20)):
        u = list(range(p))
        for shift in range(p):
            w = u * m + u[shift:] + u * m + [5] * 3 + u * m
            assert runs.runs(np.array(w, np.int64)) == brute_runs(w)


def test_long_repetitive_texts_take_time_in_proportion():
    for w in (np.zeros(400_000, np.int64), np.tile(np.r_[np.zeros(999, np.int64), 1], 300), np.tile(np.arange(70_000), 4)):
        t = time.process_time()
        assert len(runs.runs(w)) >= 1
        assert time.process_time() - t < 20


def plain(i, t):
    words = (t or "").encode().split()
    words = runs.repeated_tail(words, i)
    own = brute_runs(words)
    gone = {k for s, n, q in own for k in range(s + q, s + n)}
    top = min(own, key=lambda x: (-x[1], x[0], x[2])) if own else (None,) * 3
    return (i, len(own), *top, None if not own else 1000 * top[1] // top[2], hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in own).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(words) if k not in gone)).hexdigest())


def test_query_on_awkward_rows(spark):
    r = random.Random(5)
    own = [(i, t) for i, t in awkward_texts() if len(t or "") < 100_000]
    own += [(100 + k, " ".join(r.choice("abc") for _ in range(150))) for k in range(60)]
    docs = spark.createDataFrame(own, "doc_id long, text string").selectExpr("doc_id", "text", "1 as runs", "2 as collapsed", "3 as _text")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    out = runs.op13_runs(docs)
    assert out.columns == list(columns)
    assert dict(out.dtypes) == dict.fromkeys(columns[:6], "bigint") | dict.fromkeys(columns[6:], "string")
    assert rows_of(out, *columns) == sorted((plain(i, t) for i, t in own), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in own)
    assert runs.op13_runs(awkward(spark)).count() == len(awkward_texts()) and runs.op13_runs(nothing(spark)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "go " + "a b c " * 5 + "end"), (2, "x y")], "doc_id long, text string")
    assert rows_of(runs.collapse_runs(docs), "doc_id", "collapsed") == [(1, "go a b c end"), (2, "x y")]
