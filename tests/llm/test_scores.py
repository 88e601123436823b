import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, awkward_texts, nothing, prose, rows_of

from pixtab.llm import quality, topk, toxicity


def plain_measures(text):
    import re
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words, lines = word.findall(text or ""), [x for x in (text or "").split("\n") if word.search(x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {k for own in at.values() if len(own) > 1 for i in own for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_measures():
    r = random.Random(8)
    texts = [t for _, t in awkward_texts()] + [" ".join(r.choice("ab#c") for _ in range(r.randint(0, 80))) + r.choice(["", "\n \n", "\nx y"]) for _ in range(300)]
    for t in texts:
        assert quality.measure(None if t is None else t.encode())[:5] == plain_measures(t)


def test_ledger_of_awkward_rows(spark):
    got = rows_of(quality.op7_quality(awkward(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

    def base(m):
        return m[0] < 20 or 100 * m[4] > 30 * m[0]
    assert got == sorted(((i, *plain_measures(t), base(plain_measures(t))) for i, t in awkward_texts()), key=repr)
    assert quality.op7_quality(nothing(spark)).count() == 0
    assert quality.keep_good(awkward(spark)).columns == awkward(spark).columns


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(0,), (0,), (1,), (4,), (5,), (256,)], "failed long")
    got = {(r["version"], r["rule"]): tuple(r)[2:] for r in quality.ablations(entries).collect()}
    assert got["base", "few_words"] == (2, 2, 4, 6)
    assert got["v1", "symbols"] == (2, 1, 3, 4) and got["v1", "few_words"] == (2, 1, 3, 4)
    assert got["v2", "endless_word"] == (1, 1, 2, 3)
    assert ("v1", "endless_word") not in got
    assert len({r.bit for r in quality.RULES}) == len(quality.RULES)


def test_junk_goes_and_prose_stays():
    def kept(t):
        m = dict(zip(quality.MEASURES, quality.measure(t.encode()), strict=True))
        bits = sum(1 << r.bit for r in quality.RULES if eval(r.fails, {}, m))  # noqa: S307
        return bits & quality.POLICIES[quality.CURRENT] == 0
    good = prose(9, 80)
    assert kept(good) and kept(good + "\nA list: 1. x 2. y (see & note)")
    assert not kept(" ".join(w.upper() + "!!" for w in good.split()))
    assert not kept(" ".join(w + "%%%" for w in good.split())) and not kept(" ".join([w for w in good.split() for _ in range(6)]))


def brute_top(vectors, queries, k):
    out = []
    for a, q in vectors.items():
        if queries(a):
            own = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), b) for b, v in vectors.items() if b != a and len(v) == len(q))[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(own)]
    return sorted(out)


def test_top_k_with_bad_vectors_ties_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 1) for i in range(200)]
    rows += [(200, rows[0][1], 1), (201, [0.0] * 6, 1), (250, [0.0] * 6, 1), (0, rows[0][1], 2), (300, None, 1), (301, [], 1),
             (302, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (303, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0], 1),
             (350, [float("inf")] + [1.0] * 5, 1), (None, [1.0] * 6, 1), (400, [0.5, 0.5], 1), (401, [0.5, -0.5], 1), (450, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    assert rows_of(topk.op1_topk(df), "query_id", "rank", "vec_id", "score") == sorted(brute_top(good, lambda a: a % 50 == 0, 5), key=repr)
    assert topk.op1_topk(df.where("vec_id < 0")).count() == 0


def test_small_blocks_and_strips_change_nothing(spark, monkeypatch):
    for name, n in (("BLOCK", 20), ("QUERIES", 3), ("HELD", 320)):
        monkeypatch.setattr(topk, name, n)
    r = np.random.default_rng(3)
    own = {i: [int(x) for x in r.integers(-90, 90, 8)] for i in range(300)}
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in own.items()], "vec_id long, embedding array<double>")
    assert rows_of(topk.op1_topk(df), "query_id", "rank", "vec_id", "score") == sorted(brute_top(own, lambda a: a % 50 == 0, 5), key=repr)


def test_vectors_move_once_and_queries_to_every_strip(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 4 * 20 * 6)
    df = spark.createDataFrame([(i, [float(i)] * (6 if i % 3 else 2)) for i in range(1500)], "vec_id long, embedding array<double>")
    own = topk.integer_vectors(df, "vec_id", "embedding")
    monkeypatch.setattr(topk, "BLOCK", 20)
    met = topk.strips(topk.in_blocks(own, 20), topk.in_blocks(own.where("id % 50 = 0"), 8)).collect()
    ids = sorted(i for r in met if not r.asks for i in r.ids)
    assert ids == list(range(1500))
    for dim in (2, 6):
        of = {s: sorted(i for r in met if r.asks and (r.dim, r.strip) == (dim, s) for i in r.ids)
              for s in {r.strip for r in met if r.dim == dim}}
        assert len(of) > 3 and all(v == [i for i in range(0, 1500, 50) if (i % 3 > 0) == (dim == 6)] for v in of.values())
        held = {s: sum(len(r.ids) * dim for r in met if not r.asks and (r.dim, r.strip) == (dim, s)) for s in of}
        assert max(held.values()) < 2 * topk.HELD


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_reading_lists_loses_no_member(scale):
    r = np.random.default_rng(2)
    x = r.integers(-100, 100, (300, 8)) * (scale if scale == 1 else 1 << 30)
    lists = topk.sorted_lists(x)
    for q in (r.integers(-100, 100, 8), np.zeros(8, np.int64), np.array([5, 0, 0, 0, 0, 0, 0, -3])):
        final = x @ q
        for bar in (-np.inf, float(np.sort(final)[-5])):
            live, scores = topk.read_lists(lists, q, bar, 5)
            assert (scores == final[live]).all() and set(np.flatnonzero(final > np.sort(final)[-5])) <= set(live)


def labelled(spark, n=600):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = prose(i, r.randint(20, 60)).split(" ")
        if bad:
            for _ in range(r.randint(2, 5)):
                words[r.randrange(len(words))] = r.choice(["idiot", "zorgled", "zorgling", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.op2_toxicity(docs, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["doc_id"] % 6 == 0, r["predicted"]) for r in got if r["held_out"]]
    right = sum(bool(p) == bad for bad, p in held)
    assert right >= 0.95 * len(held) and sum(p for bad, p in held if bad) >= 0.9 * sum(bad for bad, _ in held)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 300)
    held = toxicity.fold_of("doc_id") == 2
    flipped = labels.select("doc_id", toxicity.F.when(held, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")).alias("toxic"))
    one, two = (rows_of(toxicity.op2_toxicity(docs, x), "doc_id", "score") for x in (labels, flipped))
    assert one == two


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.op2_toxicity(docs, none).collect()
    assert len(got) == len(awkward_texts()) and all(r["score"] == 0 for r in got)
    assert toxicity.op2_toxicity(nothing(spark), none).count() == 0
    words = toxicity.Words({})
    for _, t in awkward_texts():
        assert len(toxicity.features(t, words)) == len(toxicity.FEATURES)
    assert SCHEMA
