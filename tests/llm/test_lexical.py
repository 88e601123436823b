import math
import random
import re
from collections import Counter

from helpers import awkward, awkward_texts, nothing, rows_of

from pixtab.llm import lexical

COLUMNS = ("item_id", "rank", "doc_id", "score")
PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items, k=20):
    def terms(t):
        return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            if c:
                m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def tables(r):
    words = [f"w{i}" for i in range(40)] + ["É", "漢字", "x9"]
    docs = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.randint(1, 60)))) for i in range(300)]
    items = [(i, ", ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(30)]
    return docs + docs[:5] + [(None, "w30 w31"), (None, "w30 w31")], items + [items[0], (99, None), (98, "?!"), (97, "nowhere"), (None, "W3 w3 É")]


def test_search_as_defined(spark, monkeypatch):
    docs, items = tables(random.Random(3))
    d, i = (spark.createDataFrame(x, f"{n} long, text string").repartition(3) for x, n in ((docs, "doc_id"), (items, "item_id")))
    out = lexical.op12_lexical(d, i)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"} and out.columns == list(COLUMNS)
    assert rows_of(out, *COLUMNS) == brute(docs, items)
    # Small blocks, more bundles and other owners: the same result.
    monkeypatch.setattr(lexical, "DOCS", 7)
    monkeypatch.setattr(lexical, "ITEMS", 6)
    monkeypatch.setattr(lexical, "SHARES", (50, 20, 5, 2))
    assert rows_of(lexical.search(d, i, k=3), *COLUMNS) == brute(docs, items, 3)


def test_equal_scores_and_awkward_rows(spark):
    docs = awkward_texts()
    items = [(1, "a b c"), (2, docs[0][1]), (3, "ñandú 漢字 al"), (4, "")]
    i = spark.createDataFrame([(*x, 1, "t", 2) for x in items], "item_id long, text string, item long, term string, score long")
    assert rows_of(lexical.op12_lexical(awkward(spark), i), *COLUMNS) == brute(docs, items)
    assert lexical.op12_lexical(nothing(spark), i).count() == 0
    assert lexical.op12_lexical(awkward(spark), i.limit(0)).count() == 0


def test_lengths_do_not_overflow():
    import numpy as np
    n = np.array([3, 10_000_000], np.int64)
    assert lexical.lengths(n, 10**12, 10**15).tolist() == [75, 75 + 250_000]


def test_the_filter_never_misses(spark):
    asked = spark.range(20_000).selectExpr("concat('t', id) as term")
    wanted = lexical.Wanted(lexical.term_bits(asked))
    assert all(wanted[f"t{i}".encode()] for i in range(20_000)) and sum(wanted[f"u{i}".encode()] for i in range(20_000)) < 200
