import corpus_pipeline
from helpers import awkward, nothing, prose, rows_of

import __spark_entry__ as entry
from pixtab.llm import lines, packing, pii, quality, queries, shingles, simhash

WITH = ("doc_id", "text", "lang", "source", "n_chars")


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "surrogates", "best_fit_packing"]
    docs = spark.createDataFrame([(i, prose(i // 2, 60) + ("" if i % 2 else "\n" + prose(100 + i, 30) + f" mail x{i}@mail1.example.com"), "en", f"s{i}", 0)
                                  for i in range(12)] + [(50, "JUNK!! " * 40, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    df = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, df = df, stage(spark, df, "")
        if k < 4:
            assert df.columns == list(WITH)
            assert k == 0 or all(r["n_chars"] == len(r["text"]) for r in df.collect())
        if k == 0:
            assert rows_of(df, *WITH) == rows_of(quality.keep_good(before), *WITH) and df.where("doc_id = 50").count() == 0
        elif k == 1:
            assert rows_of(df, "doc_id", "text") == rows_of(lines.dedup_lines(before), "doc_id", "text")
        elif k == 2:
            assert rows_of(df, *WITH) == rows_of(simhash.one_of_each(before), *WITH)
        elif k == 3:
            assert rows_of(df, "doc_id", "text") == rows_of(pii.surrogate_texts(before), "doc_id", "text")
            assert "x0@mail1" not in str(df.collect())
        else:
            assert {r["doc_id"] for r in df.collect()} == {r["doc_id"] for r in before.collect()}


def test_awkward_rows_pass_through(spark):
    for docs in (awkward(spark), nothing(spark)):
        df = docs
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
        assert df.count() >= 0


def test_queries_are_registered():
    own = [n for n in entry.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in own} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES) and packing.SIZE == 4096


def test_near_dedup_has_the_links_of_the_simhash_operator(spark):
    texts = ["a b c " * 60 + "x1 x2 x3 x4 x5", "a b c " * 60 + "y1 y2 y3 y4 y5", prose(1, 80), prose(1, 80).upper()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert shingles.jaccard(shingles.shingles(texts[0].encode()), shingles.shingles(texts[1].encode())) < shingles.SIMILAR
    assert rows_of(simhash.one_of_each(docs), "doc_id") == rows_of(docs.where("doc_id IN (0, 2)"), "doc_id")
    assert rows_of(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id") == rows_of(docs.where("doc_id IN (0, 2)"), "doc_id")
