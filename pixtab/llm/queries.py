"""The operators of this package as queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixtab.llm import bpe, lexical, lines, packing, pii, quality, ring, runs, secrets, simhash, topk, toxicity, urls


def tokenizer(name: str) -> str:
    """A public tokenizer file's place on this machine; the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": lambda s, d: topk.op1_topk(table(s, d, "embeddings")),
    "op2_toxicity": lambda s, d: toxicity.op2_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op3_secrets": lambda s, d: secrets.op3_secrets(table(s, d, "documents")),
    "op4_simhash": lambda s, d: simhash.op4_simhash(table(s, d, "documents")),
    "op5_urls": lambda s, d: urls.op5_urls(table(s, d, "pages")),
    "op6_bpe": lambda s, d: bpe.op6_bpe(table(s, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op7_quality": lambda s, d: quality.op7_quality(table(s, d, "documents")),
    "op8_lines": lambda s, d: lines.op8_lines(table(s, d, "documents")),
    "op9_pii": lambda s, d: pii.op9_pii(table(s, d, "documents")),
    "op10_packing": lambda s, d: packing.op10_packing(table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op11_ring": lambda s, d: ring.op11_ring(table(s, d, "documents")),
    "op12_lexical": lambda s, d: lexical.op12_lexical(table(s, d, "documents"), table(s, d, "benchmark")),
    "op13_runs": lambda s, d: runs.op13_runs(table(s, d, "documents")),
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op7_quality": quality.ORACLE, "op12_lexical": lexical.ORACLE}
