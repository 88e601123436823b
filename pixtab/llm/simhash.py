"""Near-duplicate documents by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import map_rows, rows_back, whole_rows
from pixtab.llm.hamming import as_hex, covering, links
from pixtab.llm.stars import min_roots

SHINGLE, RADIUS, SEED, BLOCK = 3, 3, 42, 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole UTF-8 text; 0 without a word.

    Hashes are counted in blocks of ``BLOCK`` shingles, so a long text needs no large table of bits.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), BLOCK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[lo:lo + BLOCK]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and BIGINT ``fp``, a row for each row of ``docs``."""
    def make():
        def one(body, *kept) -> Iterator[tuple]:
            yield (*kept, fingerprint(body))
        return one
    shape = docs.select(*keep).schema.add("fp", "long")
    return map_rows(docs.select(F.col(text).cast("binary").alias("_text"), *keep), make, shape)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row: the smallest id whose fingerprint is reachable by links.

    Words are split at ASCII white space; only A-Z are lower-cased. Equal texts are one fingerprint
    from the first step on, so copies cost one row each and nothing more. Null text counts as empty;
    texts without words share fingerprint 0 and are one component with whatever is near 0. A null id
    takes part but can't be a component's name (null only if the whole component has null ids);
    repeated rows give repeated results. An empty table gives an empty result. Other columns are not read.
    """
    own = materialize(fingerprints(docs, text, (id_col,)))
    nodes = materialize(own.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = min_roots(links(nodes.select("fp"), radius, covering)).withColumnRenamed("node", "fp")
    named = roots.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = named.join(least, "root").select("fp", "component_id")
    # Stored, so that the next join deals out both sides anew and can split a fingerprint with many copies.
    of = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return own.join(of, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, all columns.

    The row with the smallest id stays. Of rows that share that id, one stays: the smallest by its
    whole content, so the choice does not depend on the order of rows. Components whose ids are all
    null keep one row likewise.
    """
    # A row is named by its id and a hash of its content; equal rows share the name and are the same row.
    named = whole_rows(docs, body=F.col(text), id=F.col(id_col), name=F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")),
                       content=F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    own = materialize(fingerprints(named, "body", ("id", "name", "content")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "content", "name")
    nodes = materialize(own.groupBy("fp").agg(F.min(order).alias("first")))
    roots = min_roots(links(nodes.select("fp"), radius, covering)).withColumnRenamed("node", "fp")
    of = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = of.groupBy("root").agg(F.min("first").alias("first")).select("first.name", "first.content")
    out = named.select("_r", "name", "content").join(kept, ["name", "content"], "left_semi")
    return rows_back(out.dropDuplicates(["name", "content"]))


def op4_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
