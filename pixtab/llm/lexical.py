"""Ranked lexical search: bundles of items carry sparse accumulators through the owners of terms, stage by stage."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixtab.functions.keys import salted_join
from pixtab.functions.lineage import ensure_checkpoint_dir, materialize
from pixtab.llm.arrow import map_rows, stored

#: Documents of a block and postings after which it is closed, and items of a bundle (about).
DOCS, POSTINGS, ITEMS = 1 << 14, 1 << 22, 256
#: A term that one document in 100 has, or fewer, belongs to the first owner; one in 10 to the second; others to the last.
SHARES = (100, 10)
#: Places of the filter that tells which terms the items have: a fixed size, whatever their number.
PLACES = 1 << 23
#: ASCII letters and digits and all bytes of other characters make terms, only A-Z are lower-cased; the rest separates.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM).split()


class Wanted(dict):
    """Whether some item may have a term: never wrong about one that has it."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        at = zlib.crc32(term) % PLACES
        if len(self) >= 1 << 20:
            self.clear()
        found = self[term] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """``(item, term, q)`` of ``items`` with their number ``item``."""
    def make():
        return lambda item, body: ((item, t.decode(), q) for t, q in Counter(terms(body)).items())
    return map_rows(items.select("item", F.col(text).cast("binary")), make, "item long, term string, q long")


def term_bits(asked: DataFrame) -> bytes:
    """The filter of PLACES bits, 1 MB that passes through the driver whatever the items."""
    place = F.crc32("term") % PLACES + 1  # bitmaps count from 1
    found = asked.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(PLACES // 8)
    for r in found:
        out[(r["bucket"] - 1) << 12:r["bucket"] << 12] = r["bits"]
    return bytes(out)


def inverted(docs: DataFrame, text: str, id_col: str, bits: bytes) -> DataFrame:
    """Blocks of documents, inverted in the task that reads them: ``(block, term, df, n, places, counts, ids)``.

    A row for each term that the items may have: its documents (places in the block) and how often they have it. The row without
    a term has all ids of the block, in ``places`` the numbers of terms of its documents, in ``df`` how many have any, in ``n`` their sum.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = StructType.fromDDL(f"block long, term string, df long, n long, places binary, counts binary, ids array<{kind}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, wanted = to_arrow_schema(shape), Wanted(bits)
        block, ids, sizes, lists, held = TaskContext.get().partitionId() << 32, [], array("q"), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(block, None, sum(n > 0 for n in sizes), sum(sizes), sizes.tobytes(), b"", ids)]
            for t, (places, counts) in lists.items():
                rows.append((block, t.decode(), len(places), sum(counts), places.tobytes(), counts.tobytes(), None))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms(body.as_py())
                for t, n in Counter(words).items():
                    if wanted[t]:
                        if t not in lists:
                            lists[t] = array("i"), array("i")
                        lists[t][0].append(len(ids))
                        lists[t][1].append(n)
                        held += 1
                ids.append(i)
                sizes.append(len(words))
                if len(ids) == DOCS or held >= POSTINGS:
                    yield from flush()
                    block, ids, sizes, lists, held = block + 1, [], array("q"), {}, 0
        if ids:
            yield from flush()

    return docs.select(id_col, F.col(text).cast("binary")).mapInArrow(run, shape)


def lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer that grows with a document's number of terms and stands below the fraction of its contributions."""
    if 25 * int(sizes.max(initial=0)) * n_docs < 1 << 62:
        return 75 + 25 * sizes * n_docs // n_terms
    return np.array([75 + 25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)


class Accumulators:
    """Scores of a bundle's items in one block of documents."""

    def __init__(self, bundle: pa.Table, n_docs: int, n_terms: int):
        row = {c: bundle.column(c)[0].as_py() for c in ("sizes", "item", "place", "score")}
        self.m = lengths(np.frombuffer(row["sizes"], np.int64), n_docs, n_terms)
        self.rows: dict[int, np.ndarray] = {}
        item, place, score = (np.frombuffer(row[c], t) for c, t in (("item", np.int64), ("place", np.int32), ("score", np.int64)))
        cuts = np.flatnonzero(np.diff(item)) + 1
        for i, p, s in zip(*(np.split(x, cuts) for x in (item, place, score)), strict=True):
            if i.size:
                self.of(int(i[0]))[p] = s

    def of(self, item: int) -> np.ndarray:
        if item not in self.rows:
            self.rows[item] = np.zeros(self.m.size, np.int64)
        return self.rows[item]

    def add(self, lists: pa.Table) -> None:
        """The contributions of the terms of one owner: ``(w, items, places, counts)``."""
        for w, items, places, counts in zip(*(lists.column(c) for c in ("w", "items", "places", "counts")), strict=True):
            at, tf = np.frombuffer(places.as_py(), np.int32), np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
            one = w.as_py() * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[at]))
            for x in items.as_py():
                self.of(x["item"])[at] += x["q"] * one  # a document is in a list once

    def sparse(self) -> dict[str, bytes]:
        own = [(i, np.flatnonzero(s)) for i, s in self.rows.items()]
        return {"item": b"".join(np.full(p.size, i, np.int64).tobytes() for i, p in own), "place": b"".join(p.astype(np.int32).tobytes() for _, p in own),
                "score": b"".join(self.rows[i][p].tobytes() for i, p in own)}

    def best(self, ids: list, k: int) -> Iterator[tuple]:
        """``(item, id, score)`` of the ``k`` best of each item; equal scores by id, null ids last."""
        for item, score in self.rows.items():
            at = np.flatnonzero(score)
            if at.size > k:
                at = at[score[at] >= np.partition(score[at], at.size - k)[at.size - k]]
            own = sorted((-int(score[p]), ids[p] is None, ids[p] if ids[p] is not None else 0) for p in at.tolist())
            yield from ((item, None if none else i, -s) for s, none, i in own[:k])


def search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(item_id, rank, id, score)``: the ``k`` best documents with a score above 0 for every row of ``items``.

    Terms, weights and scores are those of the query below, in 64-bit integers. Documents are inverted block by block where they are
    read; lists go to the owners of their terms, who have the rare terms, the middle ones and the frequent ones. Each bundle of items
    visits the owners in that order for each block, so it carries few documents as long as it can: at every stage its accumulators are
    cogrouped with the owner's lists of the block, and the last owner sends on the best of the block. A block is bounded by documents and
    postings, a bundle by items (more items make more bundles), so the size of a group does not depend on how frequent a term is.

    Null and empty texts have no terms; they are in no result. Repeated rows are documents, and items, of their own. Equal
    scores go by id, null ids last. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    asked_of = materialize(items.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_text")))
    asked_of = asked_of.withColumn("item", F.monotonically_increasing_id())  # of stored rows: the same each time
    asked = materialize(item_terms(asked_of, "_text"))
    bundles = max(1, -(-asked_of.count() // ITEMS))
    index = stored(inverted(docs, text, id_col, term_bits(asked)))
    blocks, lists = index.where("term is null"), index.where("term is not null")
    n_docs, n_terms = (x or 0 for x in blocks.agg(F.sum("df"), F.sum("n")).first())

    known = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum((F.col("df") * share > n_docs).cast("int") for share in SHARES)
    orders = asked.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int")).groupBy("bundle", "term").agg(
        F.collect_list(F.struct("item", "q")).alias("items")).join(known, "term").select("term", "bundle", "items", weight.alias("w"), owner.alias("owner"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/lists-{uuid.uuid4().hex}"
    salted_join(lists.select("block", "term", "places", "counts"), orders, ["term"], by=("block",)).select(
        "block", "bundle", "w", "items", "places", "counts", "owner").write.partitionBy("owner").parquet(path)
    owned = spark.read.schema("block long, bundle int, w long, items array<struct<item: long, q: long>>, places binary, counts binary, owner int").parquet(path)

    none = F.lit(b"")
    carried = blocks.where("df > 0").select("block", F.explode(F.array(*[F.lit(b) for b in range(bundles)])).alias("bundle"), F.col("places").alias("sizes"), "ids",
                                            none.alias("item"), none.alias("place"), none.alias("score"))
    shape = carried.schema
    last = StructType.fromDDL(f"item long, id {docs.schema[id_col].dataType.simpleString()}, score long")

    def visit(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        if not bundle.num_rows or not owned.num_rows:
            return bundle
        own = Accumulators(bundle, n_docs, n_terms)
        own.add(owned)
        for c, data in own.sparse().items():
            bundle = bundle.set_column(bundle.column_names.index(c), bundle.schema.field(c), pa.array([data], pa.binary()))
        return bundle

    def leave(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        out, rows = to_arrow_schema(last), []
        if bundle.num_rows:
            own = Accumulators(bundle, n_docs, n_terms)
            own.add(owned)
            rows = list(own.best(bundle.column("ids")[0].as_py(), k))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    for stage in range(len(SHARES) + 1):
        at_end = stage == len(SHARES)
        mine = owned.where(F.col("owner") == stage).drop("owner")
        carried = carried.groupBy("block", "bundle").cogroup(mine.groupBy("block", "bundle")).applyInArrow(leave if at_end else visit, last if at_end else shape)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = carried.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked_of.select("item", "_id"), "item").select(F.col("_id").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def op12_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
sizes AS (SELECT r, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
m AS (SELECT r, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, whole),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
