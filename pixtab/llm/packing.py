"""Packing token sequences by bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import map_rows, per_worker
from pixtab.llm.bpe import KEY, packed

#: Tokens of a sequence, bins open at a time, sequences of a task, and the most tasks.
SIZE, OPEN, SEQUENCES, TASKS = 4096, 1024, 4096, 20_000
END, CACHE = 1, 600_000


class WordIds(dict):
    """Ids of a text between white space, from the tokenizer itself; white space separates words and is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = {c: self.ask(c) for c in ".,;:!?"}

    def ask(self, piece: str) -> bytes:
        return packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        # Letters are a word of their own beside a mark, and upper case is read as lower case (bar two
        # letters whose lower case depends on their place or is two characters): most new pieces are known so.
        if piece[-1:] in self.marks and piece[:-1].isalpha() and "\u0130" not in piece:
            ids = self[piece[:-1]] + self.marks[piece[-1]]
        elif piece.isalpha() and piece != (low := piece.lower()) and "\u03a3" not in piece and "\u0130" not in piece:
            ids = self[low]
        else:
            ids = self.ask(piece)
        if len(piece) <= KEY:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def loaded(path: str) -> WordIds:
    """One for each Python worker."""
    return per_worker(("WordIds", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SIZE,
           end: int = END) -> DataFrame:
    """``keep`` columns, ``piece``, ``start``, ``length`` and ``ids_crc32`` for every piece of every row of ``docs``.

    A document is its ids and then ``end``; only longer ones than ``size`` are cut. Ids stay in the task.
    """
    def make():
        words = loaded(path)
        last = packed([end])

        def one(body, *kept) -> Iterator[tuple]:
            ids = words.encode(body or "") + last
            for i, lo in enumerate(range(0, len(ids), 4 * size)):
                own = ids[lo:lo + 4 * size]
                yield (*kept, i, lo // 4, len(own) // 4, zlib.crc32(own))
        return one
    shape = docs.select(*keep).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        shape = shape.add(name, kind)
    return map_rows(docs.select(F.col(text).alias("_text"), *keep), make, shape)


class Bins:
    """Open bins by free space: bit f of ``mask`` is set if some bin has f free."""

    def __init__(self, size: int = SIZE, limit: int = OPEN):
        self.size, self.limit, self.mask, self.open, self.made = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        out = own.pop()
        if not own:
            self.mask &= ~(1 << free)
        self.open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset for an item: the fullest open bin that has room, else a new bin.

        With ``limit`` bins open, the fullest is closed before another is opened.
        """
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
        return number, self.size - free


def pack(items: DataFrame, size: int = SIZE, limit: int = OPEN) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; ``length`` is at most ``size``.

    Items are dealt evenly to tasks without a key, so no value can be hot, and each task packs its own
    stream with ``limit`` open bins: memory does not grow with the stream. The number of tasks follows
    the tokens: about ``SEQUENCES`` sequences each, so that bins left open at a stream's end are few.
    Items of length 0 are not expected; repeated rows are items of their own; no items give no rows.
    """
    items = materialize(items)
    total = items.agg(F.sum("length")).first()[0] or 0
    n = max(1, min(TASKS, total // (size * SEQUENCES)))
    shape = StructType(items.schema.fields).add("sequence_id", "long").add("offset", "long")
    at = items.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, first = Bins(size, limit), TaskContext.get().partitionId() << 40
        out = to_arrow_schema(shape)
        for b in batches:
            put = [own.put(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([first + x for x, _ in put], pa.int64()),
                                              pa.array([x for _, x in put], pa.int64())], schema=out)

    return items.repartition(n).mapInArrow(run, shape)


def op10_packing(docs: DataFrame, path: str) -> DataFrame:
    """Null text is empty: only the end id. Null doc_ids and repeated rows are documents of their own."""
    return pack(pieces(docs, path))
