"""Byte-level BPE with a priority queue of merges over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pixtab.llm.arrow import map_rows, per_worker

#: Entries of one cache, and the longest key kept; a full cache is emptied.
CACHE, KEY = 600_000, 48


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.vocab = vocab
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        of = {c: b for b, c in byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.strings[i] = bytes(of[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.first, self.later = Pieces(self.encode_plain, ""), Pieces(self.encode_plain, " ")

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair has a rank.

        Symbols are a doubly linked list by position. The queue may hold pairs that no longer exist: an
        entry is stale, and skipped, if its left symbol has gone or its pair is not what it was.
        """
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1)
                 if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((made, symbols[k])):
                    heapq.heappush(queue, (r[0], i, made, symbols[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], made))):
                heapq.heappush(queue, (r[0], h, symbols[h], made, r[1]))
        return [s for s in symbols if s >= 0]

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
        out = []
        for word, _ in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                ids = packed(self.merge([self.vocab[c] for c in word]))
                if len(word) <= KEY:
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; special tokens written out in it are found first."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(packed([self.special[p]]) if p in self.special else self.encode_run(p) for p in self.cut.split(text) if p)
        return self.encode_run(text) if text else b""

    def encode_run(self, text: str) -> bytes:
        pieces = text.split(" ")
        try:
            return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))
        except Ragged:
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
            return self.encode_plain(first) + b"".join(self.encode_plain(" " + p) for p in rest)

    def decode(self, ids: bytes) -> str:
        """The text of ids: vocabulary strings put together, read as UTF-8."""
        strings = self.strings
        return b"".join([strings[i] for i in unpacked(ids)]).decode("utf-8", "replace")


class Ragged(Exception):
    """A piece begins or ends with white space, so cutting at single spaces does not hold."""


class Pieces(dict):
    """Ids of pieces between single spaces. Words never span such a cut, so each piece is encoded by itself."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Ragged
        ids = self.encode(self.prefix + piece)
        if len(piece) <= KEY:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("an unsigned int of 4 bytes is needed")
    return out.tobytes()


def unpacked(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    return out


def loaded(path: str) -> Bpe:
    """One for each Python worker; the file is read where the tokenizer libraries are installed."""
    return per_worker(("Bpe", path), lambda: Bpe(path))


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (ARRAY<BIGINT>) and ``decoded`` for each row of ``docs``.

    Null text counts as empty and has no ids. A special token's string in a text is that token. Rows
    stand for themselves: null ids and repeated rows are kept, an empty table gives an empty result,
    columns not kept are not read. A long text is encoded whole, its words one after the other; a single
    word of any length takes n log n steps.
    """
    def make():
        bpe = loaded(path)

        def one(body, *kept) -> Iterator[tuple]:
            ids = bpe.encode(body or "")
            yield (*kept, list(unpacked(ids)), bpe.decode(ids))
        return one
    shape = docs.select(*keep).schema.add("ids", ArrayType(LongType())).add("decoded", "string")
    return map_rows(docs.select(F.col(text).alias("_text"), *keep), make, shape)


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and digests of what ``encoded`` gives; ids and texts do not leave the task."""
    def make():
        bpe = loaded(path)

        def one(body, *kept) -> Iterator[tuple]:
            ids = bpe.encode(body or "")
            yield (*kept, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return one
    shape = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_rows(docs.select(F.col(text).alias("_text"), *keep), make, shape)


def op6_bpe(docs: DataFrame, path: str) -> DataFrame:
    return digests(docs, path)
