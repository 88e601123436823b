import hashlib
import random
import struct
import zlib

import pytest
from helpers import BYTE_BPE, WORD_BPE, awkward, awkward_texts, nothing, rows_of
from tokenizers import Tokenizer

from pixtab.llm import bpe, packing


def odd_texts():
    r = random.Random(11)
    marks = " \n\t  '’.,!?-_ aAbéÉßñ漢字🙂éΣσİıDŽ0123٣\x1c\x85"
    yield from (t or "" for _, t in awkward_texts())
    yield from ("".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(1500))
    yield from ("I'm can't we'LL 'S 't''s", "WORD, Word. word! ΣΑΣ. İSTANBUL", "  lead", "trail  ", "a" * 70, "<|startoftext|> <|endoftext|>x")


def test_byte_bpe_equals_the_library():
    own, lib = bpe.Bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for t in odd_texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert list(bpe.unpacked(got)) == want, t[:80]
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False) == t


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own, lib = bpe.Bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    t = "the cat and the dog and the hen " * 5
    assert list(bpe.unpacked(own.encode(t))) == lib.encode(t, add_special_tokens=False).ids


def test_bpe_of_awkward_rows(spark):
    lib = Tokenizer.from_file(BYTE_BPE)

    def want(i, t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = rows_of(bpe.op6_bpe(awkward(spark), BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted((want(*x) for x in awkward_texts()), key=repr)
    assert bpe.encoded(awkward(spark), BYTE_BPE).where("size(ids) = 0").count() == 2
    assert bpe.op6_bpe(nothing(spark), BYTE_BPE).count() == 0


def test_words_equal_the_library():
    own, lib = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for t in odd_texts():
        assert list(bpe.unpacked(own.encode(t))) == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_packing_of_awkward_rows(spark):
    lib = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in awkward_texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            own = ids[p:p + 4096]
            want.append((i, p // 4096, p, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    out = packing.op10_packing(awkward(spark), WORD_BPE)
    assert rows_of(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    full(out)
    assert packing.op10_packing(nothing(spark), WORD_BPE).count() == 0


def full(out, size=4096):
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_best_fit_against_a_plain_list():
    r = random.Random(1)
    for limit in (1, 3, 50):
        bins, open_bins, made = packing.Bins(100, limit), [], 0
        for _ in range(2000):
            n = r.choice([r.randint(1, 100), r.randint(1, 20)])
            number, offset = bins.put(n)
            fits = [b for b in open_bins if b[1] >= n]
            if fits:
                free = min(b[1] for b in fits)
                own = next(b for b in open_bins if b[0] == number)
                assert own[1] == free and offset == 100 - free
            else:
                if len(open_bins) >= limit:
                    low = min(b[1] for b in open_bins)
                    gone = {x for own in bins.by_free for x in own} | {number}
                    open_bins.remove(next(b for b in open_bins if b[1] == low and b[0] not in gone))
                own = [number, 100]
                assert number == made and offset == 0
                made += 1
                open_bins.append(own)
            own[1] -= n
            if not own[1]:
                open_bins.remove(own)
            assert len(open_bins) == bins.open <= limit


def test_few_sequences(spark):
    r = random.Random(6)
    items = [(i, min(4096, int(r.paretovariate(1.1) * 40))) for i in range(6000)]
    df = spark.createDataFrame(items, "i long, length long").repartition(8)
    total = sum(n for _, n in items)
    assert full(packing.pack(df)) <= 1.03 * total / 4096 + 1


@pytest.mark.parametrize("n", [1, 2, 200_000])
def test_one_endless_word(n):
    own, lib = bpe.Bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert list(bpe.unpacked(own.encode("ab" * n))) == lib.encode("ab" * n, add_special_tokens=False).ids
