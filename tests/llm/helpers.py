"""Rows with the awkward cases: nulls, empty, very long, ties, repeats, and columns whose names could clash."""

import random

import public_tokenizers

BYTE_BPE, WORD_BPE = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _text string, _key long, fp long, row long, spans string, "
          "tokens string, failed long, drop string, `a.b` string, _r string, body string, h string")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["al", "be", "cor", "du", "en", "fi", "go"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def awkward_texts() -> list[tuple]:
    base = prose(1, 60)
    near = base.split(" ")
    near[30] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\n \r\n"), (None, base),
           (None, "only here once and nowhere else at all"), (7, prose(2, 40_000)), (8, "x" * 300_000), (9, "one"), (10, "Two Words"),
           (11, "ÀÉ ñandú 漢字　全角 é  nbsp \x1c sep line"), (12, "a  b   c\n\n\td <|endoftext|> e<|endoftext|>"),
           (13, prose(3, 30) + "\n" + prose(4, 30) + "\n" + prose(3, 30)), (14, prose(4, 30) + "\nshort line\nshort line\n" + prose(5, 25))]
    return [(i, t) for i, t in out]


def awkward(spark):
    rows = [(i, t, "en", None if k % 3 else f"s{k % 2}", None, "t", 1, 2, 3, "s", "k", 4, "d", "ab", "r", "b", "h")
            for k, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
