"""Quality rules as a ledger of failure bits, with versioned policies and ablations on top."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.llm.arrow import map_rows, rows_back, whole_rows

WINDOW = 8
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bang_words",
            "max_word", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """Bit number ``bit`` of the ledger is set where ``fails`` holds; a bit is never given to another rule."""
    bit: int
    name: str
    fails: str


#: Every rule ever used. Measurements are integers, so each rule is exact integer arithmetic.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "long_words", "word_chars > 20 * n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "duplicate_lines", "n_lines > 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "shouting", "2 * n_upper_words > n_words"),
    Rule(7, "exclamations", "10 * n_bang_words > 3 * n_words"),
    Rule(8, "endless_word", "max_word > 1000"),
    Rule(9, "stutter", "n_words >= 20 and 100 * n_stutters > 30 * n_words"),
)
BASE = (1 << 0) | (1 << 1)
#: Policies by version: a document is rejected if any of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | (1 << 2) | (1 << 5) | (1 << 6) | (1 << 7) | (1 << 9),
    "v2": (1 << 10) - 1,
}
CURRENT = "v1"


def repeat_words(words: Sequence[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, first occurrences included.

    Windows are compared by a rolling 64-bit sum of word numbers; only windows whose sum repeats are
    then compared as words, so the count is exact.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    sums = np.zeros(n, np.uint64)
    for i in range(size):
        sums = sums * np.uint64(0xD1342543DE82EF95) + ids[i:i + n]
    order = np.argsort(sums)
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at = np.flatnonzero(twin).tolist()
    found: dict[tuple, list[int]] = {}
    for i in at:
        found.setdefault(tuple(words[i:i + size]), []).append(i)
    inside = np.zeros(len(words) + 1, np.int64)
    for own in found.values():
        if len(own) > 1:
            np.add.at(inside, own, 1)
            np.add.at(inside, np.asarray(own) + size, -1)
    return int((np.cumsum(inside) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of a whole UTF-8 text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    # Code points are the bytes that do not continue a character.
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), sum(w.isupper() and len(w) > 1 for w in words), text.count(b"!!"),
            max(map(len, words), default=0), sum(map(eq, words, words[1:])))


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and every measurement as BIGINT, a row for each row of ``docs``."""
    def make():
        def one(body, *kept) -> Iterator[tuple]:
            yield (*kept, *measure(body))
        return one
    shape = docs.select(*keep).schema
    for m in MEASURES:
        shape = shape.add(m, "long")
    return map_rows(docs.select(F.col(text).cast("binary").alias("_text"), *keep), make, shape)


def bits(rules: Sequence[Rule] = RULES) -> Column:
    """The ledger entry: one bit for each rule that fails."""
    return sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed`` (BIGINT bits), a row for each row of ``docs``.

    Every rule is evaluated once; policies and ablations need only this table. Null text counts as
    empty and fails ``few_words``. Repeated rows and null ids give rows of their own; an empty table
    gives an empty ledger; columns not kept are not read. A text is measured whole, in one task.
    """
    return measured(docs, text, keep).withColumn("failed", bits())


def allows(version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policies[version])) == 0


def ablations(entries: DataFrame, policies: Mapping[str, int] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(version, rule, n_failed, n_only, n_kept, n_kept_without)`` for each rule of each policy.

    ``n_only``: documents that only this rule of the policy rejects, so ``n_kept_without`` is what the
    policy keeps without it. One aggregation of the distinct bit patterns, at most 2^rules of them.
    """
    seen = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    every = [F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(r.name).alias("rule"),
                      F.lit(1 << r.bit).cast("long").alias("bit")) for v, m in policies.items() for r in rules if m >> r.bit & 1]
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    rows = seen.select("failed", "n", F.inline(F.array(*every)))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("version", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0)("n_failed"), count(hit == F.col("bit"))("n_only"),
        count(hit == 0)("n_kept"), count((hit == 0) | (hit == F.col("bit")))("n_kept_without"))


def keep_good(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy allows, all columns, whatever their names."""
    rows = whole_rows(docs, body=F.col(text))
    return rows_back(ledger(rows, "body", ("_r",)).where(allows(version)))


def op7_quality(docs: DataFrame) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               base.alias("base_failed"), (~base & allows()).alias("kept"),
                               "n_lines", "n_upper_words", "n_bang_words", "max_word", "n_stutters", "failed")


_SPACES = r"[ \t\n\x0b\f\r]+"
_FAILS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_SPACES}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s)),
twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twin) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words,
        CAST((length(t) - length(replace(t, '!!', ''))) // 2 AS BIGINT) AS n_bang_words,
        CAST(coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS BIGINT) AS max_word,
        CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutters
      FROM s LEFT JOIN inside USING (r)),
f AS (SELECT *, CAST({_FAILS} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE} <> 0 AS base_failed,
  failed & {BASE | POLICIES[CURRENT]} = 0 AS kept, n_lines, n_upper_words, n_bang_words, max_word, n_stutters, failed FROM f
"""
