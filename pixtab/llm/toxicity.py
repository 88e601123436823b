"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import map_rows

#: Most labelled rows that the lexicon, the trees and the calibration are fitted on. They are the ones with the
#: smallest hash of their id, so the choice follows no order; every row of any size is scored.
LABELLED = 24_000
#: Most terms of the lexicon; it goes to every task.
TERMS = 2_000
THRESHOLD = 0.3
#: Log odds from which a hit counts as strong.
STRONG = 3.0
PREFIXES, NEAR, CACHE = (4, 5, 6, 7), 5, 300_000

# Second-person words and common insults.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos "
                 "usted ustedes tú ti tus vosotros").split()
INSULTS = ("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb jerk fool "
           "idiota imbécil estúpido basura dummkopf trottel abschaum arschloch connard crétin salaud débile").split()
LOOKALIKES = str.maketrans("013457@$!|€", "oieastasiie")

FEATURES = ("insults", "lexicon", "lexicon_weight", "lexicon_hits", "strong_hits", "near_second_person", "second_person", "capitals", "capital_letters",
            "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "log_words")
HIT, SECOND, SHOUT, HIDDEN, INSULT = 1, 2, 4, 8, 16
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """Lexicon terms of a lower-case word: itself and its beginnings of several lengths."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if n < len(word))]


def plain_form(raw: str) -> tuple[str, bool]:
    """A word's letters in lower case with look-alikes read as letters; whether anything had to be read so."""
    word = raw.strip(".,;:!?\"'()[]{}<>*#%&$|«»¿¡-_").lower()
    if word.isalpha() or not word:
        return word, False
    letters = "".join(LETTERS.findall(word.translate(LOOKALIKES)))
    # A number, an address or a hyphenated word is no disguise: letters on both sides of short marks are.
    hidden = 3 <= len(letters) <= 20 and word[0].isalnum() and any(c in "013457@$!|*._-" for c in word[1:-1]) and "/" not in word
    return letters, hidden


class Words(dict):
    """Flags of raw words, computed once for each; bounded."""

    def __init__(self, lexicon: Mapping[str, float]):
        super().__init__()
        self.lexicon, self.second, self.insults = lexicon, frozenset(SECOND_PERSON), frozenset(INSULTS)

    def weight(self, raw: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(plain_form(raw)[0])), default=0.0)

    def __missing__(self, raw: str) -> int:
        word, hidden = plain_form(raw)
        flags = (HIT if any(t in self.lexicon for t in terms_of(word)) else 0) | (SECOND if word in self.second else 0)
        flags |= (SHOUT if len(word) > 1 and raw.isupper() else 0) | (HIDDEN if hidden else 0) | (INSULT if word in self.insults else 0)
        if len(raw) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[raw] = flags
        return flags


def features(text: str | None, words: Words) -> list[float]:
    """The FEATURES of a whole text; densities are per 100 words. All 0 for a text without words."""
    raw = (text or "").split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    flags = np.frombuffer(bytes(map(words.__getitem__, raw)), np.uint8)
    hits = np.flatnonzero(flags & (HIT | INSULT))
    weight, strong, near = 0.0, 0, 0
    if hits.size:
        each = [words.weight(raw[i]) for i in hits]
        weight, strong = sum(each), sum(w >= STRONG for w in each)
        seconds = np.flatnonzero(flags & SECOND)
        if seconds.size:
            at = np.searchsorted(seconds, hits - NEAR)
            near = int(((at < seconds.size) & (seconds[np.minimum(at, seconds.size - 1)] <= hits + NEAR)).sum())
    per = 100.0 / n
    count = lambda bit: float(np.count_nonzero(flags & bit))
    marks = sum(map(text.count, ".,;:?!*#%&$|"))
    bangs = text.count("!")
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    both = float(np.count_nonzero((flags & (HIT | INSULT) > 0) & (flags & HIDDEN > 0)))
    return [per * count(INSULT), per * hits.size, per * weight, float(hits.size), per * strong, per * near, per * count(SECOND), per * count(SHOUT),
            100.0 * capitals / len(text), 100.0 * marks / len(text), per * bangs, per * count(HIDDEN), per * both, float(np.log1p(n))]


def featured(docs: DataFrame, lexicon: Mapping[str, float], text: str, keep: tuple[str, ...]) -> DataFrame:
    def make():
        words = Words(lexicon)

        def one(body, *kept) -> Iterator[tuple]:
            yield (*kept, features(body, words))
        return one
    shape = docs.select(*keep).schema.add("features", ArrayType(DoubleType()))
    return map_rows(docs.select(F.col(text).alias("_text"), *keep), make, shape)


def learn_lexicon(labelled: DataFrame, text: str, most: int = TERMS) -> dict[str, float]:
    """Terms that mark toxic texts among ``labelled(text, y)``, with their log odds; at most ``most``.

    A term counts once a text, and equal texts count once, so that copies don't lend weight to chance words.
    """
    def make():
        def one(body, y) -> Iterator[tuple]:
            seen = {t for w in set(body.split()) for t in terms_of(plain_form(w)[0]) if len(t) > 3}
            yield from ((t, y) for t in seen)
        return one
    own = labelled.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("k")).agg(F.first(text).alias(text), F.max("y").alias("y"))
    total, toxic = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == total:
        return {}
    rate = toxic / total
    seen = map_rows(own.select(text, "y"), make, "term string, y int").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - F.lit(float(np.log(rate / (1 - rate))))
    # Far from chance, and present in a real share of the toxic texts.
    good = (F.col("t") >= max(3, 0.005 * toxic)) & (odds >= 1.5) & (F.col("t") * odds >= 12)
    rows = seen.where(good).withColumn("odds", odds).orderBy(F.desc(F.col("t") * F.col("odds")), "term").limit(most).collect()
    return {r["term"]: round(float(r["odds"]), 6) for r in rows}


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def sample_of(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, most: int) -> DataFrame:
    """``(text, y, fold)`` of at most ``most`` labelled rows that may be learned from."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold_of(id_col) != 2))
    own = own.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = own.orderBy(F.xxhash64(id_col), id_col).limit(most)
    # At most LABELLED rows of an id and a label, so the broadcast is bounded.
    return docs.select(id_col, text).join(F.broadcast(picked), id_col).select(text, "y", fold_of(id_col).alias("fold"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most: int = LABELLED,
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` and ``raw``, a row for each row of ``docs``.

    ``held_out`` rows (crc32 of the id as text, mod 4, is 2; for a null id it is null) are never learned
    from. Folds 0 and 1 fit the lexicon and the trees, fold 3 the isotonic calibration of their output.
    Scores depend on texts alone. Null and empty texts have zero features and get a score
    too. Labels other than 0 and 1, null ids and ids without a document are not used; an id labelled
    twice takes the larger label; repeated rows repeat their score. If a class is missing among the
    labelled rows, every score is the share of toxic ones (0 without labels). An empty table gives no rows.
    """
    known = materialize(sample_of(docs, labels, text, id_col, label, most))
    fit, calibrate = known.where("fold < 2"), known.where("fold = 3")
    counts = {(r["fold"] < 2, r["y"]): r["n"] for r in known.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [F.col(id_col), (fold_of(id_col) == 2).alias("held_out")]
    if not all((True, y) in counts for y in (0, 1)):
        n = sum(counts.values())
        share = sum(v for (_, y), v in counts.items() if y) / n if n else 0.0
        return docs.select(*out, F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"), F.lit(share).alias("raw"))
    lexicon = learn_lexicon(fit, text)
    vector = array_to_vector("features").alias("features")
    train = materialize(featured(fit, lexicon, text, ("y",))).select("y", vector)
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=1,
                          cacheNodeIds=False).fit(train.withColumn("y", F.col("y").cast("double")))
    trees = trees.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p")
    share_toxic = lambda df: df.withColumn("raw", F.get(vector_to_array("p"), F.lit(1)))
    rest = fit if (False, 0) not in counts or (False, 1) not in counts else calibrate
    tuned = share_toxic(trees.transform(featured(rest, lexicon, text, ("y",)).select("y", vector))).select(
        F.col("y").cast("double").alias("label"), "raw")
    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(tuned).setPredictionCol("score")
    scored = share_toxic(trees.transform(featured(docs, lexicon, text, (id_col,)).select(id_col, vector)))
    scored = iso.transform(scored).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return scored.select(*out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
