"""URL filtering by curated rules and by association rules mined with Spark's FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize
from pixtab.llm.arrow import ascii_lower

#: The curated list of the shared query: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.02, 0.9
DEFAULT = "allow"
LABEL = "="


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none: its host or a subdomain, and a path that starts with the rule's."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        on_host = (host == own) | F.endswith(host, F.lit("." + own))
        tests.append(F.when(on_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, whole host, labels and last two labels of the host, path parts, query names."""
    tag = lambda t, arr: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(t), x))
    labels = F.split(host, "[.]")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?]([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    return F.array_distinct(F.concat(
        tag("scheme:", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        tag("site:", F.array(host)), tag("host:", labels), tag("tail:", F.array(F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2), "."))),
        tag("path:", F.split(path, "/")), tag("query:", names)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(tokens, verdict, n, confidence)``: rules mined from ``labelled(tokens, verdict)``, pruned.

    Each verdict is an item of its own in the transactions. A rule needs the support and the
    confidence, and no shorter rule of the same verdict that is at least as sure: such a part would
    fit wherever it does. The number of rules follows the support, not the size of the table.
    """
    item = F.concat(F.lit(LABEL), F.col("verdict"))
    baskets = materialize(labelled.select(F.concat("tokens", F.array(item)).alias("items")))
    sets = materialize(FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets)
    sets = sets.withColumn("label", F.filter("items", lambda x: F.startswith(x, F.lit(LABEL)))).withColumn(
        "tokens", F.array_sort(F.array_except("items", "label")))
    whole = sets.where(F.size("label") == 0).select("tokens", F.col("freq").alias("of"))
    both = sets.where((F.size("label") == 1) & (F.size("tokens") > 0)).select(
        "tokens", F.substring(F.get("label", F.lit(0)), len(LABEL) + 1, 1 << 20).alias("verdict"), F.col("freq").alias("n"))
    rules = both.join(whole, "tokens").withColumn("confidence", F.col("n") / F.col("of")).where(F.col("confidence") >= confidence)
    rules = materialize(rules.select("tokens", "verdict", "n", "confidence"))
    # Each shorter part with one token less that is a rule itself makes a rule redundant; so by steps do all shorter parts.
    less = rules.where(F.size("tokens") > 1).select(
        F.col("tokens").alias("longer"), "verdict", "confidence", F.explode("tokens").alias("t")).select(
        "longer", "verdict", F.col("confidence").alias("c"), F.array_remove("longer", F.col("t")).alias("tokens"))
    over = less.join(rules, ["tokens", "verdict"]).where(F.col("confidence") >= F.col("c")).select(
        F.col("longer").alias("tokens"), "verdict").distinct()
    return rules.join(over, ["tokens", "verdict"], "left_anti")


def index(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """The inverted index: every rule under its token that the fewest pages have (ties to the smaller name)."""
    each = rules.select("*", F.explode("tokens").alias("anchor"))
    rare = sets.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"))
    first = each.join(rare, "anchor", "left").groupBy("tokens", "verdict").agg(
        F.min_by("anchor", F.struct(F.coalesce("seen", F.lit(0)), "anchor")).alias("anchor"))
    return rules.join(first, ["tokens", "verdict"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",),
          support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` for each row of ``pages``.

    Pages on which a curated rule fits have its verdict and are the labels from which token rules are
    mined. Every other page has the verdict of the surest mined rule that fits it (then the one
    with more tokens, with more pages, then by name), and ``mined`` is that rule; without one, the default.
    Null and malformed URLs have no host, hence no token, and get the default. Null ids and repeated
    rows give rows of their own; an empty table, or one without labels, mines nothing. Only the named
    columns are read.
    """
    host, path = parts(F.col(url))
    rows = pages.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(url).alias("u"), host.alias("host"), path.alias("path"))
    verdict_of = F.create_map(*[F.lit(x) for pair in rules for x in pair]) if rules else F.lit(None)
    rows = rows.withColumn("rule", curated(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("known", verdict_of[F.col("rule")] if rules else F.lit(None).cast("string"))
    rows = rows.withColumn("tokens", F.when(F.col("host") != "", tokens(F.col("u"), F.col("host"), F.col("path"))).otherwise(
        F.array().cast("array<string>"))).drop("u")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    labelled = rows.where(F.col("known").isNotNull()).select("tokens", F.col("known").alias("verdict"))
    out = rows.select("row", *[F.col(f"k_{c}").alias(c) for c in keep], "host", "path", "rule", "known")
    if labelled.isEmpty():
        none = F.lit(None).cast("string")
        return out.select(*keep, "host", "path", "rule", F.coalesce("known", F.lit(default)).alias("verdict"), none.alias("mined"))
    found = mine(labelled, support, confidence)
    terms = labelled.select(F.explode("tokens").alias("anchor"))
    by_token = materialize(index(found, terms)).withColumnRenamed("tokens", "needs")
    open_rows = rows.where("known is null").select("row", "tokens", F.explode("tokens").alias("anchor"))
    met = open_rows.join(by_token, "anchor").where(F.size(F.array_except("needs", "tokens")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.size("needs")).alias("s"), (-F.col("n")).alias("n"),
                     F.array_join("needs", " ").alias("name"), "verdict")
    best = met.groupBy("row").agg(F.min(order).alias("best"))
    return out.join(best, "row", "left").select(
        *keep, "host", "path", "rule", F.coalesce("known", F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.col("best.name").alias("mined"))


def op5_urls(pages: DataFrame) -> DataFrame:
    return judge(pages)
