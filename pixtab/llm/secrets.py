"""Secret scanning with corpus-wide ownership frequencies, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize


@dataclass(frozen=True)
class Kind:
    """A candidate pattern; ``hint`` is a substring or pattern without which a text can't match."""
    name: str
    pattern: str
    group: int
    least: int
    hint: str
    hint_is_pattern: bool = False


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Reported wherever they stand, by their shape alone.
BASE = (
    Kind("assign", ASSIGN, 2, 6, "[:=]", True),
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Kind("hex", "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}", True),
)
#: Reported only where the corpus shows them to belong to one owner and they look live.
WIDER = (
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20, "(?i:bearer) ", True),
    Kind("urlcred", r"[a-z][a-z0-9+.]{1,20}://[^\x00-\x20/:@]{1,64}:([^\x00-\x20/:@]{6,128})@", 1, 6, "://"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, "eyJ"),
    Kind("vendor", r"(?:gh[oprsu]_|glpat-|[rs]k_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0, 20, "(?:gh[oprsu]_|glpat-|[rs]k_live_|xox[abprs]-|AIza)", True),
)
KINDS = BASE + WIDER
#: A value with more owners than this is a copied example.
OWNERS = 2
#: So is one that stands in more repositories than this, also with one owner. An owner's own secret may be in several.
REPOS = 20
SPAN = "array<struct<start:bigint,kind:int,`end`:bigint,hash:string,live:boolean>>"


def spans_of(text: Column, kind: Kind, number: int) -> Column:
    """Spans of one kind, leftmost and not overlapping, by code points.

    Matches and the texts between them come from the same scan, so a match starts after all of the
    texts and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    between = F.split(text, kind.pattern, -1)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), F.get(found, i).alias("text")))).alias("out"))

    none = F.array().cast("array<struct<start:bigint,`end`:bigint,text:string>>")
    all_spans = F.when(F.size(found) == 0, none).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda a: a["out"]))

    def as_span(s: Column) -> Column:
        v = F.regexp_extract(s["text"], f"({kind.pattern})", kind.group + 1)
        return F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), F.sha2(v, 256).alias("hash"),
                        looks_live(v).alias("live"))

    long_enough = F.filter(all_spans, lambda s: F.length(F.regexp_extract(s["text"], f"({kind.pattern})", kind.group + 1)) >= kind.least)
    hinted = text.rlike(kind.hint) if kind.hint_is_pattern else F.contains(text, F.lit(kind.hint))
    return F.when(hinted, F.transform(long_enough, as_span)).otherwise(F.array()).cast(SPAN)


def looks_live(value: Column) -> Column:
    """Not a placeholder: varied characters with a digit, and none of the usual example words."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return varied & value.rlike("[0-9]") & ~value.rlike("(?i)example|sample|changeme|placeholder|dummy|x{4}|1234")


def scanned(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """Every candidate of every whole text, a row for each row of ``docs``; one scan of the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    arrays = [spans_of(F.col("_body"), k, i) for i, k in enumerate(KINDS)]
    return docs.select(*keep, body.alias("_body")).select("*", F.concat(*arrays).alias("spans")).drop("_body")


def owned(candidates: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repos)`` over the whole corpus from ``candidates(hash, owner, repo)``.

    Repeats go first, where they are found, so a value that a third of all rows hold is one row for
    each of its repositories before it is counted.
    """
    return (candidates.select("hash", "owner", "repo").distinct().groupBy("hash")
            .agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos")))


def label(spans: Column) -> Column:
    """``kind:start:end`` by start, then by kind as listed, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
         most_owners: int = OWNERS, most_repos: int = REPOS) -> DataFrame:
    """``keep`` columns, ``spans`` and ``wider``, with the ownership of every value; a row for each row of ``docs``.

    ``spans`` holds the base spans; ``wider`` holds what the method adds: candidates of the wider
    kinds, not inside a base span, whose value at most ``most_owners`` owners and ``most_repos`` repositories
    have in the whole corpus and that look live. ``n_live`` counts spans of either sort with such values,
    ``n_copied`` those whose value more owners or more repositories have: an example copied all over the
    documents of one hot owner is copied, too. Null text counts as empty, a null owner or repository as one of its
    own. Null ids and repeated rows give rows of their own; an empty table gives an empty result.
    Only the named columns are read, so others don't clash. Texts are scanned whole.
    """
    kept = [F.col(c).alias(f"k_{c}") for c in keep]
    rows = scanned(docs, text, [*kept, F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                                F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo")])
    # The number of a row is part of the stored table, so it is the same wherever it is read.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    found = rows.where(F.size("spans") > 0).select("row", "owner", "repo", F.inline("spans"))
    judged = found.join(owned(found), "hash").withColumn("own", F.col("live") & (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))
    span = F.struct("start", "kind", "end", "own", "n_owners", "n_repos")
    per_row = judged.groupBy("row").agg(F.collect_list(span).alias("judged"))
    none = F.array().cast("array<struct<start:bigint,kind:int,`end`:bigint,own:boolean,n_owners:bigint,n_repos:bigint>>")
    out = rows.join(per_row, "row", "left").withColumn("judged", F.coalesce("judged", none))
    base = F.filter("judged", lambda s: s["kind"] < len(BASE))
    inside = lambda s: F.exists("spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    out = out.withColumn("spans", base)
    wider = F.filter("judged", lambda s: (s["kind"] >= len(BASE)) & s["own"] & ~inside(s))
    out = out.withColumn("wider", wider)
    both = F.concat("spans", "wider")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "spans", "wider",
                      F.size(F.filter(both, lambda s: s["own"])).cast("long").alias("n_live"),
                      F.size(F.filter(both, lambda s: (s["n_owners"] > most_owners) | (s["n_repos"] > most_repos))).cast("long").alias("n_copied"))


def op3_secrets(docs: DataFrame) -> DataFrame:
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return scan(docs).select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)], F.sha2(label(F.col("spans")), 256).alias("base_sha256"),
        label(F.concat("spans", "wider")).alias("spans"), "n_live", "n_copied")
