"""Links between 64-bit fingerprints that differ in few bits, without forming the pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixtab.functions.lineage import materialize

ALL = (1 << 64) - 1
BUCKET, SMALL = 256, 128
#: The list of full buckets is broadcast if there can be no more buckets than this.
KEYS = 1 << 19


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bits_of(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def covering(free: int, radius: int) -> list[int]:
    """Masks of a covering family over the bits ``free``: 2^(radius+1) - 1 of them.

    Bit number j gets a non-zero vector of radius+1 bits; the mask of a vector v keeps the bits whose
    vector has an odd product with v. Up to ``radius`` differing bits never span the whole space, so
    some v is orthogonal to all of them, and its mask keeps none of them: that table has the pair.
    """
    n = (1 << radius + 1) - 1
    vec = {b: j % n + 1 for j, b in enumerate(bits_of(free))}
    return [sum(1 << b for b, m in vec.items() if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def pigeonhole(free: int, radius: int) -> list[int]:
    """radius+1 blocks of the bits ``free``; a pair within the radius agrees in one of them."""
    own = bits_of(free)
    cuts = [len(own) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << b for b in own[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def span(values: Sequence[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links (smallest of a group, member) that connect what is linked among ``values``.

    Grows one group at a time and compares each of its members once with what is still outside, so
    a dense group is left after few comparisons.
    """
    if len(values) == 2:
        a, b = map(int, values)
        if a != b and ((a ^ b) & ALL).bit_count() <= radius:
            yield min(a, b), max(a, b)
        return
    left = np.unique(np.asarray(values, dtype=np.int64))
    alone = np.ones(left.size, bool)
    for lo in range(0, left.size, 256):
        near = np.bitwise_count((left[lo:lo + 256, None] ^ left[None, :]).view(np.uint64)) <= radius
        alone[lo:lo + 256] = near.sum(axis=1) < 2
    left = left[~alone]
    while left.size > 1:
        group, edge, left = [left[:1]], left[:1], left[1:]
        while edge.size and left.size:
            now, edge = edge[:64], edge[64:]
            hit = np.zeros(left.size, bool)
            for x in now:
                hit |= np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            group.append(left[hit])
            edge, left = np.concatenate([edge, left[hit]]), left[~hit]
        found = np.sort(np.concatenate(group))
        yield from ((int(found[0]), int(x)) for x in found[1:])


def side_by_side(at: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets ``at`` (in order), small buckets many at a time.

    All rows of small buckets are compared with the row one place on, then two places on, as long as that is
    in the same bucket. A bucket that is large, or has more links than members, is spanned by itself.
    """
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if at.size else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, at.size))
    bucket = np.repeat(np.arange(starts.size), sizes)
    here = np.flatnonzero((sizes <= SMALL)[bucket])
    left, right, d = [], [], 0
    while here.size:
        d += 1
        here = here[here + d < at.size]
        here = here[bucket[here] == bucket[here + d]]
        apart = fps[here] ^ fps[here + d]
        hit = here[(np.bitwise_count(apart.view(np.uint64)) <= radius) & (apart != 0)]
        left.append(hit)
        right.append(hit + d)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    dense = np.bincount(bucket[i], minlength=starts.size) > sizes
    i, j = (x[~dense[bucket[i]]] for x in (i, j))
    own = [p for k in np.flatnonzero(dense | (sizes > SMALL)) for p in span(fps[starts[k]:starts[k] + sizes[k]], radius)]
    more = np.array(own, dtype=np.int64).reshape(-1, 2)
    return (np.concatenate([np.minimum(fps[i], fps[j]), more[:, 0]]), np.concatenate([np.maximum(fps[i], fps[j]), more[:, 1]]))


def search_sorted(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of rows ``(at, fp)`` that come bucket by bucket; one bucket is held at a time."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_at, held = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(at: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = side_by_side(at, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=shape)

    for b in batches:
        held_at = np.concatenate([held_at, b.column(0).to_numpy()])
        held = np.concatenate([held, b.column(1).to_numpy()])
        if held_at.size and held_at[0] != held_at[-1]:
            done = int(np.searchsorted(held_at, held_at[-1]))
            yield found(held_at[:done], held[:done])
            held_at, held = held_at[done:], held[done:]
    yield found(held_at, held)


def links(nodes: DataFrame, radius: int, family: Callable[[int, int], list[int]], bucket: int = BUCKET,
          last: int = 14) -> DataFrame:
    """``(a, b)`` so that fingerprints within ``radius`` bits of each other are connected.

    ``nodes`` has distinct BIGINT ``fp``. Each mask of the family sends a fingerprint to the bucket
    of its kept bits. Buckets of one are dropped, those of up to ``bucket`` are searched at once.
    Larger ones are split again by the family over the bits not yet kept, which loses no pair, until
    they fit or only ``last`` bits are free: then a bucket has at most 2^last members. So no task ever
    holds an unbounded bucket, whatever its fill, and nothing is cut off.
    """
    out = None
    paths = [ALL]
    level = nodes.select("fp", F.lit(signed(ALL)).alias("free"), F.lit(0).cast("long").alias("at"))
    while True:
        table = [(free, t, m, free & ~m) for free in paths for t, m in enumerate(family(free, radius))]
        final = max(len(bits_of(rest)) for *_, rest in table) <= last
        masks = F.array(*[F.struct(F.lit(signed(f)).alias("of"), F.lit(t).alias("t"), F.lit(signed(m)).alias("mask"),
                                   F.lit(signed(r)).alias("rest")) for f, t, m, r in table])
        own = masks if len(paths) == 1 else F.filter(masks, lambda m: m["of"] == F.col("free"))
        rows = level.select("fp", "at", F.inline(own)).select(
            "fp", F.col("rest").alias("free"), F.xxhash64("at", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("at"))
        sizes = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        # Below the first level, keys of the levels above count as well, so the bound holds only there.
        if not final and paths == [ALL] and sum(1 << len(bits_of(m)) for *_, m, _ in table) <= KEYS:
            full = F.broadcast(materialize(sizes.where(F.col("n") > bucket).select("at")))  # fewer than there are keys
            fits, level = rows.join(full, "at", "left_anti"), rows.join(full, "at").select("fp", "free", "at")
        else:
            held = materialize(rows.join(sizes.where("n > 1"), "at"))
            fits = held if final else held.where(F.col("n") <= bucket)
            level = held.where(F.col("n") > bucket).select("fp", "free", "at")
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = fits.select("at", "fp").repartition(n, "at").sortWithinPartitions("at").mapInArrow(
            lambda batches: search_sorted(batches, radius), "a bigint, b bigint")
        out = found if out is None else out.unionByName(found)
        if final or level.isEmpty():
            return out.distinct()
        paths = list(dict.fromkeys(rest for *_, rest in table))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
