"""Importance resampling towards a target distribution.

Features are runs of words, hashed into buckets. How often each bucket occurs in the corpus and in the target
gives its gain; a document's weight is the sum of its features' gains. Noise that is drawn from a hash of the
id turns weights into scores, of which the highest are drawn.

The lowest score that is drawn is found exactly, without a sort: each partition tells the median of what it
still has in play, the median of these medians, weighted by how much each partition has, parts the scores,
and the side without the cutoff, a quarter of what is left at least, goes. Only what is drawn is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, small_batches
from pixelframe.llm.decontaminate import FOLD

#: Keys worse and better than all.
WORST, BEST = (-(2**63), -(2**63)), (2**63 - 1, 2**63 - 1)
#: A table of keys of more rows than this is written anew when an eighth of it is left in play.
REWRITE = 1_000_000
KEYS = "n_above long, above_a long, above_b long, n_equal long, n_below long, below_a long, below_b long"


@dataclass(frozen=True)
class Resampling:
    """Of the documents with at least least_words words, share_pct % are drawn. Features are runs of shortest to longest words."""

    least_words: int = 20
    share_pct: int = 10
    buckets: int = 10_000
    shortest: int = 1
    longest: int = 1
    seed: int = 2024


class _Buckets(dict):
    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[feature] = b = crc32(feature) % self.n
        return b


def features_of(text: bytes | None, p: Resampling, buckets: _Buckets) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its features."""
    words = (text or b"").translate(FOLD).split()
    parts = []
    for n in range(p.shortest, min(p.longest, len(words)) + 1):
        runs = words if n == 1 else [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
        parts.append(np.fromiter(map(buckets.__getitem__, runs), np.int64, len(runs)))
    return len(words), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """(bucket, n) of all features of the column text; each task sends its sums only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = _Buckets(p.buckets), np.zeros(p.buckets, np.int64)
        for b in batches:
            found = [features_of(t, p, buckets)[1] for t in b.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=p.buckets) if found else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    return texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down; one number for each of the fixed number of buckets."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (bucket_counts(corpus, p), bucket_counts(target, p)))
    every, wanted = float(sum(s.values()) + p.buckets), float(sum(t.values()) + p.buckets)
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * every / ((s.get(b, 0) + 1.0) * wanted))) for b in range(p.buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs (doc_id, text)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(p.buckets)
        for b in batches:
            rows = [(n, len(at), int(gains[at].sum())) for n, at in (features_of(t, p, buckets) for t in b.column(1).to_pylist())]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(sums, f"doc_id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise)


def _median(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The middle one of the keys (a, b), in linear time."""
    k = len(a) // 2
    m = np.partition(a, k)[k]
    ties = b[a == m]
    return int(m), int(np.partition(ties, k - int((a < m).sum()))[k - int((a < m).sum())])


def _within(a: np.ndarray, b: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> np.ndarray:
    return ((a > low[0]) | (a == low[0]) & (b > low[1])) & ((a < high[0]) | (a == high[0]) & (b < high[1]))


def _parted(low: tuple[int, int], pivot: tuple[int, int], high: tuple[int, int]):
    """By partition: how many keys are between low and high, over, at and under the pivot, and the medians of both sides."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, equal = {(pivot, high): [], (low, pivot): []}, 0
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in range(2))
            equal += int(((a == pivot[0]) & (b == pivot[1])).sum())
            for bounds, found in sides.items():
                keep = _within(a, b, *bounds)
                found.append((a[keep], b[keep]))
        row = []
        for found in sides.values():
            a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))
            row += [len(a), *(_median(a, b) if len(a) else (0, 0))]
        row.insert(3, equal)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], [c.split()[0] for c in KEYS.split(", ")])

    return part


def find_cutoff(keys: DataFrame, k: int) -> tuple[tuple[int, int], int]:
    """The k-th greatest of the keys (a, b), k at least 1 and at most their number, and how many are greater.

    A round reads the keys once and sends three counts and two medians from each partition. At least a quarter of what is
    in play goes in each round, whatever the order or the distribution.
    """
    low, pivot, high, greater, size = WORST, BEST, BEST, 0, None
    while True:
        rows = keys.mapInArrow(_parted(low, pivot, high), KEYS).collect()
        above, equal, below = (sum(r[c] for r in rows) for c in ("n_above", "n_equal", "n_below"))
        if size is None:
            size, equal = above + equal + below, 0 if pivot == BEST else equal
        if greater + above >= k:
            low, left, side = pivot, above, "above"
        elif greater + above + equal >= k:
            return pivot, greater + above
        else:
            greater, high, left, side = greater + above + equal, pivot, below, "below"
        medians = sorted((r[f"{side}_a"], r[f"{side}_b"], r[f"n_{side}"]) for r in rows if r[f"n_{side}"])
        seen = 0
        for *pivot, n in medians:
            seen += n
            if 2 * seen >= left:
                break
        pivot = tuple(pivot)
        if size > REWRITE and 8 * left < size:
            keys, size = cut(keys.where(_over(low) & ~_over(high, True))), left


def _over(key: tuple[int, int], or_equal: bool = False) -> Column:
    a, b = F.col("a"), F.col("b")
    return (a > key[0]) | (a == key[0]) & ((b >= key[1]) if or_equal else (b > key[1]))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank, one row per row of docs; rank counts what is drawn from the highest score, and is null else.

    docs: doc_id (integer), text; target: text. Ties go to the smaller doc_id; a null id comes last, and its noise
    is that of the empty id. Null texts count as empty: no features, weight 0, never drawn. Repeated rows count each;
    of rows that are alike as many as fit are drawn. Texts may be of any length; other columns aren't read. Empty tables give no
    rows, or, as targets, gains by the corpus alone.
    """
    scored = cut(weigh(docs, gains_of(docs, target, p), p))
    key = {"a": F.col("score"), "b": F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(WORST[1]))}
    inside = F.col("n_words") >= p.least_words
    k = scored.where(inside).count() * p.share_pct // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    cutoff, _ = find_cutoff(scored.where(inside).select(*[v.alias(c) for c, v in key.items()]), k)
    scored = scored.withColumns(key).withColumn("won", inside & _over(cutoff, True))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    sorted_ = scored.where("won").select(*plain).repartitionByRange(*order).sortWithinPartitions(*order)
    won = cut(sorted_.withColumn("at", F.monotonically_increasing_id()))  # the partition, and the place in it
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in won.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, before long"))
    ranked = won.select(*plain, part, (place + 1).alias("place")).join(starts, "part").withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.select(*plain, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return scored.where("NOT won").select(*plain, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
