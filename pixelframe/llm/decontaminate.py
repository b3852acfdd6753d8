"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 13 item words is a pattern. A shift table over blocks of two words says how far a search
may jump; where it says nothing, the patterns that end in that block are compared word for word.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, small_batches

WINDOW = 13
#: Bytes to words: A-Z in lower case, other ASCII characters than letters and digits as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
HITS = "n_words long, spans array<long>, items array<string>"
#: Factor of the hashes of word ids, and the bits they keep.
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _hashed(ids: np.ndarray, starts: np.ndarray, places) -> np.ndarray:
    """A hash of the words at these places of each pattern."""
    h = np.zeros(len(starts), np.uint64)
    for k in places:
        h = h * np.uint64(FACTOR) + ids[starts + k].astype(np.uint64)
    return h


class WuManber:
    """Search for many word sequences of one length, over the ids of their words.

    shift has, by slot of a block of words, the least distance from the block's last place in a pattern to the
    pattern's end; blocks that share a slot share the lesser. keys has, sorted, the hash of the block that ends
    a pattern and of the pattern's first word; at the same place, starts has where the pattern is in ids, owners
    the item it is from, and again whether it equals the pattern before. A window that an item repeats is kept once.
    """

    def __init__(self, length: int, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        whole = _hashed(ids, starts, range(length))
        keys = _hashed(ids, starts, [*range(length - self.block, length), 0])
        order = np.lexsort((owners, whole, keys))
        starts, owners, keys = starts[order], owners[order], keys[order]
        again = np.zeros(len(starts), bool)
        again[1:] = True
        for k in range(length):
            again[1:] &= ids[starts[1:] + k] == ids[starts[:-1] + k]
        once = np.ones(len(starts), bool)
        once[1:] = ~(again[1:] & (owners[1:] == owners[:-1]))
        self.keys, self.starts = array("Q", keys[once].tobytes()), array("i", starts[once].astype(np.int32).tobytes())
        self.owners, self.again = array("i", owners[once].astype(np.int32).tobytes()), again[once].tobytes()
        self.ids = array("i", ids.astype(np.int32).tobytes())
        self.bits = max(10, int(4 * len(starts)).bit_length())
        shift = np.full(1 << self.bits, self.jump, np.uint8)
        for end in range(length, self.block - 1, -1):
            slots = _hashed(ids, starts, range(end - self.block, end)) * np.uint64(FACTOR) >> np.uint64(64 - self.bits)
            shift[slots.astype(np.int64)] = np.minimum(shift[slots.astype(np.int64)], length - end)
        self.shift = shift.tobytes()

    def find(self, words: list[bytes], id_of):
        """(start, owner) of every occurrence; id_of gives a word's id, or None."""
        end, n, length, block, jump, shift, keys = self.length, len(words), self.length, self.block, self.jump, self.shift, self.keys
        down = 64 - self.bits
        while end <= n:
            b = id_of(words[end - 1])
            a = 0 if block == 1 else id_of(words[end - 2])
            if a is None or b is None:
                end += jump
                continue
            h = (a * FACTOR + b) & MASK
            step = shift[(h * FACTOR & MASK) >> down]
            if step:
                end += step
                continue
            start = end - length
            first = id_of(words[start])
            if first is not None:
                key = (h * FACTOR + first) & MASK
                at = bisect_left(keys, key)
                if at < len(keys) and keys[at] == key:
                    yield from self._equal(at, key, start, [id_of(w) for w in words[start:end]])
            end += 1

    def _equal(self, at: int, key: int, start: int, found: list[int | None]):
        equal = False
        while at < len(self.keys) and self.keys[at] == key:
            if not self.again[at]:
                s = self.starts[at]
                equal = self.ids[s : s + self.length].tolist() == found
            if equal:
                yield start, self.owners[at]
            at += 1


class Index:
    """The words, items and matchers of a block of the benchmark: one for WINDOW, and those of shorter items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.word: dict[bytes, int] = {}
        self.names: list[str | None] = []
        name_at: dict[str | None, int] = {}
        ids, first, count, owner = array("i"), [], [], []
        for item, text in items:
            words = words_of(text)
            name = None if item is None else str(item)
            if name not in name_at:
                name_at[name] = len(self.names)
                self.names.append(name)
            first.append(len(ids))
            count.append(len(words))
            owner.append(name_at[name])
            ids.extend(self.word.setdefault(w, len(self.word)) for w in words)
        all_ids, first, count, owner = np.array(ids, np.int32), np.array(first, np.int64), np.array(count, np.int64), np.array(owner, np.int32)
        self.matchers = []
        for n in sorted({min(WINDOW, int(k)) for k in count} - {0}):
            of = np.flatnonzero(np.minimum(count, WINDOW) == n)
            windows = count[of] - n + 1
            ends = np.cumsum(windows)
            starts = np.arange(ends[-1]) + np.repeat(first[of] - (ends - windows), windows)
            self.matchers.append(WuManber(n, all_ids, starts, np.repeat(owner[of], windows)))

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Number of words, hit words as flat start-end pairs (disjoint, ascending), ids of the items found."""
        words = words_of(text)
        spans, owners = [], set()
        for m in self.matchers:
            for start, owner in m.find(words, self.word.get):
                if not spans or spans[-1] != (start, start + m.length):
                    spans.append((start, start + m.length))
                owners.add(owner)
        return len(words), merge_spans(spans), sorted({self.names[k] for k in owners} - {None})


def parts_of(text: str | None, most: int) -> list[str]:
    """The words of a text in parts of about so many bytes, which share WINDOW - 1 words, so each window is in one part."""
    words, out, start, end, size = words_of(text), [], 0, 0, 0
    while end < len(words):
        start, size = max(0, end - WINDOW + 1), 0
        end = start
        while end < len(words) and (size < most or end - start < WINDOW):
            size += len(words[end]) + 1
            end += 1
        out.append(b" ".join(words[start:end]).decode("utf-8", "surrogatepass"))
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _merged(spans: Column) -> Column:
    return F.pandas_udf(lambda each: each.map(lambda s: merge_spans(list(zip(s[0::2], s[1::2])))), "array<long>", F.PandasUDFType.SCALAR)(spans)


@dataclass(frozen=True)
class BenchmarkLimits:
    """min_hit_pct: share of hit words that makes a document contaminated. block_bytes: benchmark text searched for in one pass."""

    min_hit_pct: int = 5
    block_bytes: int = 8 << 20


def _blocks(benchmark: DataFrame, limits: BenchmarkLimits):
    """The benchmark's items in lists of about block_bytes; one list at a time is on the driver, and is sent to the tasks.

    Items longer than a sixteenth of a block are in parts, which may be in several blocks.
    """
    most = max(1, limits.block_bytes // 16)
    split = F.pandas_udf(lambda texts: texts.map(lambda t: parts_of(t, most)), "array<string>", F.PandasUDFType.SCALAR)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    long = items.where(F.octet_length("text") > most).select("item_id", F.explode(split("text")).alias("text"))
    items = items.where(F.octet_length("text") <= most).unionByName(long)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limits.block_bytes) or 1
    for k in range(n):
        yield n, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


#: The index that this worker has built last, under the id of the broadcast it is of.
_built: dict[str, Index] = {}


def _index(key: str, sent) -> Index:
    """The worker's index of the items sent; the one before is forgotten."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(sent.value)
    return _built[key]


def _searcher(spark, items):
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        index = _index(key, sent)
        return pd.DataFrame([index.search(t) for t in texts], columns=["n_words", "spans", "items"])

    return hits


def _verdict(hits: Column, limits: BenchmarkLimits) -> list[Column]:
    spans, n_words = hits["spans"], hits["n_words"]
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, k: s + F.get(spans, k + 1) - F.get(spans, k))
    n_hit = F.when(F.size(spans) > 1, n_hit).otherwise(F.lit(0).cast("long"))
    return [n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), ((n_hit > 0) & (100 * n_hit >= limits.min_hit_pct * n_words)).alias("contaminated")]


def find_contamination(docs: DataFrame, benchmark: DataFrame, limits: BenchmarkLimits = BenchmarkLimits(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: carry, n_words, n_hit, n_items, items_sha256, contaminated.

    Documents with null or empty text have no words and are not contaminated. Items with null text have no
    windows; an item without id counts for n_hit but can't be listed. An empty benchmark finds nothing.
    A benchmark of more than block_bytes is searched for block by block, and the hits are merged by text; repeated
    rows are judged each. Texts and items may be of any length; other columns than carry and text aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*carry, "text")
    parts = []
    for n, items in _blocks(benchmark, limits):
        hits = _searcher(spark, items)("text")
        if n == 1:
            found = docs.select(*carry, hits.alias("_hits"))
            return found.select(*carry, *_verdict(F.col("_hits"), limits))
        parts.append(cut(docs.select(F.sha2("text", 256).alias("_key"), hits.alias("_hits")).dropDuplicates(["_key"])))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("_key").agg(F.struct(F.max("_hits.n_words").alias("n_words"), _merged(F.flatten(F.collect_list("_hits.spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits.items")))).alias("items")).alias("_hits"))
    none = F.expr("named_struct('n_words', 0L, 'spans', array(0L, 0L), 'items', cast(array() as array<string>))")
    out = docs.withColumn("_key", F.sha2("text", 256)).drop("text").join(merged, "_key", "left").withColumn("_hits", F.coalesce("_hits", none))
    return out.select(*carry, *_verdict(F.col("_hits"), limits))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limits: BenchmarkLimits = BenchmarkLimits()) -> DataFrame:
    """The rows of docs, with docs' own columns, that aren't contaminated.

    Rows with null or empty text stay; repeated rows are judged alike; other columns may have any name.
    """
    if docs.columns.count("text") != 1:
        raise ValueError("docs needs one column named text")
    return find_contamination(docs.withColumn("_row", F.struct(*docs.columns)), benchmark, limits, ("_row",)).where("not contaminated").select("_row.*")
