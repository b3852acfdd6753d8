"""Runs of words that repeat with a period, found by their Lyndon roots.

The grouping phase of a linear suffix sorter yields the Lyndon array directly: once for an order of the
words and once for its reverse. Every run has a Lyndon word of its period, under one of the two, as the longest
that starts where its roots stand; each root is extended to both sides as far as words a period apart agree.

A run's windows of eight words occur twice in its text, each of them, so only stretches of such windows are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import small_batches
from pixelframe.llm.linear_grouping import lyndon_lengths

WINDOW = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


@dataclass(frozen=True)
class RunRules:
    """Runs of at least least_words words and least_periods times their period.

    At least 24 words and 3 periods, or as much as keeps every window of a run occurring twice in it.
    """

    least_words: int = 24
    least_periods: int = 3

    def __post_init__(self):
        if self.least_words < 3 * WINDOW or self.least_periods < 3:
            raise ValueError(f"least_words >= {3 * WINDOW} and least_periods >= 3 are required")


def _agree(a: np.ndarray, x: int, y: int) -> int:
    """In how many symbols a agrees with itself from x and from y > x on; read in blocks that double."""
    n, done, step = len(a) - y, 0, 64
    while done < n:
        m = min(step, n - done)
        apart = a[x + done : x + done + m] != a[y + done : y + done + m]
        k = int(apart.argmax())
        if apart[k]:
            return done + k
        done, step = done + m, 2 * step
    return n


def runs_of(codes: np.ndarray, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers from 0, by start, then period."""
    n, back, found = len(codes), codes[::-1], set()
    if n < rules.least_words:
        return []
    for symbols in (codes, int(codes.max()) - codes):
        length = np.array(lyndon_lengths(symbols.tolist()), np.int64)
        at = np.arange(n)
        after = at + length
        keep = after < n
        at, after, period = at[keep], after[keep], length[keep]
        keep = (length[after] == period) & (codes[at] == codes[after]) & (codes[after - 1] == codes[np.minimum(after + period, n) - 1])
        last: dict[int, tuple[int, int]] = {}
        for i, p in zip(at[keep].tolist(), period[keep].tolist()):
            low, high = last.get(p, (0, 0))
            if low <= i and i + p <= high:
                continue  # a root inside a run of its period is one of that run
            high = i + p + _agree(codes, i, i + p)
            low = i - _agree(back, n - i - p, n - i)
            if high - low >= 2 * p:
                last[p] = (low, high)
                if high - low >= max(rules.least_words, rules.least_periods * p):
                    found.add((low, high - low, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashed: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (start, end) of a sequence, of windows that occur twice or more in it."""
    n = len(hashed) - WINDOW + 1
    if n < 2:
        return []
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    _, which, count = np.unique(mixed, return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (count[which] > 1).astype(np.int8), [0]])))
    return [(a, z + WINDOW - 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())]


def runs_of_words(words: list[bytes], rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    if len(words) < rules.least_words:
        return []
    out = []
    for a, z in stretches(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)):
        if z - a >= rules.least_words:
            ids: dict[bytes, int] = {}
            codes = np.array([ids.setdefault(w, len(ids)) for w in words[a:z]], np.int64)
            out += [(a + s, n, p) for s, n, p in runs_of(codes, rules)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    keep = np.ones(len(words), bool)
    for s, n, p in runs:
        keep[s + p : s + n] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k]) if runs else b" ".join(words)


def repeated_from_a_place(words: list[bytes], doc_id) -> list[bytes]:
    """The words, or, for every tenth checksum of an id, words that repeat from some place on; a null id changes nothing."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a, copies = h // 10 % n, 3 + h // 10 % 8
    p = 1 + (n - a) // copies
    return words[:a] + (words[a : a + p] * copies)[: n - a]


def find_runs(docs: DataFrame, rules: RunRules = RunRules(), prepare: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (structs start, length, period, by start, then period; places are numbers of words from 0) and text (the words that
    stay, joined by one space), one row per row of docs.

    Of each run, all but its first period goes. prepare, if given, changes a text's words beforehand, by its doc_id. Null counts as
    the empty text: no runs. doc_id may be null. Repeated rows are read each. Texts may be of any length; other columns aren't read; an
    empty table gives none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, texts = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (text or b"").split()
                words = prepare(words, doc_id) if prepare else words
                found = runs_of_words(words, rules)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, ARROW_RUNS), pa.array(texts, pa.binary())], ["doc_id", "runs", "text"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(find, f"doc_id {kind}, runs {RUNS}, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def run_digest(docs: DataFrame, rules: RunRules = RunRules(), prepare: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the start, length, period and exponent_milli of the run with the most periods (nulls without one; ties: the first,
    then the shorter period), and the digests of all runs and of the text that stays."""
    found = find_runs(docs, rules, prepare)
    ranked = F.transform("runs", lambda r: F.struct((-r.length / r.period).alias("e"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(ranked).alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.call_function("div", 1000 * F.col("top.length"), F.col("top.period"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
