"""Suffix-array dedup of strings that also start in an earlier document.

Each window of 50 bytes belongs to its least 24-byte hash, its anchor: equal windows have equal anchors.
Only anchors of several documents are followed. Runs of windows with one anchor are cut out as pieces, and
equal pieces are kept once with the least document that has them. Where an anchor has several pieces, the
windows that may be in more than one of them are cut out, and a suffix array of what is left tells which of
them are equal. Pieces of an anchor whose pieces are more than a block are cut again by longer anchors before, until
each group fits; the array decides there, too.

The array is built by linear grouping: suffixes start in groups by byte; from the highest group down, each
suffix's previous suffix of a lower group is moved behind its own group, by how many such suffixes it
precedes, so that groups become those of equal Lyndon prefixes. One more pass, from the least suffix up,
emits each group's order along the same pointers. No suffix is ever renamed.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, drop_cut, sharing, small, small_batches

LENGTH, MOST_RUN = 50, 256
#: Bytes of an anchor, and of those that split groups too large for a block. With the last, a group holds one
#: window, or windows that repeat it in a row, so it can't be large.
GRAMS = (24, 37, LENGTH)
#: Bytes of pieces in one block, whose suffixes are sorted together.
BLOCK_BYTES = 256 << 10
RUNS = "array<struct<a:bigint,z:bigint,doc:bigint>>"
#: Bytes of pieces sent from a Python task at once, but for the pieces of one text.
BATCH_BYTES = 16 << 20


def suffix_array(text: bytes) -> list[int]:
    """The starts of text's suffixes in order."""
    n = len(text) + 1  # with a least, closing character
    codes = [c + 1 for c in text] + [0]
    order = sorted(range(n), key=codes.__getitem__)
    place = [0] * n
    start = [0] * n  # by suffix: where its group starts
    size = [0] * n  # by where a group starts
    for k, s in enumerate(order):
        place[s] = k
        start[s] = start[order[k - 1]] if k and codes[order[k - 1]] == codes[s] else k
        size[start[s]] += 1
    before = [-1] * n
    high = n
    while high:
        low = start[order[high - 1]]
        if high - low == 1:
            s = order[low]
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[s] = j
            if j >= 0 and size[start[j]] > 1:
                g = start[j]
                size[g] -= 1
                at, end = place[j], g + size[g]
                other = order[end]
                order[at], order[end] = other, j
                place[other], place[j] = at, end
                start[j], size[end] = end, 1
            high = low
            continue
        chained: Counter = Counter()
        for s in sorted(order[low:high]):
            j = s - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[s] = j
            if j >= 0:
                chained[j] += 1
        levels = defaultdict(list)
        for j, k in chained.items():
            levels[k].append(j)
        for k in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for j in levels[k]:
                g = start[j]
                moved[g] = m = moved.get(g, 0) + 1
                at, end = place[j], g + size[g] - m
                other = order[end]
                order[at], order[end] = other, j
                place[other], place[j] = at, end
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    new = g + size[g]
                    size[new] = m
                    for at in range(new, new + m):
                        start[order[at]] = new
        high = low
    # order is now by groups; each group is filled from its start, along the pointers from smaller suffixes.
    done, filled = [False] * n, [0] * n
    order[0], done[n - 1] = n - 1, True
    filled[start[n - 1]] = 1
    out = [-1] * n
    out[0] = n - 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]


def _hashes(data: bytes, width: int) -> np.ndarray:
    """A hash of each string of width bytes in data."""
    h, factor = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    count, done, out = max(0, len(data) - width + 1), 0, None
    bit = 1  # h has the hashes of bit bytes
    while done < width:
        if width & bit:
            part = h[done : done + count] if out is not None else h[:count]
            out = part if out is None else out * np.uint64(pow(factor, bit, 1 << 64)) + part
            done += bit
        if done < width:
            h = h[:-bit] * np.uint64(pow(factor, bit, 1 << 64)) + h[bit:]
            bit *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def runs_of(data: bytes, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of windows with one anchor of gram bytes."""
    n = len(data) - LENGTH + 1
    if n < 1:
        e = np.zeros(0, np.int64)
        return e, e, e
    least, width, span = _hashes(data, gram), 1, LENGTH - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    length = np.diff(np.append(first, n))
    if length.max() > MOST_RUN:
        cuts = [np.arange(a, a + k, MOST_RUN) for a, k in zip(first, length)]
        first = np.concatenate(cuts)
        length = np.minimum(MOST_RUN, np.diff(np.append(first, n)))
    return first.astype(np.int64), length.astype(np.int64), least[first].view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(runs_of(_bytes(t))[2]) for t in texts], dtype=object)


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, piece, anchor) of the runs of each text whose anchors are wanted."""
    for b in batches:
        lists = b.column("wanted")
        wanted = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        rows = _Rows(b.column("row"))
        for i, data in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            first, length, anchor = runs_of(data)
            keep = np.isin(anchor, wanted[i])
            rows.add(i, data, first[keep], length[keep], anchor[keep])
            if rows.bytes > BATCH_BYTES:
                yield rows.take("row")
        yield rows.take("row")


def _cut_again(gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(of, start, piece, anchor) of the runs of each piece by anchors of gram bytes; of is the row of the piece."""

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _Rows(b.column("of"))
            for i, data in enumerate(b.column("piece").to_pylist()):
                rows.add(i, data, *runs_of(data, gram))
                if rows.bytes > BATCH_BYTES:
                    yield rows.take("of")
            yield rows.take("of")

    return cutter


class _Rows:
    """Pieces on their way out of a task, with the key of the row that each is from."""

    def __init__(self, keys: pa.Array) -> None:
        self.keys = keys
        self.clear()

    def clear(self) -> None:
        self.at: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.start, self.anchor, self.piece, self.bytes = list(self.at), list(self.at), [], 0

    def add(self, row: int, data: bytes, first: np.ndarray, length: np.ndarray, anchor: np.ndarray) -> None:
        self.at.append(np.full(len(first), row))
        self.start.append(first)
        self.anchor.append(anchor)
        self.piece += [data[a : a + k] for a, k in zip(first.tolist(), (length + LENGTH - 1).tolist())]
        self.bytes += int(length.sum()) + len(first) * (LENGTH - 1)

    def take(self, key: str) -> pa.RecordBatch:
        columns = [self.keys.take(pa.array(np.concatenate(self.at))), pa.array(np.concatenate(self.start)), pa.array(self.piece, pa.binary()), pa.array(np.concatenate(self.anchor))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, [key, "start", "piece", "anchor"])


def _least_documents(block: pa.Table) -> pa.Table:
    """For each piece of a block (anchor, piece, x, doc), the least document of its windows, as runs (a, z, doc) of windows.

    A window whose hash is in pieces of one document only has no equal elsewhere. Runs of the others are
    sorted, equal runs once.
    """
    text = b"".join(block.column("piece").to_pylist())
    sizes = pc.binary_length(block.column("piece")).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    least = block.column("doc").to_numpy()[owner]
    windows = np.flatnonzero(np.arange(len(text)) + LENGTH <= ends[owner])
    h = _hashes(text, LENGTH)[windows]
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    low, high = (f.reduceat(least[windows][order], heads) for f in (np.minimum, np.maximum))
    maybe = np.zeros(len(text) + 1, bool)
    maybe[windows[order]] = np.repeat(low < high, np.diff(np.append(heads, len(order))))
    # The 49 bytes at the end of a piece start no window, so a run stays inside its piece.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], maybe.astype(np.int8)])))
    places: dict[bytes, list[int]] = defaultdict(list)
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        places[text[a : z + LENGTH - 1]].append(a)
    owners = [int(least[at].min()) for at in places.values()]
    for (run, at), found in zip(places.items(), _least_of_runs(list(places), owners)):
        for a in at:
            least[a : a + len(found)] = found
    value, of = least[windows], owner[windows]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(first[1:], len(windows)) - 1
    at = starts[of[first]]
    runs = pa.StructArray.from_arrays([pa.array(windows[first] - at), pa.array(windows[last] - at + 1), pa.array(value[first])], ["a", "z", "doc"])
    offsets = np.searchsorted(of[first], np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.table({"anchor": block.column("anchor"), "x": block.column("x"), "runs": pa.ListArray.from_arrays(pa.array(offsets), runs)})


def _least_of_runs(runs: list[bytes], docs: list[int]) -> list[np.ndarray]:
    """For each run, the least document of each of its windows, by the suffix array of all runs."""
    text = b"".join(runs)
    sizes = np.array([len(r) for r in runs], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(runs)), sizes)
    valid = (np.arange(len(text)) + LENGTH <= ends[owner]).tolist()
    least = np.array(docs, np.int64)[owner]
    group: list[int] = []
    last = b""
    for s in suffix_array(text):
        if valid[s]:
            window = text[s : s + LENGTH]
            if window != last:
                if len(group) > 1:
                    least[group] = least[group].min()
                group, last = [], window
            group.append(s)
    if len(group) > 1:
        least[group] = least[group].min()
    return [least[z - k : z - LENGTH + 1] for z, k in zip(ends, sizes)]


def _result(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows = []
    for t, h in zip(texts, hits):
        data = _bytes(t)
        marks = np.zeros(len(data) + 1, np.int64)
        if h is not None and len(h):
            np.add.at(marks, np.array([x["a"] for x in h]), 1)
            np.add.at(marks, np.array([x["z"] for x in h]), -1)
        gone = np.cumsum(marks)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        rows.append((len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat start-end pairs of removed bytes), per row of docs.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Null counts as
    the empty text. Rows that repeat a doc_id are parts of one document: they don't count against each other,
    each loses what documents with smaller ids hold, and documents with larger ids lose what any of them
    holds. A null id has nothing smaller and is smaller than none, so such a row stays whole and takes nothing from others.
    Texts may be of any length; other columns aren't read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    # Copies of a whole text of an earlier document go whole; only first texts are looked into.
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    earliest = texts.groupBy("sha").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("sha", "lo")
    copies = cut(texts.join(earliest, "sha").where("doc_id > lo").select("doc_id", "sha").distinct())
    with_more = cut(texts.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a < b").select("doc_id"))
    copies = cut(copies.join(with_more, "doc_id", "left_anti").select("doc_id"))  # an id with several texts is looked into
    # Where an id has several texts, each is told by its version.
    docs = docs.join(small(with_more.withColumn("several", F.lit(True))), "doc_id", "left")
    docs = docs.select("doc_id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).alias("v"))
    known = docs.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    anchors = known.select("doc_id", "v", F.explode(F.pandas_udf(_anchors, "array<long>", F.PandasUDFType.SCALAR)("text")).alias("anchor"))
    # The count reads v as well, which is never null: with other columns than the join it would deal all rows once more.
    ends = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("v").alias("v")]
    several = lambda rows: rows.groupBy("anchor").agg(*ends).where("lo < hi AND v IS NOT NULL").select("anchor")
    shared = sharing(anchors, "anchor", several)
    wanted = shared.groupBy("doc_id", "v").agg(F.collect_list("anchor").alias("wanted"))
    kind = f"row struct<doc_id:{known.schema['doc_id'].dataType.simpleString()},v:bigint>, start long, piece binary, anchor long"
    pieces = known.join(wanted, ["doc_id", "v"]).select(F.struct("doc_id", "v").alias("row"), "text", "wanted").mapInArrow(_cut_pieces, kind)
    pieces = cut(pieces.select("row.doc_id", "row.v", "start", "piece", "anchor"))
    distinct = cut(pieces.groupBy("anchor", "piece").agg(F.min("doc_id").cast("long").alias("doc")))
    settled = _settle(distinct, 0)
    drop_cut(distinct)
    hit = pieces.select("doc_id", "v", "start", F.octet_length("piece").alias("n"), "anchor", _pid()).join(settled, ["anchor", "x"])
    earlier = F.filter("runs", lambda r: r.doc < F.col("doc_id"))
    spans = F.transform(earlier, lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.z + LENGTH - 1).alias("z")))
    one = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("z")))
    spans = F.when(F.col("runs").isNull(), one).otherwise(spans)
    gone = hit.where("CASE WHEN runs IS NULL THEN doc < doc_id ELSE exists(runs, r -> r.doc < doc_id) END")
    gone = cut(gone.groupBy("doc_id", "v").agg(F.flatten(F.collect_list(spans)).alias("hits")))
    drop_cut(pieces)
    drop_cut(settled)
    result = F.pandas_udf(_result, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    whole = F.expr("array(named_struct('a', 0L, 'z', CAST(octet_length(text) AS BIGINT)))")
    both = docs.join(gone, ["doc_id", "v"], "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    return both.withColumn("hits", F.when(F.col("copy"), whole).otherwise(F.col("hits"))).select("doc_id", result("text", "hits").alias("r")).select("doc_id", "r.*")


def _pid() -> Column:
    """x, which joins a piece to its places, together with its anchor."""
    return F.xxhash64("piece").alias("x")


def _settle(distinct: DataFrame, level: int) -> DataFrame:
    """(anchor, x, doc, runs) of each of the different pieces (anchor, piece, doc) of an anchor of GRAMS[level] bytes.

    runs has the least document of the piece's windows a to z - 1; it is null where the anchor has no other
    piece, and doc is that of all windows.
    """
    keyed = distinct.select("*", _pid())
    per = cut(keyed.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("piece")).alias("bytes"), F.min("x").alias("x"), F.min("doc").alias("doc")))
    split = F.col("bytes") > (BLOCK_BYTES if level + 1 < len(GRAMS) else 1 << 62)
    alone = per.where("pieces = 1").select("anchor", "x", "doc", F.lit(None).cast(RUNS).alias("runs"))
    usual = per.where((F.col("pieces") > 1) & ~split)
    blocks = max(1, -(-(usual.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")
    mixed = keyed.join(usual.select("anchor"), "anchor").select("anchor", "piece", "x", "doc", block)
    found = mixed.groupBy("block").applyInArrow(_least_documents, f"anchor long, x long, runs {RUNS}")
    large, spent = per.where((F.col("pieces") > 1) & split).select("anchor"), [per]
    if not large.isEmpty():
        of = F.struct("anchor", "x", "doc").alias("of")
        kind = "of struct<anchor:long,x:long,doc:long>, start long, piece binary, anchor long"
        parts = keyed.join(large, "anchor").select(of, "piece").mapInArrow(_cut_again(GRAMS[level + 1]), kind)
        # Windows stay apart by both anchors, so that a run of a longer one is inside a run of the shorter.
        parts = cut(parts.withColumn("anchor", F.xxhash64("of.anchor", "anchor")))
        different = cut(parts.groupBy("anchor", "piece").agg(F.min("of.doc").alias("doc")))
        inner = _settle(different, level + 1)
        spent += [parts, different, inner]
        back = parts.select("of", "start", F.octet_length("piece").alias("n"), "anchor", _pid()).join(inner, ["anchor", "x"])
        whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - LENGTH + 1).cast("long").alias("z"), "doc"))
        moved = F.transform(F.coalesce("runs", whole), lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.z).alias("z"), r.doc.alias("doc")))
        back = back.groupBy("of").agg(F.flatten(F.collect_list(moved)).alias("runs"))
        found = found.unionByName(back.select("of.anchor", "of.x", "runs"))
    settled = cut(alone.unionByName(found.withColumn("doc", F.lit(None).cast("long"))))
    for table in spent:
        drop_cut(table)
    return settled
