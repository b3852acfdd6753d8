"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

One hash of each shingle fills all bins of a signature; an empty bin takes the value of the first filled
one in an order of its own. Documents with equal sets are one node; nodes that share a band's key belong to
one family, a star around one of them. Each family's nodes are compared with its centre, the one that shares
most keys with others, on full sets.

For the rest, a node is known by what it differs in from the centre. The difference of two sets is that of
their differences, so two nodes that the centre doesn't link must have a good part of theirs in common: they
meet in the rarest elements of their differences only, not in what all of a family share.

Links of several kinds are made in one pass: a text has a node of each kind, no bucket holds nodes of two
kinds, and every round works on all nodes, so there are no more jobs than for one kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, small, small_batches, smallest_labels, spare_name, tidy

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Nodes of a family that one task holds against the centre; larger families are dealt in parts.
PART = 4096
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class NearDup:
    """Shingles of words words; links from similarity_pct. A pair just at 85 % is missed with a chance of (1 - .85^8)^36, about 1 in 100,000.

    Nodes of one family are linked if their full sets are similar enough, whether they meet in a bucket or not.
    """

    words: int = 3
    similarity_pct: int = 85
    bands: int = 36
    rows: int = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, hashes: _WordHashes) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def shingle_set(h: np.ndarray, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, given as the hashes of its words."""
    if not len(h):
        return h
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = _mix(x + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def _orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    return np.argsort(_mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(1)).reshape(bins, bins), axis=1)


def band_keys(shingles: np.ndarray, p: NearDup, orders: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty."""
    bins = p.bands * p.rows
    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(at, return_index=True)  # shingles ascend, and so do their bins: the first is a bin's minimum
    full = full.astype(np.int64)
    signature, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    signature[full], filled[full] = shingles[first], True
    empty = np.flatnonzero(~filled)
    for width in (16, bins):  # most find a filled bin among the first few
        hits = filled[orders[empty, :width]]
        found = hits.any(axis=1)
        signature[empty[found]] = signature[orders[empty[found], hits[found].argmax(axis=1)]]
        empty = empty[~found]
        if not len(empty):
            break
    key = np.arange(p.bands, dtype=np.uint64)
    for k in range(p.rows):
        key = _mix(key * ODD[k % 5] + signature[k :: p.rows])
    return key.view(np.int64)


def _signer(kinds: tuple[NearDup, ...]):
    """For each kind k: the size nk of a text's set, its digest setk, and its band keys bandsk."""
    names = [f"{c}{k}" for k in range(len(kinds)) for c in ("n", "set", "bands")]
    kind = ", ".join(f"n{k} long, set{k} binary, bands{k} array<long>" for k in range(len(kinds)))

    @F.pandas_udf(kind)
    def sign(texts: pd.Series) -> pd.DataFrame:
        hashes, orders, rows = _WordHashes(), [_orders(p.bands * p.rows) for p in kinds], []
        for t in texts:
            h, row = word_hashes(t, hashes), []
            for p, order in zip(kinds, orders):
                s = shingle_set(h, p.words)
                row += (len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s, p, order)) if len(s) else (0, None, None)
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    return sign


def _sets(kinds: tuple[NearDup, ...]):
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series, kind: pd.Series) -> pd.Series:
        hashes = _WordHashes()
        return pd.Series([shingle_set(word_hashes(t, hashes), kinds[k].words).view(np.int64) for t, k in zip(texts, kind)], dtype=object)

    return sets


def _meeting(rows: DataFrame, key: str, *about: Column) -> DataFrame:
    """rows whose key several share, with about, what is to be known of these. Keys are counted before the shuffle and written, so that
    rows meet a list: a small one is broadcast, and beside a longer one Spark may split the rows of a hot key."""
    several = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *about).where("_n > 1"))
    return rows.join(small(several), key)


def _families(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node) of the buckets with several nodes, and (node, family, score): nodes that meet, directly or by others,
    are one family; score: how often a node meets others."""
    members = cut(_meeting(banded, "bucket", F.min("node").alias("hub")))
    families = smallest_labels(members.select(F.col("hub").alias("a"), F.col("node").alias("b"))).toDF("node", "family")
    scores = members.groupBy("node").agg(F.sum("_n").alias("score"))
    return members.select("bucket", "node"), families.join(scores, "node")


def _similar(total: Column, apart: Column) -> Column:
    """Whether sets of total elements together, of which apart are in one of them only, are similar enough; pct: the least similarity."""
    return (100 - F.col("pct")) * total >= (100 + F.col("pct")) * apart


def _share() -> Column:
    """Of the elements of two similar sets, counted together, the largest share that one of the sets has alone."""
    return (100 - F.col("pct")).cast("double") / (100 + F.col("pct"))


def _compared(active: DataFrame) -> DataFrame:
    """active (node, pct, family, size, score, shingles) as node, pct, family, size, centre, centre_size, apart, linked: the elements
    that a node or its family's centre has alone, and whether the two are similar. A family of more than PART nodes is dealt in
    parts, and its centre goes to each."""
    top = active.groupBy("family").agg(F.max(F.struct("score", "node")).alias("top"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    top = cut(top.select("top.node", "family", "parts"))
    centres = active.drop("family").join(top, "node").select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("centre"), F.col("size").alias("centre_size"), F.col("shingles").alias("_c"))
    apart = F.concat(F.array_except("shingles", "_c"), F.array_except("_c", "shingles"))
    parted = active.join(small(top.where("parts > 1").select("family", "parts")), "family", "left")
    parted = parted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("int"))
    out = parted.join(centres, ["family", "part"]).select("node", "pct", "family", "size", "centre", "centre_size", apart.alias("apart"))
    return out.withColumn("linked", _similar(F.col("size") + F.col("centre_size"), F.size("apart")))


def _rarest(nodes: DataFrame) -> DataFrame:
    """(key, node, pct, linked, size, d, rank): the elements, of all by which nodes differ from their centre, that may be the
    first in common with a similar node; rank counts from the rarest.

    With d elements apart from the centre of size c, and share = (1 - s) / (1 + s): sets x and y are similar if
    the elements that one has alone are at most share * (|x| + |y|). One of a pair at least isn't linked to
    the centre, so d > share * (|y| + c) there. Hence the least number of elements that the pair must have
    in common; a common one must be among the first d - least + 1 of either.
    """
    share = _share()
    d, size, c = F.size("apart"), F.col("size"), F.col("centre_size")
    least = F.when(F.col("linked"), (d + share * (c - size)) / 2).otherwise((d - share * (c + size)) / 2)
    least = F.greatest(F.lit(1), F.ceil(F.greatest(least, d - share * size * (1 + 100 / F.col("pct"))) - 1e-6)).cast("int")
    each = nodes.where(d > 0).select("node", "pct", "linked", "size", d.alias("d"), (d - least + 1).alias("first"), F.col("family"), F.explode("apart").alias("element"))
    each = each.select("node", "pct", "linked", "size", "d", "first", F.xxhash64("family", "element").alias("key"))
    shared = _meeting(each, "key").withColumnRenamed("_n", "k")
    ranked = shared.groupBy("node", "pct", "linked", "size", "d", "first").agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("keys"))
    # Elements of one node alone are the rarest, and come before.
    alone = F.col("d") - F.size("keys")
    return ranked.select("node", "pct", "linked", "size", "d", "first", alone.alias("alone"), F.posexplode("keys").alias("at", "x")).select(F.col("x.key").alias("key"), "node", "pct", "linked", "size", "d", "first", (F.col("alone") + F.col("at") + 1).alias("rank")).where("rank <= first").drop("first")


def _links(nodes: DataFrame, last: bool) -> DataFrame:
    """(a, b) of similar nodes, of which the centre links one at most; none but b, unless this is the last round."""
    share = _share()
    rarest = _rarest(nodes)
    y = rarest.where("NOT linked")
    x = (rarest if last else rarest.where("linked")).select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "linked", "size", "d", "rank")])
    total = F.col("size_x") + F.col("size")
    common = (F.col("d_x") + F.col("d") - share * total) / 2 - 1e-6  # at least
    near = (F.abs(F.col("d_x") - F.col("d")) <= share * total + 1e-6) & (F.col("rank_x") <= F.col("d_x") - common + 1) & (F.col("rank") <= F.col("d") - common + 1)
    pairs = y.join(x, "key").where((F.col("linked_x") | (F.col("node_x") < F.col("node"))) & near).select(F.col("node_x").alias("a"), F.col("node").alias("b"), "pct").distinct()
    sets = nodes.select("node", "size", "apart")
    both = pairs.join(sets.toDF("a", "na", "da"), "a").join(sets.toDF("b", "nb", "db"), "b")
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return both.where(_similar(F.col("na") + F.col("nb"), apart)).select("a", "b")


@tidy
def link_nodes(docs: DataFrame, nodes: DataFrame, kinds: tuple[NearDup, ...]) -> DataFrame:
    """(a, b) of linked nodes, from which those linked to others can be reached. nodes: node, kind (a place in kinds), at, size, bands.

    A round compares each family's nodes with its centre, and those linked to it with those that aren't. What
    isn't linked makes up the next round's families. A round that links less than a quarter of its nodes is the
    last one, and compares all.
    """
    buckets, families = _families(nodes.select("node", F.explode("bands").alias("bucket"), "kind").select("node", F.xxhash64("kind", "bucket").alias("bucket")))
    families = cut(families)
    pct = F.get(F.array(*[F.lit(p.similarity_pct) for p in kinds]), "kind").alias("pct")
    wanted = nodes.join(families, "node").select("node", "kind", "family", "score", "size", F.col("at.doc_id").alias("_doc"), F.col("at.version").alias("_version"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")))
    texts = texts.select("node", "kind", "family", "size", "score", "text").dropDuplicates(["node"])
    active = cut(texts.select("node", pct, "family", "size", "score", _sets(kinds)("text", "kind").alias("shingles")))
    links = []
    while True:
        compared = cut(_compared(active))
        links.append(compared.where("linked AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        n, rest = compared.agg(F.count(F.lit(1)), F.count_if(~F.col("linked"))).first()
        if not rest:
            break
        last = 4 * rest > 3 * n
        open_ = compared.where("NOT linked").select("family").distinct()
        links.append(cut(_links(compared.join(open_, "family", "left_semi"), last)))
        if last:
            break
        buckets, families = _families(buckets.join(compared.where("NOT linked").select("node"), "node", "left_semi"))
        active = cut(active.drop("family", "score").join(families, "node").select("node", "pct", "family", "size", "score", "shingles"))
    return cut(reduce(DataFrame.union, links))


def _same_document(signed: DataFrame, nodes: DataFrame, links: DataFrame, kinds: tuple[NearDup, ...]) -> DataFrame:
    """(a, b) of nodes that one document has, of those that others link or share: the rest reach nothing that counts."""
    shared = nodes.where("least < most").select("node").union(links.select("a")).union(links.select("b")).distinct()
    shared = cut(nodes.select("node", "kind", "set_id").join(shared, "node"))
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"set{k}").alias("set_id")) for k in range(len(kinds))]))
    each = signed.where("doc_id IS NOT NULL").select("doc_id", sets.alias("s")).select("doc_id", "s.*")
    each = cut(each.join(small(shared), ["kind", "set_id"]).select("doc_id", "node"))
    first = each.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    return cut(each.join(small(first), "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct())


@tidy
def find_near_duplicates(docs: DataFrame, *kinds: NearDup) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. kinds: NearDup() unless given.

    component_id is the least doc_id among the documents linked directly or by others; with several kinds, by
    links of any of them, and n_shingles is that of the first. Null and empty texts, and texts without words,
    have no shingles and are their own component. Documents with equal sets are
    linked. Rows that repeat a doc_id count as one document, kept or not together; a document without id is
    kept if none of its component has one, and doesn't pass on links from one kind to another. Texts may be of
    any length. An empty table gives none. Other columns of docs are not read.
    """
    kinds = kinds or (NearDup(),)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = cut(docs.select("doc_id", F.xxhash64("text").alias("version"), _signer(kinds)("text").alias("s")).select("doc_id", "version", "s.*"))
    each = [F.struct(F.lit(k).alias("kind"), F.col(f"set{k}").alias("set_id"), F.col(f"n{k}").alias("n"), F.col(f"bands{k}").alias("bands")) for k in range(len(kinds))]
    sets = signed.select("doc_id", "version", F.explode(F.array(*each)).alias("s")).select("doc_id", "version", "s.*").where("set_id is not null")
    sets = sets.groupBy("kind", "set_id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "version")).alias("at"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    links = link_nodes(docs, nodes.select("node", "kind", "at", "size", "bands"), kinds)
    if len(kinds) > 1:
        links = links.union(_same_document(signed, nodes, links, kinds))
    labels = smallest_labels(links).toDF("node", "label")
    # Other sets than those that others link or several rows have are a component of their own.
    sets = nodes.select("kind", "set_id", "node", "least", "rows").join(labels, "node", "left").where("label IS NOT NULL OR rows > 1")
    sets = cut(sets.select("kind", "set_id", "least", F.coalesce("label", "node").alias("label")))
    by_set = cut(sets.join(sets.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("kind", "set_id", "component_id"))
    out = signed.select("doc_id", "n0", *[f"set{k}" for k in range(len(kinds))])
    for k in range(len(kinds)):
        out = out.join(small(by_set.where(F.col("kind") == k).select(F.col("set_id").alias(f"set{k}"), F.col("component_id").alias(f"_c{k}"))), f"set{k}", "left")
    found = [F.col(f"_c{k}") for k in range(len(kinds))]
    out = out.withColumn("component_id", F.coalesce(F.least(*found) if len(found) > 1 else found[0], "doc_id"))
    return out.select("doc_id", F.col("n0").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one_of_each(docs: DataFrame, *kinds: NearDup) -> DataFrame:
    """The rows of docs, with docs' own columns, that aren't near-duplicates, by any of kinds, of a document with a smaller doc_id.

    Nulls, empty and repeated rows are treated as find_near_duplicates says; other columns may have any name.
    """
    name = spare_name(docs, "_gone")
    gone = find_near_duplicates(docs, *kinds).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
