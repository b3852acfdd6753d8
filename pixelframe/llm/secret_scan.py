"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: some of its alternatives must
have all their trigrams in a text. The postings of these trigrams are intersected, and the documents found
are verified with the expression itself. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut

#: At most so many strings stand for a part of an expression; beyond, nothing is known of it.
MOST_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """Matches are leftmost and don't overlap within a rule; one counts if its group has min_length code points."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0


# The base rules and public token formats, in the order in which kinds are listed.
BASE = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    SecretRule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def _strings(node) -> set[str] | None:
    """All strings that one part of an expression can match; None if they are too many to name."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg)}
    if kind is op.IN:
        if any(k is not op.LITERAL for k, _ in arg):
            return None
        return {chr(a) for _, a in arg}
    if kind is op.SUBPATTERN:
        return _all_strings(arg[3])
    if kind is op.BRANCH:
        each = [_all_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if kind is op.MAX_REPEAT and arg[1] == 1:
        inner = _all_strings(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _all_strings(sequence) -> set[str] | None:
    found = {""}
    for node in sequence:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, of which a matching text, in lower case, has all the trigrams of at least one; none: any text may match."""
    runs, run = [], {""}
    for node in regex.parse(pattern):
        more = _strings(node)
        if more is None or len(run) * len(more) > MOST_STRINGS:
            runs.append(run)
            run = {""} if more is None else more
        else:
            run = {a + b for a, b in product(run, more)}
    best: list[frozenset[str]] = [frozenset()]
    for r in [*runs, run]:
        sets = {frozenset(s.lower()[k : k + 3] for k in range(len(s) - 2)) for s in r}
        sets = [s for s in sets if not any(o < s for o in sets)]
        if all(sets) and len(best) * len(sets) <= MOST_STRINGS:
            best = [a | b for a, b in product(best, sets)]
    return sorted(best, key=sorted) if all(best) else []


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """array<struct<start, rank, kind, end>> of a text's matches, by code points. The pieces between matches give the places."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)), whole, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("n")))
    if rule.group:
        sizes = F.zip_with(sizes, judged, lambda s, g: F.struct(s.gap.alias("gap"), s.n.alias("n"), (F.char_length(g) >= rule.min_length).alias("ok")))
    else:
        sizes = F.transform(sizes, lambda s: F.struct(s.gap.alias("gap"), s.n.alias("n"), (s.n >= rule.min_length).alias("ok")))
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(s: Column, x: Column) -> Column:
        a = s.at + x.gap
        one = F.struct(a.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (a + x.n).alias("end"))
        return F.struct((a + x.n).alias("at"), F.when(x.ok, F.concat(s.out, F.array(one))).otherwise(s.out).alias("out"))

    none = F.array().cast(kind)
    return F.when(text.rlike(rule.pattern if rule.group or not rule.min_length else _at_least(rule)), F.aggregate(sizes, start, add, lambda s: s.out)).otherwise(none)


def _at_least(rule: SecretRule) -> str:
    """A quick test for a match of min_length: the pattern's last + as a count, so that most texts end here."""
    fixed = len(regex.parse(rule.pattern)) - 1
    return f"{rule.pattern[:-1]}{{{rule.min_length - fixed},}}" if rule.pattern.endswith("]+") else rule.pattern


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs' doc_id and secrets array<struct<start, rank, kind, end>> (code points, end exclusive; by start, then rule), per row of docs.

    Null and empty texts have none. Spans of different rules may overlap. Rows that repeat a document share
    its spans; rows of one doc_id with different texts are different documents. A null doc_id is an id.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    low = F.lower("text")
    scanned = [_spans(F.col("text"), r, k) for k, r in enumerate(rules) if not queries[r.kind]]
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(k)) for k, g in enumerate(grams)])) if grams else F.array().cast("array<int>")
    base = cut(docs.select("doc_id", "h", held.alias("grams"), F.concat(*scanned, F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("full")))
    asked = [(k, r.kind, a, len(alt)) for r in rules for a, alt in enumerate(queries[r.kind]) for k, g in enumerate(grams) if g in alt]
    asked = docs.sparkSession.createDataFrame(asked, "gram int, kind string, alt int, needs int")
    postings = base.select("doc_id", "h", F.explode("grams").alias("gram")).distinct()
    met = postings.join(F.broadcast(asked), "gram").groupBy("doc_id", "h", "kind", "alt", "needs").agg(F.count(F.lit(1)).alias("has")).where("has = needs")
    candidates = met.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_set("kind").alias("kinds"))
    texts = docs.join(candidates, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).dropDuplicates(["_doc", "_h"])
    checked = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, k)).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")) for k, r in enumerate(rules) if queries[r.kind]]
    verified = texts.select("_doc", "_h", F.concat(*checked).alias("found")).where(F.size("found") > 0)
    out = base.join(verified, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", F.array_sort(F.concat("full", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))).alias("secrets"))


def secret_digest(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base rules' spans), spans (all), spans being kind:start:end joined by commas."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind.isin([r.kind for r in BASE]))
    of_kind = lambda kind: F.filter("secrets", lambda s: s.kind == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan_secrets(docs, rules).select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
