"""Host-level quality rules.

Documents are measured and held against named rules, each rule's failures are summed by host, the host's failure
rates are shrunk towards the corpus by beta priors fitted to the hosts, and the host's verdict is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, small, small_batches

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules by name; a document that fails one of the first two is rejected for it, all of them count by host.
RULES = ("too_short", "repetitive", "symbols", "repeated_lines")


@dataclass(frozen=True)
class HostRules:
    """min_words and max_repeat_pct reject a document; a host of which the shrunk failure rate of any rule reaches max_host_rate is rejected whole.

    Symbols are counted against characters of words, repeated lines against lines with a word.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_repeated_line_pct: int = 50
    max_host_rate: float = 0.5


def _repeat_words(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    if len(np.unique(mixed)) == n:
        return 0
    # Some hashes meet: number the windows exactly, by doubling their length.
    ids: dict[bytes, int] = {}
    ranks = np.array([ids.setdefault(w, len(ids)) for w in words])
    for width in (1, 2, 4):
        ranks = ranks.astype(np.int64)
        _, ranks = np.unique(ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:], return_inverse=True)
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """MEASURES of one text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    seen: set[str] = set()
    dups = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dups, _repeat_words(words), lines


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES))


def measure(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """docs with a struct column _rules: MEASURES, base_failed, and failed (whether each of RULES is failed)."""
    small_batches(docs.sparkSession)
    m = docs.withColumn("_m", F.pandas_udf(_measures, ", ".join(f"{c} long" for c in MEASURES))("text"))
    x = F.col("_m")
    failed = (x.n_words < rules.min_words, 100 * x.n_repeat_words > rules.max_repeat_pct * x.n_words, 100 * x.n_symbols > rules.max_symbol_pct * x.word_chars, 100 * x.n_dup_lines > rules.max_repeated_line_pct * x.n_lines)
    named = F.struct(*[f.alias(r) for r, f in zip(RULES, failed)]).alias("failed")
    return m.withColumn("_rules", F.struct(*[x[c].alias(c) for c in MEASURES], (failed[0] | failed[1]).alias("base_failed"), named)).drop("_m")


def prior_strength(hosts: int, docs: int, squares: float, failures: int, spread: float) -> float:
    """How many pseudo-documents a beta prior has, 1 to 1000: by moments, hosts weighing as much as their documents.

    squares: the sum of the hosts' squared document counts; spread: the sum of failures squared over documents. What
    the hosts' rates differ by chance alone, with its standard error, is taken off their variance; where
    nothing is left, hosts are all alike and the prior is as strong as it gets.
    """
    mean = failures / docs if docs else 0.0
    if not 0 < mean < 1:
        return 1000.0
    chance, noise = (hosts - 1) / docs, sqrt(2 * (hosts - 1)) / docs
    room = 1 - squares / docs / docs - chance
    between = (spread / docs - mean * mean) / (mean * (1 - mean)) - chance - noise
    return min(1000.0, max(1.0, room / between - 1)) if between > 0 and room > 0 else 1000.0


def host_verdicts(measured: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """One row per host: host, host_docs, host_failures (of the rules that reject documents), a shrunk rate for each of RULES and host_rate (that of host_failures),
    host_rules (the names of the rules for which it is rejected, by comma), host_rejected.

    measured has the host column and _rules. Each rule has a beta prior of its own, with the mean of all documents. Rows
    without a host belong to none.
    """
    known = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host"))
    judged = {"host": F.col("_rules.base_failed"), **{r: F.col(f"_rules.failed.{r}") for r in RULES}}
    hosts = known.agg(F.count(F.lit(1)).alias("host_docs"), *[F.count_if(f).alias(f"{r}_failures") for r, f in judged.items()])
    n = F.col("host_docs")
    sums = [x for r in judged for x in (F.sum(f"{r}_failures").alias(f"{r}_k"), F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / n).alias(f"{r}_s"))]
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("docs"), F.sum(n.cast("double") * n).alias("squares"), *sums).first()

    def rate(r: str):
        strength = prior_strength(total.hosts, total.docs or 0, total.squares or 0.0, total[f"{r}_k"] or 0, total[f"{r}_s"] or 0.0)
        mean = (total[f"{r}_k"] or 0) / total.docs if total.docs else 0.0
        return F.round((F.col(f"{r}_failures") + mean * strength) / (n + strength), 9).alias(f"{r}_rate")

    hosts = hosts.select("*", *[rate(r) for r in judged])
    why = F.concat_ws(",", *[F.when(F.col(f"{r}_rate") >= rules.max_host_rate, r if r != "host" else "any") for r in judged])
    return hosts.withColumn("host_rules", why).withColumn("host_rejected", F.col("host_rules") != "")


def apply_rules(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in carry, MEASURES, base_failed, host_docs, host_failures, host_rules, host_rejected, kept.

    A null or empty text has no words and fails. Rows whose host is null get no host verdict (host_docs 0).
    Repeated rows are judged and counted each. Columns of docs other than carry, text and the host are not read.
    """
    m = cut(measure(docs.select(*carry, "text", F.col(host).alias("_host")), rules).drop("text"))
    hosts = host_verdicts(m, rules, "_host").select("_host", "host_docs", "host_failures", "host_rules", "host_rejected")
    out = m.join(small(hosts), "_host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.select(*carry, *[f"_rules.{c}" for c in (*MEASURES, "base_failed")], F.coalesce("host_docs", F.lit(0)).alias("host_docs"), F.coalesce("host_failures", F.lit(0)).alias("host_failures"), F.coalesce("host_rules", F.lit("")).alias("host_rules"), rejected.alias("host_rejected"), (~F.col("_rules.base_failed") & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """The rows of docs, with docs' own columns, that pass the document rules and whose host isn't rejected.

    A null or empty text has no words and fails. Rows without a host belong to none. Repeated rows are judged and
    counted each. Texts may be of any length; other columns may have any name; an empty table gives none.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = measure(docs.select(row, F.col(host).alias("_host"), "text"), rules).drop("text")
    measured = cut(measured.withColumn("row", F.when(~F.col("_rules.base_failed"), F.col("row"))))
    bad = host_verdicts(measured, rules, "_host").where("host_rejected").select("_host")
    return measured.where("row IS NOT NULL").join(small(bad), "_host", "left_anti").select("row.*")
