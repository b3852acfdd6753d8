"""URL filter: rules by host and path, and gradient-boosted trees for what no rule fits.

The trees see how a URL is written (lengths, depth, digits, entropy, parameters) and what is known of its
host's suffix, and learn from the URLs that the rules label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.color import let
from pixelframe.llm.common import cut, small


@dataclass(frozen=True)
class UrlRule:
    """verdict (allow or block) for the URLs of host and of its subdomains whose path begins with path."""

    verdict: str
    host: str
    path: str = "/"


RULES = (UrlRule("allow", "com"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))


@dataclass(frozen=True)
class UrlModel:
    """Trees of depth depth, rounds of them, that learn from at most most_labelled different URLs (those of the least hashes).

    A suffix is the last suffix_labels labels of a host; its share of blocked URLs is shrunk by strength URLs of the whole's share.
    """

    rounds: int = 20
    depth: int = 4
    bins: int = 32
    most_labelled: int = 20_000
    suffix_labels: int = 1
    strength: float = 20.0
    seed: int = 7


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "host_entropy", "path_entropy", "parameters", "suffix_urls", "suffix_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: what stands between the first :// and the next /, ? or #, or the end, with A-Z in lower case; path: what follows up to ? or #. Both are empty for null and without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, by host and path together, then host; null if none does. rules: a stated, short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character, of how often each occurs."""

    def bits(x: Column) -> Column:
        n = F.char_length(x.text)
        share = lambda c: (n - F.char_length(F.replace(x.text, c, F.lit("")))) / n
        return F.aggregate(F.array_distinct(F.split(x.text, "")), F.lit(0.0), lambda s, c: s - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))

    return F.when(F.char_length(text) > 0, let(F.struct(text.alias("text")), bits)).otherwise(0.0)


def _lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the features that need nothing but the URL."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    digits = F.char_length(url) - F.char_length(F.translate(url, "0123456789", ""))
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    found = {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path), "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": digits / F.greatest(F.char_length(url), F.lit(1)), "hyphens": F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))),
        "host_entropy": _entropy(host), "path_entropy": _entropy(path), "parameters": F.size(F.filter(F.split(asked, "&"), lambda s: s != "")),
    }
    return urls.withColumns({c: v.cast("double") for c, v in found.items()})


def suffix_statistics(judged: DataFrame, m: UrlModel = UrlModel()) -> DataFrame:
    """(suffix, suffix_urls, suffix_blocked) over all rows of judged (suffix, blocked; blocked is null where no rule fits)."""
    known = judged.agg(F.count("blocked").alias("n"), F.sum("blocked").alias("k")).first()
    share = (known.k or 0) / known.n if known.n else 0.5
    by = judged.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("k"))
    return by.select("suffix", F.log1p("n").alias("suffix_urls"), ((F.col("k") + share * m.strength) / (F.col("known") + m.strength)).alias("suffix_blocked"))


def train(labelled: DataFrame, statistics: DataFrame, m: UrlModel = UrlModel()):
    """The trees, fitted to labelled (url, host, path, suffix, blocked); None if the labels are all alike."""
    once = labelled.groupBy("url").agg(*[F.first(c).alias(c) for c in ("host", "path", "suffix", "blocked")])
    chosen = once.orderBy(F.xxhash64("url"), "url").limit(m.most_labelled)
    rows = cut(_lexical(chosen).join(small(statistics), "suffix").select(*FEATURES, F.col("blocked").cast("double").alias("label")).coalesce(1))
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    if low == high:
        return None
    return GBTClassifier(maxIter=m.rounds, maxDepth=m.depth, maxBins=m.bins, seed=m.seed).fit(_assembled(rows))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, m: UrlModel = UrlModel()) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), one row per row of pages (page_id, url).

    rule is that of the longest rule that fits, else null, and the verdict is then the trees'. They learn from the URLs that rules label; if
    all labels are alike the verdict is theirs, without any it is allow. A null URL, and one without ://, has an empty host and path and no rule, and is
    judged as the empty text. Repeated rows are judged alike, count each for the statistics of suffixes, and once for learning. URLs may be of any length; other
    columns aren't read; an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    blocked = F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("int"))
    judged = judged.withColumns({"suffix": F.substring_index("host", ".", -m.suffix_labels), "blocked": blocked})
    plain = ["page_id", "host", "path", F.col("r.rule").alias("rule")]
    statistics = cut(suffix_statistics(judged, m))
    trees = train(judged.where("blocked IS NOT NULL"), statistics, m)
    if trees is None:
        only = judged.agg(F.max("blocked")).first()[0]
        return judged.select(*plain, F.coalesce("r.verdict", F.lit("block" if only else "allow")).alias("verdict"))
    known, open_ = judged.where("r IS NOT NULL"), judged.where("r IS NULL")
    open_ = trees.transform(_assembled(_lexical(open_).join(small(statistics), "suffix")))
    said = F.when(F.col("prediction") > 0, "block").otherwise("allow")
    return known.select(*plain, F.col("r.verdict").alias("verdict")).unionByName(open_.select(*plain, said.alias("verdict")))
