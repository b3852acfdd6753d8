"""Importance resampling, periodic runs and URL filters against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pixelframe.llm import importance_resampling, linear_grouping, periodic_runs, url_filter

SCHEMA = "doc_id long, text string, score string, a string"
r = random.Random(21)
NAMES = [f"w{k}" for k in range(40)]
DOCS = [(k, " ".join(r.choices(NAMES, k=r.choice([0, 5, 19, 20, 30, 60]))), "x", "y") for k in range(150)]
DOCS += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "Ünï çode, W1-w2. " * 9, "x", "y"), (203, "w1 w2 w3 " * 20_000, "x", "y"), (None, DOCS[4][1] + " w1" * 30, "x", "y"), (7, " ".join(NAMES), "x", "y"), (7, " ".join(NAMES), "x", "y"), (8, " ".join(NAMES), "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_resampling(spark, docs, none):
    target = [" ".join(NAMES[:9]) * 3, None, "w3 w4 other"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for p in (importance_resampling.Resampling(), importance_resampling.Resampling(share_pct=35, buckets=50, shortest=1, longest=2, seed=1)):
        def buckets(t):
            w = words(t)
            return [crc32(" ".join(w[k : k + n]).encode()) % p.buckets for n in range(p.shortest, p.longest + 1) for k in range(len(w) - n + 1)]

        s, t = [b for d in DOCS for b in buckets(d[1])], [b for x in target for b in buckets(x)]
        gain = {b: math.floor(1000 * math.log((t.count(b) + 1) * (len(s) + p.buckets) / ((s.count(b) + 1) * (len(t) + p.buckets)))) for b in set(s)}
        rows = []
        for d in DOCS:
            h = int(hashlib.sha256(f"{p.seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
            weight = sum(gain[b] for b in buckets(d[1]))
            rows.append([d[0], len(buckets(d[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d[1]))])
        drawn = sorted((x for x in rows if x[5] >= p.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
        for k, x in enumerate(drawn[: len(drawn) * p.share_pct // 100]):
            x[4] = k + 1
        got = importance_resampling.resample(docs, wanted, p)
        assert sorted(map(repr, (tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()))) == sorted(repr(tuple(x[:5])) for x in rows)
    assert importance_resampling.resample(none, wanted).count() == 0
    assert importance_resampling.resample(docs, wanted.limit(0)).where("rank IS NOT NULL").count() > 0


def test_cutoff(spark, monkeypatch):
    """The k-th key of tables with many ties, in few rounds, whether what is left is written anew or not."""
    for rewrite in (importance_resampling.REWRITE, 10):
        monkeypatch.setattr(importance_resampling, "REWRITE", rewrite)
        for spread, k in ((3, 1), (3, 400), (10**6, 777), (10**6, 1000)):
            keys = [(r.randrange(-spread, spread), r.randrange(3)) for _ in range(1000)]
            best = sorted(keys, reverse=True)
            got = importance_resampling.find_cutoff(spark.createDataFrame(keys, "a long, b long").repartition(5), k)
            assert got == (best[k - 1], sum(x > best[k - 1] for x in keys))


def brute_lyndon(s):
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def test_lyndon_lengths():
    for k in range(400):
        s = [r.randrange(2 + k % 3) for _ in range(r.randrange(0, 40))] * (1 + k % 4)
        assert linear_grouping.lyndon_lengths(s) == brute_lyndon(s)


def brute_runs(s):
    found = {}
    for q in range(1, len(s) // 3 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            z = i
            while z + q < len(s) and s[z] == s[z + q]:
                z += 1
            if z + q - i >= max(24, 3 * q):
                found.setdefault((i, z + q - i), q)  # the least period comes first
            i = z + 1
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs():
    seen = 0
    for k in range(300):
        s, names = [], [b"a", b"b", b"c"][: 1 + k % 3] if k % 2 else [b"%d" % j for j in range(30)]
        for _ in range(r.randrange(1, 5)):
            s += r.choices(names, k=r.randrange(0, 20))
            s += (r.choices(names, k=r.randrange(1, 15)) * r.randrange(1, 9))[r.randrange(0, 3) :]
        want = brute_runs(s)
        seen += len(want)
        assert periodic_runs.runs_of_words(s) == want
    assert seen > 300


def test_run_digest(docs, none):
    want = []
    for d in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")
        h = crc32(str(d[0]).encode())
        if d[0] is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 3)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else None
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((d[0], len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = periodic_runs.run_digest(docs, prepare=periodic_runs.repeated_from_a_place)
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, want))
    assert any(x[1] for x in want) and periodic_runs.run_digest(none).count() == 0


URLS = [
    (1, None), (2, ""), (3, "no host"), (4, "http://"), (5, "http://A.Com/x?y#z"), (6, "https://x.example.com/en/1"), (7, "https://www.Example.com/en/1"), (8, "https://a.www.example.com/en/1"), (9, "http://example.com"), (10, "http://com/"),
    (11, "http://a.net/es/"), (12, "http://a.net/es"), (13, "http://net/fr/2?q=a://b"), (14, "ftp://notcom/en/"), (15, "http://a.com?x=/en/"), (16, "a://b://c/d\ne#f"), (17, "http://x.org/" + "long/" * 50_000), (1, "http://x.com/"), (1, "http://x.com/"), (18, "http://É.net/es/Ä#"),
]


def brute_url(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [x for x in url_filter.RULES if (f".{host}").endswith(f".{x.host}") and path.startswith(x.path)]
    best = max(fit, key=lambda x: len(x.host + x.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_url_rules(spark):
    pages = spark.createDataFrame([(*u, "h", "p") for u in URLS], "page_id long, url string, host string, features string")
    got = url_filter.filter_urls(pages).collect()
    assert sorted(((x.page_id, x.host, x.path, x.rule) for x in got), key=repr) == sorted(((k, *brute_url(u)[:3]) for k, u in URLS), key=repr)
    verdicts = {(x.page_id, x.host, x.path): x.verdict for x in got}
    for k, u in URLS:
        host, path, _, verdict = brute_url(u)
        assert verdicts[k, host, path] == verdict or verdict is None and verdicts[k, host, path] in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {x.verdict for x in url_filter.filter_urls(pages.where("page_id IN (3, 14)")).collect()} == {"allow"}
    assert {x.verdict for x in url_filter.filter_urls(pages.where("page_id IN (3, 11, 14)")).collect()} == {"block"}


def test_trees_on_held_out_urls(spark):
    """Blocked URLs have many digits and parameters, or hyphens; what no rule labels is judged as it is written."""
    data = []
    for k in range(1200):
        bad = k % 3 == 0
        name = "".join(r.choices("abcdefgh", k=8))
        url = f"{name}-{r.randrange(10**6)}.{{}}/es/p?{'&'.join(f'a{j}={r.randrange(10**4)}' for j in range(5))}" if bad else f"{name}.{{}}/es/{''.join(r.choices('klmnop', k=12))}/{name}"
        data.append((k, "http://" + url.format("org" if k % 4 == 0 else "net" if bad else "com"), bad))
    pages = spark.createDataFrame(data, "page_id long, url string, bad boolean")
    got = url_filter.filter_urls(pages).where("rule IS NULL").join(pages.select("page_id", "bad"), "page_id")
    n, right = got.agg(F.count(F.lit(1)), F.count_if((F.col("verdict") == "block") == F.col("bad"))).first()
    assert n == 300 and right >= 0.95 * n
