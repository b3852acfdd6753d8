"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import decontaminate, html_extract, importance_resampling, license_scan, line_dedup, minhash_dedup, periodic_runs, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, url_filter
from pixelframe.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.code_digest(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.find_near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"), prepare=periodic_runs.repeated_from_a_place)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(8) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM (SELECT doc_id, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT source, unnest(['any', 'too_short', 'repetitive', 'symbols', 'repeated_lines']) AS rule, unnest([base_failed, n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 10 * word_chars, 100 * n_dup_lines > 50 * n_lines]) AS failed, unnest(range(5)) AS k FROM b WHERE source IS NOT NULL),
h AS (SELECT source, rule, k, count(*) AS n, count(*) FILTER (failed) AS x FROM f GROUP BY ALL),
tot AS (SELECT rule, sum(x) / sum(n) AS mean, sum(CAST(n AS DOUBLE) * n) AS squares, sum(x * x / n) AS spread, count(*) AS hosts, sum(n) AS docs FROM h GROUP BY rule),
mom AS (SELECT rule, mean, 1 - squares / docs / docs - (hosts - 1) / docs AS room, CASE WHEN mean > 0 AND mean < 1 THEN (spread / docs - mean * mean) / (mean * (1 - mean)) - (hosts - 1) / docs - sqrt(2 * (hosts - 1)) / docs ELSE 0 END AS between_ FROM tot),
prior AS (SELECT rule, mean, CASE WHEN between_ > 0 AND room > 0 THEN least(1000.0, greatest(1.0, room / between_ - 1)) ELSE 1000.0 END AS strength FROM mom),
r AS (SELECT source, max(n) AS host_docs, max(x) FILTER (k = 0) AS host_failures, coalesce(string_agg(rule, ',' ORDER BY k) FILTER (round((x + mean * strength) / (n + strength), 9) >= 0.5), '') AS host_rules FROM h JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, coalesce(host_docs, 0) AS host_docs, coalesce(host_failures, 0) AS host_failures,
  coalesce(host_rules, '') AS host_rules, coalesce(host_rules, '') <> '' AS host_rejected, NOT base_failed AND coalesce(host_rules, '') = '' AS kept
FROM b LEFT JOIN r USING (source)
"""

# Pairs within two edits share a third of one at nearly the same place; levenshtein decides.
OP3_SQL = r"""
WITH l AS (SELECT doc_id, i AS pos, w[i] AS line FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL))),
f AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS loc FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
long AS (SELECT * FROM f WHERE n >= 20),
cutup AS (SELECT line, n, loc, i, substr(line, CAST(1 + i * (n // 3) AS INT), CAST(n // 3 AS INT)) AS s FROM long, range(3) t(i)),
probes AS (SELECT DISTINCT line, n, loc, i, n - d AS k, substr(line, CAST(1 + i * ((n - d) // 3) + mv AS INT), CAST((n - d) // 3 AS INT)) AS s FROM long, range(3) t(i), range(-2, 3) u(d), range(-2, 3) v(mv) WHERE 1 + i * ((n - d) // 3) + mv >= 1),
near AS (SELECT DISTINCT p.loc FROM probes p JOIN cutup c ON c.i = p.i AND c.n = p.k AND c.s = p.s WHERE c.loc < p.loc AND levenshtein(c.line, p.line) <= 2),
o AS (SELECT l.doc_id, l.pos, l.line, f.loc IS NOT NULL AND f.loc <> (l.doc_id, l.pos) AS ex, f.loc = (l.doc_id, l.pos) AND f.loc IN (SELECT loc FROM near) AS nr FROM l LEFT JOIN f USING (line)),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (ex) AS n_exact, count(*) FILTER (nr) AS n_near, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT ex AND NOT coalesce(nr, false)) AS t FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, g.g),
k AS (SELECT sp.doc_id, a, z, substr(x, 2 * coalesce(lag(z) OVER w, 0) + 1, 2 * (a - coalesce(lag(z) OVER w, 0))) AS gap, lead(a) OVER w IS NULL AS final, x FROM sp JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
o AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(gap, '' ORDER BY a) || any_value(substr(x, 2 * z + 1)) FILTER (final) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""


def _op5_sql() -> str:
    """Spans by the pieces between matches; RE2 needs the letters in both cases spelt out, as its (?i) goes beyond ASCII."""
    import re

    parts = []
    for k, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("(?i)", "")
        if p != r.pattern:
            head, tail = p.split(")", 1)
            p = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + tail
        p = p.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, CAST(sum(gap + n) OVER w - n AS BIGINT) AS a, CAST(sum(gap + n) OVER w AS BIGINT) AS z, g >= {r.min_length} AS ok FROM (
  SELECT doc_id, i, length(p[i]) AS gap, length(m[i]) AS n, length(j[i]) AS g FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS j FROM d))) WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
every AS ({" UNION ALL ".join(parts)}),
s AS (SELECT *, kind || ':' || a || ':' || z AS s FROM every WHERE ok),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
win AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM win JOIN pat USING (m, s)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(13) t(k) WHERE k < m GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n_shingles + y.n_shingles - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

# The table of checksums is made bit by bit; a checksum goes over the bytes of a word or an id.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS INT)])), 4294967295)"


WORDS11 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, unnest({WORDS11}) AS word FROM documents), t AS (SELECT unnest({WORDS11}) AS word FROM benchmark),
w AS MATERIALIZED (SELECT word, {_crc('word')} % 10000 AS b FROM (SELECT word FROM d UNION SELECT word FROM t), crc_table),
s AS (SELECT b, count(*) AS n FROM d JOIN w USING (word) GROUP BY b), g AS (SELECT b, count(*) AS n FROM t JOIN w USING (word) GROUP BY b),
gain AS (SELECT w.b, floor(1000 * ln(CAST(coalesce(g.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM d) + 10000) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM t) + 10000)))) AS gain FROM (SELECT DISTINCT b FROM w) w LEFT JOIN s USING (b) LEFT JOIN g USING (b)),
m AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN w USING (word) JOIN gain USING (b) GROUP BY doc_id),
e AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.*, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

# Two words q apart agree over a run; a run of eight such words and more is seen as pairs of equal windows.
OP12_SQL = f"""
WITH {CRC_TABLE}, c AS (SELECT doc_id, {_crc('CAST(doc_id AS VARCHAR)')} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc_table),
k AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM c), p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM k),
words AS MATERIALIZED (SELECT doc_id, n, i, w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1 AS INT)] AS word FROM (SELECT *, len(w) AS n, unnest(range(len(w))) AS i FROM p)),
texts AS MATERIALIZED (SELECT doc_id, n, list(word ORDER BY i) AS w FROM words GROUP BY ALL),
win AS (SELECT doc_id, n, i, array_to_string(w[CAST(i + 1 AS INT) : CAST(i + 8 AS INT)], ' ') AS s FROM (SELECT *, unnest(range(n - 7)) AS i FROM texts WHERE n >= 24)),
again AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM runs) WHERE k = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN top USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_line_dedup, op4_suffix_dedup, op5_secret_scan, op6_sentencepiece, op7_html_extract, op8_decontaminate, op9_token_counts, op10_minhash_dedup, op11_importance_resampling, op12_periodic_runs, op13_url_filter)}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_secret_scan": _op5_sql(), "op8_decontaminate": OP8_SQL, "op10_minhash_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_periodic_runs": OP12_SQL}
