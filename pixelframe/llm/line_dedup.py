"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line is cut into max_edits + 1 segments. Two lines within max_edits edits share at least one of them, at
nearly the same place: each line looks up its substrings, for every shorter length and segment, in an index
of segments by (length, number, text). A banded bit-parallel edit distance verifies what is found.

Any other max_edits + 1 disjoint pieces of a line would do as well as its segments. So lines that meet in a
segment of very many lines are joined anew. Each is first held against the earliest line that it equals but for
max_edits neighbouring characters: one earlier neighbour is all that a line needs. Those that have none so are joined with all
by the rarest short pieces of each, in place of its segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.color import let
from pixelframe.llm.common import cut, sharing, small, tidy

#: A segment of more lines than this is hot. A line has some hundreds of pieces; up to here, comparing all is less work.
HOT = 64
#: Copies of a line beyond this share of all lines are left out of the index; fewer than 1 / HOT_COPIES lines have as many.
HOT_COPIES = 1e-4
#: Code points that the verification reads before it looks whether a pair is lost already.
CHUNK = 32
#: Lines of up to this length are held against those that differ in neighbouring characters only; longer ones are joined without.
WINDOWED = 256
#: Letters by class, for the bound by letter counts.
CLASSES = ("aiqy", "bjrz", "cks", "dlt", "emu", "fnv", "gow", "hpx")
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """Lines of at least min_chars code points that are within max_edits edits are duplicates."""

    max_edits: int = 2
    min_chars: int = 20

    def __post_init__(self):
        if not 0 <= self.max_edits <= 30 or self.min_chars <= self.max_edits:
            raise ValueError("0 <= max_edits <= 30 and min_chars > max_edits are required")


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by)).cast("int")


def _lookups(rules: LineRules) -> Column:
    """What each line looks up: segment i of lines that are shorter by less, at its place there plus move.

    Segment i (from 0) can only match at places that leave both what stands before and what stands after it
    within the edits that the other segments may have. Lookups with less and move 0 are the line's own segments.
    """
    t = rules.max_edits
    found = [(i, d, move) for i in range(t + 1) for d in range(t + 1) for move in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("less"), F.lit(m).alias("move")) for i, d, m in found])


def _keys(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(key, h, own) of lines (h, n, line): the hashes of what each looks up, own being 1 for its own segments."""
    parts = rules.max_edits + 1
    each = lines.select("h", "n", "line", F.explode(_lookups(rules)).alias("k")).withColumn("m", F.col("n") - F.col("k.less"))
    short, spare = _div(F.col("m"), parts), parts - F.pmod("m", F.lit(parts)).cast("int")  # the last segments are the longer ones
    at = F.col("k.i") * short + F.greatest(F.lit(0), F.col("k.i") - spare) + F.col("k.move")
    each = each.withColumn("at", at).withColumn("size", short + F.when(spare <= F.col("k.i"), 1).otherwise(0))
    each = each.where((F.col("m") >= rules.min_chars) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    own = ((F.col("k.less") == 0) & (F.col("k.move") == 0)).cast("byte")
    return each.select(F.xxhash64("m", "k.i", F.substring("line", F.col("at") + 1, F.col("size"))).alias("key"), "h", own.alias("own"))


def _shared_prefix(a: Column, b: Column, most: Column, reverse: bool = False) -> Column:
    """A number of code points, at most most, in which a and b begin (reverse: end) alike; found by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    part = lambda s, at, n: F.substring(s, F.char_length(s) - at - n + 1 if reverse else at + 1, n)
    return F.aggregate(steps, F.lit(0), lambda at, n: at + F.when((at + n <= most) & (part(a, at, n) == part(b, at, n)), n).otherwise(0))


def edit_distance_at_most(a: Column, b: Column, most: int) -> Column:
    """Whether two strings are within most (at most 30) edits; null if one is null.

    What both begin and end with is taken off. The band of 2 * most + 1 diagonals is one long of vertical
    differences per character of b, advanced by bit operations; the score runs down the band's lower edge and
    then along a's last row. It never falls on the edge, and by one a character at most in the row, so a pair
    that is too far off ends with the chunk in which that shows.
    """
    width = 2 * most + 1
    full, one, zero = (1 << width) - 1, F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda x, k: F.call_function("shiftright", x, k).bitwiseAND(one)

    def matches(p: Column, c: Column, j: Column) -> Column:
        out = zero
        for k in range(width):
            out = out + F.when(F.get(p, j + (k - most)) == c, F.lit(1 << k).cast("long")).otherwise(zero)
        return out

    def advance(s: Column, match: Column, j: Column, m: Column) -> Column:
        def vertical(x: Column) -> Column:
            d0 = x.d0
            hp = s.vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(s.vp))).bitwiseAND(F.lit(full))
            return F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(s.vp).alias("hn"))

        def slide(x: Column) -> Column:
            row = F.greatest(F.lit(0), 2 * most - 1 - (j - (m - most))).cast("int")
            score = s.score + F.when(j < m - most, one - bit(x.d0, F.lit(2 * most))).otherwise(bit(x.hp, row) - bit(x.hn, row))
            low = F.shiftright(x.d0, 1)
            vp = x.hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(x.hp))).bitwiseAND(F.lit(full))
            return F.struct(vp.alias("vp"), low.bitwiseAND(x.hp).alias("vn"), score.alias("score"))

        d0 = (((match.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)).bitwiseOR(match).bitwiseOR(s.vn)).bitwiseAND(F.lit(full))
        return let(let(F.struct(d0.alias("d0")), vertical), slide)

    def distance(x: Column) -> Column:
        m, n = F.size(x.p), F.size(x.t)
        start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("vp"), zero.alias("vn"), F.lit(most).cast("long").alias("score"))

        def chunk(s: Column, c: Column) -> Column:
            columns = F.sequence(c, F.least(c + CHUNK, n) - 1)
            return F.when(s.score > n - m + 2 * most, s).otherwise(F.aggregate(columns, s, lambda v, j: advance(v, matches(x.p, F.get(x.t, j), j), j, m)))

        return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), start, chunk, lambda s: s.score)

    def core(x: Column) -> Column:
        m, n = F.char_length(x.a), F.char_length(x.b)
        score = let(F.struct(F.split(x.a, "").alias("p"), F.split(x.b, "").alias("t")), distance)
        return F.when((m <= most) | (n <= most), F.levenshtein(x.a, x.b) <= most).otherwise(score <= most)

    def ends(x: Column) -> Column:
        take = lambda s: F.substring(s, x.head + 1, F.char_length(s) - x.head - x.tail)
        return let(F.struct(take(a).alias("a"), take(b).alias("b")), core)

    shorter = F.least(F.char_length(a), F.char_length(b))
    tail = lambda x: F.struct(x.head.alias("head"), _shared_prefix(a, b, shorter - x.head, True).alias("tail"))
    near = let(let(F.struct(_shared_prefix(a, b, shorter).alias("head")), tail), ends)
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > most, False).when(a.isNotNull() & b.isNotNull(), near)


def _letters(line: Column) -> Column:
    """How many letters of each class a line has, modulo 256, in one long."""
    low, out = F.lower(line), F.lit(0).cast("long")
    for k, letters in enumerate(CLASSES):
        n = F.char_length(low) - F.char_length(F.translate(low, letters, ""))
        out = out.bitwiseOR(F.shiftleft(F.pmod(n, F.lit(256)).cast("long"), 8 * k))
    return out


def _letters_apart(x: Column, y: Column) -> Column:
    """By how many letters two lines differ at least; an edit makes it 2 at most."""
    out = F.lit(0).cast("long")
    for k in range(len(CLASSES)):
        d = F.pmod(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftright(y, 8 * k).bitwiseAND(F.lit(255)), F.lit(256))
        out = out + F.least(d, 256 - d)
    return out


def _window_pairs(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(a, b): for each of lines (h, at, n, line) the earliest line b that it equals but for max_edits neighbouring characters, if there is one before it."""
    t = rules.max_edits
    each = lines.where((F.col("n") <= WINDOWED) & F.lit(t > 0)).select("h", "at", "n", "line", F.explode(F.sequence(F.lit(0), F.col("n") - t)).alias("k"))
    key = F.xxhash64("n", "k", F.substring("line", F.lit(1), F.col("k")), F.substring("line", F.col("k") + (t + 1), F.col("n")))
    keys = each.select(key.alias("key"), F.struct("at", "h").alias("x"))
    first = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("first")).where("k > 1").select("key", "first")
    return sharing(keys, "key", first).where(F.col("first.at") < F.col("x.at")).groupBy(F.col("x.h").alias("a")).agg(F.min("first").alias("b")).select("a", F.col("b.h").alias("b"))


def _rare_piece_pairs(lines: DataFrame, of: DataFrame, rules: LineRules) -> DataFrame:
    """Pairs (a, b) of lines (h, n, line), among them all within max_edits edits of which one is in of (h), by the rarest pieces of each line.

    Each line in of has max_edits + 1 disjoint pieces of up to three code points in the index, and every line looks up all of
    its pieces. So lines that are alike but for changes of their own aren't paired for what all of them share.
    """
    t, span = rules.max_edits, 4 * rules.max_edits + 4
    size = lambda n: F.greatest(F.lit(1), F.least(F.lit(3), _div(n, 2 * (t + 1))))  # noqa: E731  choosing t of them leaves room for another
    lines = lines.join(of.select("h", F.lit(True).alias("own")), "h", "left")
    chars = lines.select("h", "n", "own", _letters(F.col("line")).alias("letters"), F.split("line", "").alias("c"))
    sizes = F.array_distinct(F.array(*[size(F.col("n") + d) for d in range(-t, t + 1)]))
    pieces = chars.select("h", "n", "own", "letters", "c", F.explode(sizes).alias("q")).select("h", "n", "own", "letters", "q", F.posexplode(F.arrays_zip("c", F.slice("c", 2, F.size("c")).alias("d"), F.slice("c", 3, F.size("c")).alias("e"))).alias("at", "p"))
    piece = F.xxhash64("q", "p.c", F.when(F.col("q") > 1, F.col("p.d")), F.when(F.col("q") > 2, F.col("p.e")))
    pieces = pieces.where(F.col("at") + F.col("q") <= F.col("n")).select("h", "n", "own", "letters", "q", "at", piece.alias("piece"))
    places = F.sequence(_div(F.greatest(F.lit(0), F.col("at") - t), span), _div(F.col("at") + t, span))
    looked = pieces.select("h", "n", "letters", "at", "piece", F.explode(places).alias("place")).select("h", "n", "letters", "at", F.xxhash64("piece", "place").alias("key"))
    rare = looked.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= HOT)
    own = pieces.where(F.col("own") & (F.col("q") == size(F.col("n")))).select("h", "at", F.xxhash64("piece", _div(F.col("at"), span)).alias("key"))
    ranked = own.join(rare, "key").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("rare"))

    def choose(got: Column, at: Column) -> Column:
        return F.when((F.size(got) > t) | F.exists(got, lambda g: F.abs(g - at) < F.col("q")), got).otherwise(F.array_append(got, at))

    # Where the rare pieces don't suffice, others of the line fill up.
    filling = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("q"), F.col("q")), lambda at: at.cast("int"))
    rarest = F.coalesce(F.transform("rare", lambda x: x["at"]), F.array().cast("array<int>"))
    chosen = chars.where("own").withColumn("q", size(F.col("n"))).join(ranked, "h", "left")
    chosen = chosen.select("h", "n", "letters", "q", "c", F.explode(F.aggregate(F.concat(rarest, filling), F.array().cast("array<int>"), choose)).alias("at"))
    letter = lambda k: F.get("c", F.col("at") + k)
    piece = F.xxhash64("q", letter(0), F.when(F.col("q") > 1, letter(1)), F.when(F.col("q") > 2, letter(2)))
    chosen = chosen.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("letters").alias("la"), F.col("at").alias("pa"), F.xxhash64(piece, _div(F.col("at"), span)).alias("key"))
    alike = (F.abs(F.col("n") - F.col("na")) <= t) & (F.abs(F.col("at") - F.col("pa")) <= t) & (_letters_apart(F.col("letters"), F.col("la")) <= 2 * t)
    met = looked.join(chosen, "key").where((F.col("h") != F.col("a")) & alike)
    return met.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    """docs (id, version, text) by line: id, version, pos, line."""
    return docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]


def _same_text(x: str, y: str) -> Column:
    return F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.version") == F.col(f"{y}.version"))


@tidy
def find_repeated_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """By text: id, version, first array<int>, near array<int>: the places of its lines that are the first with their
    text, and of those that are but are within max_edits edits of an earlier first line. docs: id, version, text."""
    lines = _rows(docs).where(F.col("line").rlike(WORD))
    distinct = cut(lines.groupBy(*_hashes()).agg(F.min(F.struct("id", "version", "pos")).alias("at"), F.count(F.lit(1)).alias("n"), F.first(F.char_length("line")).alias("size")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(distinct.where(F.col("n") > HOT_COPIES * total).select("h", "g", "at"))
    long = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= rules.min_chars).select("*", *_hashes())
    # Repeats of the hottest lines; other repeats only meet themselves.
    long = long.join(hot, ["h", "g"], "left").where(F.col("at").isNull() | F.struct("id", "version", "pos").eqNullSafe(F.col("at")))

    def of_several(keys: DataFrame) -> DataFrame:
        return keys.groupBy("key", "h").agg(F.max("own").alias("own")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("k")).where("n > 1 AND k > 0").select("key", "n")

    met = sharing(_keys(long.select("h", "n", "line"), rules), "key", of_several)
    met = cut(met.groupBy("key", "h", "n").agg(F.max("own").alias("own")))
    few = met.where(F.col("n") <= HOT)
    pairs = few.where("own = 1").select("key", F.col("h").alias("a")).join(few.select("key", "h"), "key").where("a <> h")
    pairs = cut(pairs.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct())
    many = met.where(F.col("n") > HOT).select("h").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(many).distinct()
    wanted = cut(distinct.where(F.col("size") >= rules.min_chars).join(wanted, "h", "left_semi").select("h", "at"))
    places = wanted.groupBy("at.id", "at.version").agg(F.collect_list(F.struct("at.pos", "h")).alias("places"))
    texts = docs.alias("d").join(small(places).alias("p"), _same_text("d", "p")).select("d.id", "d.version", "places", "text")
    taken = lambda x: F.transform(x.places, lambda p: F.struct(p.pos.alias("pos"), p.h.alias("h"), F.get(x.lines, p.pos).alias("line")))
    texts = texts.select("id", "version", F.explode(let(F.struct("places", F.split("text", "\n", -1).alias("lines")), taken)).alias("x"))
    texts = cut(texts.select("x.h", F.struct("id", "version", "x.pos").alias("at"), F.char_length("x.line").alias("n"), "x.line").dropDuplicates(["h", "at"]))
    if not many.isEmpty():
        lines = cut(texts.join(many, "h", "left_semi"))
        found = cut(_window_pairs(lines, rules))
        rest = cut(lines.select("h").join(found.select(F.col("a").alias("h")), "h", "left_anti").distinct())
        pairs = pairs.union(found)
        if not rest.isEmpty():
            pairs = pairs.union(_rare_piece_pairs(lines.select("h", "n", "line"), rest, rules))
        pairs = cut(pairs.distinct())
    ends = lambda a, at, line: texts.select(F.col("h").alias(a), F.col("at").alias(at), F.col("line").alias(line))
    both = pairs.join(ends("a", "xat", "x"), "a").join(ends("b", "yat", "y"), "b")
    near = both.where(edit_distance_at_most(F.col("x"), F.col("y"), rules.max_edits)).select(F.greatest("xat", "yat").alias("at")).distinct()
    every = distinct.select("at.*", F.lit(False).alias("again")).union(near.select("at.*", F.lit(True)))
    return every.groupBy("id", "version").agg(F.collect_list(F.when(~F.col("again"), F.col("pos"))).alias("first"), F.collect_list(F.when(F.col("again"), F.col("pos"))).alias("near"))


@tidy
def _judged(docs: DataFrame, rules: LineRules) -> DataFrame:
    """docs as (row, j): all of a row's columns, and text, n_lines, n_exact, n_near after the dedup; j is null for a null text."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    plan = cut(find_repeated_lines(docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text"), rules))

    def judged(s: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(s.lines) - 1), lambda k: ~F.get(s.lines, k).rlike(WORD))
        kept = F.array_sort(F.concat(blank, F.array_except(s.first, s.near)))
        n = F.size(s.lines)
        counts = {"n_lines": n, "n_exact": n - F.size(blank) - F.size(s.first), "n_near": F.size(s.near)}
        text = F.when(F.size(kept) == n, F.array_join(s.lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda k: F.get(s.lines, k)), "\n"))
        return F.struct(text.alias("text"), *[v.cast("long").alias(k) for k, v in counts.items()])

    none = F.array().cast("array<int>")
    given = F.struct(F.split("k.row.text", "\n", -1).alias("lines"), F.coalesce("first", none).alias("first"), F.coalesce("near", none).alias("near"))
    out = keyed.alias("k").join(plan.alias("p"), _same_text("k", "p"), "left")
    return out.select("row", F.when(F.col("k.row.text").isNotNull(), let(given, judged)).alias("j"))


def _columns(docs: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("j.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in without]


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs with its text less the duplicate lines, and n_lines, n_exact, n_near in place of columns of these names.

    A line is one of the pieces between line feeds. A line with a word goes if the same line stands earlier,
    by (doc_id, text, place), or if it has min_chars code points or more and its first occurrence is within
    max_edits edits of a line that first occurs earlier, whether that one stays or not. Lines without a word
    stay. A null text stays null, with 0 lines; an empty text is one empty line. Rows that repeat both doc_id
    and text count as one document and lose the same lines; rows that repeat a doc_id with other texts are
    documents of their own, in an order by the text's hash. A null id comes before all others. Texts and lines
    may be of any length. Other columns may have any name.
    """
    counts = ("n_lines", "n_exact", "n_near")
    return _judged(docs, rules).select(*_columns(docs, counts), *[F.coalesce(f"j.{c}", F.lit(0).cast("long")).alias(c) for c in counts])


def line_digest(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, kept_sha256 (of the text that stays; of the empty text for null) per row of docs."""
    return dedup_lines(docs.select("doc_id", "text"), rules).select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs, with its own columns, without its duplicate lines (see dedup_lines); a document of which no word stays goes,
    unless it had none before: null, empty and blank texts stay. Repeated rows stay or go together; an empty table gives none."""
    out = _judged(docs, rules)
    had = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    return out.where(~had | F.col("j.text").rlike(WORD)).select(*_columns(docs))
