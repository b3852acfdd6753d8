"""HTML extraction by wrapper induction.

Pages of a host are aligned with a reference page of it, one for each frequent outline, by simple tree
matching. A text slot of the
reference that holds the same text on most pages is template, inside an article too; slots that vary are
content. An article or main element, where there is one, says where the content is. What the tags mark as
navigation, forms or the like is never content. What class names mark as such isn't either, unless it holds
the article or most of the text that varies.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, small, small_batches

# Tag names of HTML, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr #text".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P, HOLDS_P = frozenset(["p"]), frozenset("table td th li div article section main body button blockquote".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
DROPPED = frozenset("nav aside footer form script style noscript template iframe head title button select textarea input menu dialog svg object canvas audio video".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice paywall popup promo promoted reactions related replies respond search share sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe toolbar widget complementary contentinfo alert".split())
#: Marks of what readers write: it varies from page to page, and is still no content.
REPLIES = frozenset("comment comments commentlist disqus reactions related replies respond".split())
#: A class name that begins so tells of the page's state, and marks nothing: has-sidebar, no-comments.
STATES = frozenset("has had no not with without is hide hides show shows".split())

RAW_TAGS = frozenset("script style textarea title noscript template iframe xmp".split())
#: A tag ends at the first > outside a value in quotes, which begin right after =; quotes elsewhere are part of a name or value.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")
#: A tag of a page on which a value's quotes don't end, or which ends inside a tag.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: The end of the attributes of a tag that closes itself.
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
MARKED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass(frozen=True)
class WrapperRules:
    """A slot is template if at least min_pages pages fill it and constant_share of them with the same text.

    Repeated pages and near copies count as one page. An outline has a reference of its own if it has min_pages
    pages and outline_share of the host's; pages of others are aligned with that of the most frequent outline.
    """

    min_pages: int = 4
    constant_share: float = 0.6
    outline_share: float = 0.05


class Node:
    __slots__ = ("tag", "marks", "kids", "text", "shape", "height", "slot")

    def __init__(self, tag: str, marks: frozenset = frozenset(), text: str = ""):
        self.tag, self.marks, self.kids, self.text, self.shape, self.height, self.slot = tag, marks, [], text, 0, 0, -1


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of a closing tag, name, attributes) of all markup, in order; the name is empty for comments, and for elements whose content is no markup, with it.

    Each character is read a few times at most, whatever quotes and brackets are left open. A < that begins no tag is text.
    """
    at, pattern, last = 0, TAG, page.rfind(">")
    while 0 <= (low := page.find("<", at)):
        if page.startswith("<!--", low):
            end = page.find("-->", low + 2)
            at = end + 3 if end >= 0 else len(page)
            yield low, at, "", "", ""
            continue
        if low > last:
            return
        if page[low + 1] in "!?":
            at = page.find(">", low) + 1
            yield low, at, "", "", ""
            continue
        m = pattern.match(page, low)
        if not m and page[low + 1 : low + 3].lstrip("/")[:1].isalpha():
            pattern = PLAIN_TAG
            m = pattern.match(page, low)
        if not m:
            at = low + 1
            continue
        name, at = m[2].lower(), m.end()
        if name in RAW_TAGS and not m[1]:
            close = CLOSING[name].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at, name = end + 1 if end >= 0 else len(page), ""
        yield low, at, m[1], name, m[3]


def parse(page: str | None) -> Node:
    """A page as a tree. Tags that are left open end where their parent does, or where HTML implies it."""
    root = Node("#root")
    stack, at, page, texts = _Stack([root]), 0, page or "", []
    open_ = stack.open
    for start, end, closing, tag, attributes in markup(page):
        if start > at:
            texts.append(page[at:start])
        at = end
        if not tag:  # comments don't part a text
            continue
        if texts:
            _add_text(stack, texts)
        if closing:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                stack.cut(k)
            continue
        if tag in CLOSES_P:
            if open_["p"]:
                _close(stack, P, HOLDS_P)
        if tag in SIBLINGS:
            _close(stack, SIBLINGS[tag], HOLDS[tag])
        node = Node(tag, _marks(attributes) if attributes else frozenset())
        stack[-1].kids.append(node)
        if tag not in VOID and not ("/" in attributes and CLOSED.search(attributes[-8:])):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        texts.append(page[at:])
    _add_text(stack, texts)
    _shapes(root)
    return root


class _Stack(list):
    """The open elements, and how many there are of each name."""

    def __init__(self, nodes):
        super().__init__(nodes)
        self.open = defaultdict(int)

    def cut(self, k: int) -> None:
        for n in self[k:]:
            self.open[n.tag] -= 1
        del self[k:]


def _marks(attributes: str) -> frozenset:
    names = [n for x in MARKED.findall(attributes) for n in "".join(x).lower().split()]
    words = [[w for w in re.split(r"[^a-z0-9]+", n) if w] for n in names]
    return MARKS.intersection(w for n in words if n and not (len(n) > 1 and n[0] in STATES) for w in n)


def _add_text(stack: _Stack, raw: list[str]) -> None:
    if raw:
        stack[-1].kids.append(Node("#text", text="".join([entities.unescape(t) if "&" in t else t for t in raw])))
        raw.clear()


def _close(stack: _Stack, tags: frozenset[str], within: frozenset[str]) -> None:
    for t in tags:
        if stack.open[t]:
            break
    else:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            stack.cut(k)
            return
        if stack[k].tag in within:
            return


def _walk(root: Node):
    """(node, ancestors' flags) in page order without recursion; depth is not bounded by Python's stack."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.kids)


def _shapes(root: Node) -> None:
    for n in reversed(list(_walk(root))):
        kids = n.kids
        if kids:
            n.shape = hash((n.tag, tuple([k.shape for k in kids])))
            n.height = 1 + max([k.height for k in kids])
        else:
            n.shape = hash((n.tag, ()))


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-keeping alignment of two trees' nodes, as pairs, from their roots down.

    Nodes match under matched parents and with the same tag. The size of a match depends on shapes only, so
    each pair of shapes is solved once, the lower ones first; depth is not bounded.
    """
    if a.tag != b.tag:
        return []
    known: dict[tuple[int, int], int] = {}

    def table(x: Node, y: Node) -> list[list[int]]:
        rows = [[0] * (len(y.kids) + 1)]
        for p in x.kids:
            above, row = rows[-1], [0]
            for j, q in enumerate(y.kids):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if p.tag == q.tag:
                    w = above[j] + known[p.shape, q.shape]
                    best = w if w > best else best
                row.append(best)
            rows.append(row)
        return rows

    pairs = [(a, b)]
    for x, y in pairs:  # grows as it is read
        for p in x.kids:
            for q in y.kids:
                if p.tag == q.tag and (p.shape, q.shape) not in known:
                    known[p.shape, q.shape] = 1
                    if p.kids and q.kids:
                        pairs.append((p, q))
    for x, y in sorted(pairs[1:], key=lambda xy: xy[0].height):
        known[x.shape, y.shape] = 1 + table(x, y)[-1][-1]

    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if not x.kids or not y.kids:
            continue
        rows, i, j = table(x, y), len(x.kids), len(y.kids)
        while i and j:
            p, q = x.kids[i - 1], y.kids[j - 1]
            if p.tag == q.tag and rows[i][j] == rows[i - 1][j - 1] + known[p.shape, q.shape]:
                todo.append((p, q))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def outline(root: Node, depth: int = 4) -> int:
    """A hash of which block elements are in which, in the upper levels of a page; how many there are of each doesn't matter."""
    paths, todo = set(), [(root, "", 0)]
    while todo:
        n, path, level = todo.pop()
        path = f"{path}/{n.tag}.{'.'.join(sorted(n.marks))}"
        paths.add(path)
        if level < depth:
            todo += [(k, path, level + 1) for k in n.kids if k.tag not in INLINE and k.tag not in VOID]
    return _digest("\n".join(sorted(paths)))


def _digest(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass")) - 2**63


def reference(page: str | None) -> Node:
    """A reference page, its texts numbered as slots."""
    root = parse(page)
    for k, n in enumerate(n for n in _walk(root) if n.tag == "#text"):
        n.slot = k
    return root


def fill_slots(page: Node, ref: Node) -> list[tuple[int, Node]]:
    return [(y.slot, x) for x, y in match_trees(page, ref) if y.slot >= 0]


def _hides(n: Node, keep: set[int]) -> bool:
    return n.tag in DROPPED or bool(n.marks) and n.tag not in ("html", "body") and id(n) not in keep


def _homes(page: Node, tag: str, marked: bool) -> tuple[list[Node], set[int]]:
    """The elements named tag that nothing hides, and the marked nodes to keep for them.

    If all are hidden by marks, the marks around them are those of wrappers, and are kept. marked: elements
    named tag count that have marks of their own.
    """
    free, bound, todo = [], [], [(page, (), False)]
    while todo:
        n, around, gone = todo.pop()
        if n.tag == tag and not gone and (marked or not n.marks):
            around = (*around, n) if n.marks else around
            (bound if around else free).append((n, around))
        elif n.marks and n.tag not in ("html", "body"):
            around = (*around, n)
        gone = gone or n.tag in DROPPED or bool(n.marks & REPLIES and n.tag not in ("html", "body"))
        todo += [(k, around, gone) for k in n.kids]
    found = free or bound
    return [n for n, _ in found], {id(w) for _, around in found for w in around}


def _varying_wrappers(scope: list[Node], varying: set[int], template: set[int]) -> set[int]:
    """The marked nodes in scope whose varying text is more than half of all that is no template; those of replies never do."""
    todo, order, size, whole = [(n, False) for n in scope], [], {}, 0
    while todo:
        n, gone = todo.pop()
        gone = gone or n.tag in DROPPED or bool(n.marks & REPLIES)
        own = 0 if gone or id(n) in template else len(n.text.strip())
        whole += own
        size[id(n)] = own if id(n) in varying else 0
        order.append(n)
        todo += [(k, gone) for k in n.kids]
    for n in reversed(order):
        size[id(n)] += sum(size[id(k)] for k in n.kids)
    return {id(n) for n in order if n.marks and 2 * size[id(n)] > whole}


def main_text(page: Node, template: set[int], varying: set[int] = frozenset()) -> str:
    """The blocks of the content. template and varying: ids of text nodes that are the host's template, and that vary on its pages."""
    for home, marked in (("article", False), ("main", True), ("article", True), (None, False)):
        homes, keep = _homes(page, home, marked) if home else ([], set())
        if homes:
            break
    keep |= _varying_wrappers(homes or [page], varying, template) if varying else set()
    at = {id(n) for n in homes}
    blocks, line = [], []

    def end() -> None:
        words = " ".join("".join(line).split())
        if words:
            blocks.append(words)
        line.clear()

    todo = [(page, home is None, False)]
    while todo:
        n, inside, leaving = todo.pop()
        if leaving:
            end()
            continue
        if n.tag == "#text":
            if inside and id(n) not in template:
                line.append(n.text)
            continue
        if _hides(n, keep) or n.tag == "header" and not inside or n.tag == "header" and home is None:
            if n.tag not in INLINE:
                end()
            continue
        inside = inside or id(n) in at
        if n.tag == "br":
            line.append(" ")
        if n.tag not in INLINE and n.tag != "br":
            end()
            todo.append((n, inside, True))
        todo += [(k, inside, False) for k in reversed(n.kids)]
    end()
    return "\n\n".join(blocks)


class _References(dict):
    def __missing__(self, page: str) -> Node:
        if len(self) >= 64:
            self.clear()
        self[page] = ref = reference(page)
        return ref


def _outlines_and_texts(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for p in pages:
        root = parse(p)
        rows.append((outline(root), list({_digest(w) for w in (" ".join(n.text.split()) for n in _walk(root) if n.tag == "#text") if w})))
    return pd.DataFrame(rows, columns=["outline", "texts"])


def _filled(pages: pd.Series, refs: pd.Series) -> pd.Series:
    known, out = _References(), []
    for p, r in zip(pages, refs):
        slots = {}
        for slot, n in fill_slots(parse(p), known[r or ""]):
            words = " ".join(n.text.split())
            if words:
                slots[slot] = {"slot": slot, "text": _digest(words), "size": len(words)}
        out.append(list(slots.values()))
    return pd.Series(out, dtype=object)


def _extracted(pages: pd.Series, refs: pd.Series, constant: pd.Series, varying: pd.Series) -> pd.Series:
    known, out = _References(), []
    for p, r, c, v in zip(pages, refs, constant, varying):
        page, same, other = parse(p), set() if c is None else set(c), set() if v is None else set(v)
        slots = fill_slots(page, known[r or ""]) if same or other else []
        out.append(main_text(page, {id(n) for k, n in slots if k in same}, {id(n) for k, n in slots if k in other}))
    return pd.Series(out, dtype=object)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def _choose_references(pages: DataFrame, rules: WrapperRules) -> tuple[DataFrame, DataFrame]:
    """(host, page, ref_outline) by distinct page, and (host, ref_outline, ref): the page with the most texts that recur on pages of its outline, the one with the fewest texts on ties."""
    sign = F.pandas_udf(_outlines_and_texts, "outline long, texts array<long>", F.PandasUDFType.SCALAR)
    signed = pages.select("host", "page", sign("html").alias("s")).groupBy("host", "page").agg(F.first("s").alias("s"))
    signed = cut(signed.select("host", "page", "s.outline", "s.texts"))
    outlines = signed.groupBy("host", "outline").agg(F.count(F.lit(1)).alias("n"))
    hosts = outlines.groupBy("host").agg(F.sum("n").alias("all"), F.max(F.struct("n", "outline")).alias("top"))
    outlines = outlines.join(hosts, "host").withColumn("frequent", (F.col("outline") == F.col("top.outline")) | (F.col("n") >= rules.min_pages) & (F.col("n") >= rules.outline_share * F.col("all")))
    outlines = cut(outlines.select("host", "outline", "n", F.when(F.col("frequent"), F.col("outline")).otherwise(F.col("top.outline")).alias("ref_outline")).where("outline is not null"))
    own = signed.join(outlines.where("outline = ref_outline").select("host", "outline", "n"), ["host", "outline"])
    texts = own.select("host", "outline", "page", "n", F.explode("texts").alias("text"))
    common = texts.groupBy("host", "outline", "text", "n").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") >= rules.min_pages) & (F.col("k") >= rules.constant_share * F.col("n"))).select("host", "outline", "text")
    score = texts.join(common, ["host", "outline", "text"]).groupBy("host", "outline", "page").agg(F.count(F.lit(1)).alias("score"))
    best = own.join(score, ["host", "outline", "page"], "left").groupBy("host", F.col("outline").alias("ref_outline")).agg(F.max_by("page", F.struct(F.coalesce("score", F.lit(0)), -F.size("texts"), "page")).alias("page"))
    refs = pages.join(best, ["host", "page"]).groupBy("host", "ref_outline").agg(F.min("html").alias("ref"))
    return cut(signed.join(outlines, ["host", "outline"]).select("host", "page", "ref_outline")), cut(refs)


def _page_keys(filled: DataFrame) -> DataFrame:
    """(host, ref_outline, page, key): near copies have the same key.

    Of a page's three longest texts in slots that aren't the same on nearly all pages, the key has the two that
    recur most. Pages whose own texts are all short, beside what nearly all pages have, share the key 0.
    """
    group = ["host", "ref_outline"]
    same = filled.groupBy(*group, "slot", "text", "size").agg(F.count(F.lit(1)).alias("n"))
    sure = same.groupBy(*group, "slot").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "size")).alias("most")).where("most.n >= 0.95 * pages")
    longest = sure.groupBy(*group).agg(F.max("most.size").alias("longest"))
    own = filled.join(sure.select(*group, "slot"), [*group, "slot"], "left_anti").join(same.select(*group, "slot", "text", "n"), [*group, "slot", "text"])
    own = own.groupBy(*group, "page").agg(F.slice(F.sort_array(F.collect_list(F.struct("size", "n", "text")), False), 1, 3).alias("top"))
    own = own.join(longest, group, "left").where(10 * F.get("top", F.lit(0))["size"] >= F.coalesce("longest", F.lit(0)))
    two = F.slice(F.sort_array(F.transform("top", lambda t: F.struct(t["n"].alias("n"), t["text"].alias("text"))), False), 1, 2)
    return own.select(*group, "page", F.xxhash64(F.transform(two, lambda t: t["text"])).alias("key"))


def induce_wrappers(pages: DataFrame, rules: WrapperRules = WrapperRules()) -> tuple[DataFrame, DataFrame]:
    """(host, page, ref_outline) by distinct page, and (host, ref_outline, ref, constant, varying): a reference, the slots of it that are template, and those that aren't though enough pages fill them.

    pages: host, html, page (its hash). Each page is aligned with one reference, never with the other pages; slots are counted
    by text hash, over distinct pages, near copies as one. Blank pages don't count.
    """
    group = ["host", "ref_outline"]
    pages = pages.where(F.col("html").rlike(r"\S"))
    chosen, refs = _choose_references(pages, rules)
    fill = F.pandas_udf(_filled, "array<struct<slot int, text long, size int>>", F.PandasUDFType.SCALAR)
    aligned = pages.join(small(chosen), ["host", "page"]).join(refs, group)
    filled = aligned.select(*group, "page", fill("html", "ref").alias("slots")).groupBy(*group, "page").agg(F.first("slots").alias("slots"))
    filled = cut(filled.select(*group, "page", F.explode("slots").alias("s")).select(*group, "page", "s.*"))
    keyed = filled.join(_page_keys(filled), [*group, "page"], "left").select(*group, "slot", "text", F.coalesce("key", F.lit(0)).alias("key")).distinct()
    same = keyed.groupBy(*group, "slot", "text").agg(F.count(F.lit(1)).alias("n"))
    slots = same.groupBy(*group, "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("most"))
    same = F.col("most") >= rules.constant_share * F.col("pages")
    known = slots.where(F.col("pages") >= rules.min_pages).groupBy(*group).agg(F.collect_list(F.when(same, F.col("slot"))).alias("constant"), F.collect_list(F.when(~same, F.col("slot"))).alias("varying"))
    return chosen, cut(refs.join(known, group, "left"))


def extract_pages(pages: DataFrame, rules: WrapperRules = WrapperRules()) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of pages.

    text: the blocks of the article, without the host's template, joined by two line feeds; empty for null or empty html and for pages
    without content. Pages without host, or with a null url, share the host "". Repeated rows are extracted
    each, and count once for the template; of slots or references that tie, one is taken by a fixed order. Pages and
    trees may be of any size and depth. An empty table gives none. Other columns aren't read.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    chosen, wrappers = induce_wrappers(pages.select("host", "html", "page"), rules)
    joined = pages.join(small(chosen), ["host", "page"], "left").join(wrappers, ["host", "ref_outline"], "left")
    text = F.pandas_udf(_extracted, "string", F.PandasUDFType.SCALAR)("html", "ref", "constant", "varying")
    out = joined.select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
