"""Main-text extraction with site template removal.

Every block element's subtree (tag, class and id, texts, children) is hashed; Spark counts on how many pages of a host
each hash occurs. Elements inside a line of text are never deleted for recurring. Subtrees that recur on a large share of a host's pages, or outside articles on many of them, are its
template and are deleted, along with what its element says is not the article (navigation, adverts, forms, comments
and the like). Both passes parse pages
inside tasks; between them only (host, hash, pages) is shuffled, counted before it leaves a task.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import host_of, staged

#: A subtree is template on more than this share of a host's pages ...
RATIO = 0.5
#: ... and on this many pages at least: a share of fewer pages says little, as copies of a page or common short blocks
#: reach it by chance.
LEAST_PAGES = 10
#: Outside articles and main parts this share is enough, on LEAST_PAGES pages; on a host with fewer pages than that,
#: more than RATIO of them, and SMALL_LEAST at least.
OUTER_RATIO = 0.05
SMALL_LEAST = 3
#: Share of a page's text that the rule for outside must leave; a page that recurs as a whole is not its template.
LEAST_REST = 0.1

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = set("head script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video nav footer aside form button select menu dialog datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or an id that mark what is not the article.
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "comment comments commentlist reply replies respond disqus widget pagination pager skip toolbar masthead".split()
)
#: Those among them that say so inside an article too, where other names need a recurring subtree as well.
STRONG_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsored comments commentlist disqus navbar breadcrumb breadcrumbs pagination pager".split())
#: Words that may stand beside them in one name ("site-footer"); any other word makes it another name ("has-sidebar").
NEUTRAL_NAMES = set("site page main global primary secondary top bottom left right area list box block bar container wrapper wrap section inner outer item items body links buttons".split())
COMMENT_NAMES = set("comment comments reply".split())
#: A new element of the first kind ends an open one of the second.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
#: ... unless one of these lies between them.
SCOPES = set("ul ol dl table article section div main body html template select".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
#: Character references whose numbers are beyond every code point, and zeros before a number.
TOO_LARGE = re.compile(r"&#(?:[1-9][0-9]{7,}+|[xX][1-9a-fA-F][0-9a-fA-F]{7,}+);?")
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
NAMES = re.compile(r"[a-z]+")


def _is_named(names: str, marks: set[str]) -> bool:
    """Whether one of the names in a class or an id consists of marks, with neutral words beside them at most."""
    for name in names.split():
        words = {x for x in NAMES.findall(name) if len(x) > 1}
        if words & marks and words <= marks | NEUTRAL_NAMES:
            return True
    return False


def _decoded(text: str) -> str:
    """Character references as characters; Python reads no number of thousands of digits."""
    if "&#" in text:
        text = TOO_LARGE.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


@lru_cache(maxsize=50_000)
def _named(names: str, tag: str, in_main: bool) -> int:
    """How surely names mark what is not the article: 0 not at all, 1 outside an article, 2 inside one too."""
    if tag == "article":
        return 2 * _is_named(names, COMMENT_NAMES)
    if _is_named(names, STRONG_NAMES):
        return 2
    return int(_is_named(names, DROPPED_NAMES) or tag != "h1" and not in_main and _is_named(names, {"header"}))


class Page:
    """A parsed page: nodes in document order, and blocks as lists of (node, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.name = [-1], ["#"], [""]
        self.gone, self.main, self.article = [False], [False], [False]
        self.named = [0]
        self.hash: list[int] = [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._parts: list[list[str]] = [[]]
        self._stack, self._block = [0], []
        # depths of the open elements of each tag, of those that end no others, and of blocks
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._lines: list[int] = []
        self._parse(source)

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
            if tag in ENDS or tag not in VOID:
                self._imply(tag)
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        name = f"{found.get('class', '')} {found.get('id', '')}".lower() if found else ""
        top, node = self._stack[-1], len(self.tag)
        role = found.get("role", "").lower()
        gone = tag in DROPPED or role in DROPPED_ROLES or "hidden" in NAMES.findall(attributes) and re.search(r"(^|\s)hidden(\s|=|/|$)", attributes) is not None
        gone = gone or tag == "header" and not self.main[top]
        named = _named(name, tag, self.main[top]) if name.strip() and tag not in ("html", "body", "main") else 0
        self.parent.append(top)
        self.tag.append(tag)
        self.name.append(name)
        self.gone.append(self.gone[top] or gone)
        self.named.append(named)
        own = not self.gone[-1] and not (tag == "article" and named)
        self.main.append(self.main[top] or own and (tag in ("article", "main") or role in ("main", "article")))
        self.article.append(self.article[top] or own and (tag == "article" or role == "article"))
        self.hash.append(0)
        self._parts.append([])
        depth = len(self._stack)
        self._places.setdefault(tag, []).append(depth)
        if tag in SCOPES:
            self._scopes.append(depth)
        if tag not in INLINE:
            self._lines.append(depth)
        self._stack.append(node)
        if tag in VOID:
            if tag == "br":
                self._block.append((node, " "))
            self._close_top()

    def _imply(self, tag: str) -> None:
        """Ends what the start of a block ends without saying so: the lowest open one of those above the last scope."""
        scope = self._scopes[-1] if self._scopes else 0
        depth = len(self._stack)
        for x in ("p", *ENDS.get(tag, ())):
            if open_ones := self._places.get(x):
                at = bisect_right(open_ones, scope)
                if at < len(open_ones):
                    depth = min(depth, open_ones[at])
        while len(self._stack) > depth:
            self._close_top()

    def _close_top(self) -> None:
        node = self._stack.pop()
        tag, parts = self.tag[node], self._parts[node]
        self._places[tag].pop()
        for kind, open_ones in ((SCOPES, self._scopes), (None, self._lines)):
            if open_ones and open_ones[-1] == len(self._stack) and (tag in kind if kind else tag not in INLINE):
                open_ones.pop()
        if tag in INLINE:  # counts as text of the block around it
            own = "\0".join([tag, self.name[node], *parts])
            self._parts[self.parent[node]].append(own if len(own) < 256 else f"\1{xxhash.xxh3_64_intdigest(own)}")
        else:
            self.hash[node] = xxhash.xxh3_64_intdigest("\0".join([tag, self.name[node], *parts])) >> 1
            self._parts[self.parent[node]].append(f"\1{self.hash[node]}")
        parts.clear()

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not (open_ones := self._places.get(tag)):
            return
        depth = open_ones[-1]
        if tag in INLINE and self._lines and self._lines[-1] > depth:
            return
        while len(self._stack) > depth:
            self._close_top()

    def _text(self, text: str) -> None:
        self._block.append((self._stack[-1], text))
        if text := " ".join(text.split()):
            self._parts[self._stack[-1]].append(text)

    def _flush(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        # beyond the last ">" only an open comment can be markup
        last = max(source.rfind(">"), source.rfind("<!--"), source.rfind("<![CDATA["))
        while at < end:
            found = TOKEN.search(source, at) if at <= last else None
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            closed, tag, attributes, tag2, attributes2 = found.groups()
            if closed:
                self._close(closed.lower())
            elif tag or tag2:
                tag = (tag or tag2).lower()
                self._open(tag, attributes if tag2 is None else attributes2)
                if tag in RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    self._text(source[at : stop.start()] if stop else source[at:])
                    at = stop.end() if stop else end
                    self._close(tag)
        self._flush()
        while len(self._stack) > 1:
            self._close_top()

    def subtrees(self) -> set[int]:
        """Hashes of the block elements; void ones are none."""
        return {h for h, tag in zip(self.hash, self.tag, strict=True) if h and tag not in VOID}

    def _weights(self) -> tuple[list[int], bool]:
        """Characters below each node, of articles and main parts only if the page has any, and whether it has."""
        size = [0] * len(self.tag)
        for block in self.blocks:
            for node, text in block:
                if not self.gone[node]:
                    size[node] += len(text.strip())
        core = [x if m else 0 for x, m in zip(size, self.main, strict=True)]
        some = any(core)
        weight = core if some else size
        for node in range(len(weight) - 1, 0, -1):
            weight[self.parent[node]] += weight[node]
        return weight, some

    def text(self, templates: set[int], common: set[int] = frozenset()) -> str:
        """templates go everywhere, common ones outside articles and main parts, and inside where a name agrees.

        An element with a telling name stays if it holds most of the article, or of a page without one."""
        gone = list(self.gone)
        weight, some = self._weights()
        outer = False
        for node in range(1, len(gone)):
            if gone[node] or gone[self.parent[node]] or self.hash[node] in templates:
                gone[node] = True
                continue
            often = self.hash[node] in common
            if named := self.named[node]:
                if self.article[node]:
                    gone[node] = named == 2 or often
                else:
                    gone[node] = 2 * weight[node] <= weight[0] or named == 2 and not some
            outer = outer or often and not self.main[node]
        text = self._text_of(gone)
        if outer:
            for node in range(1, len(gone)):
                gone[node] = gone[node] or gone[self.parent[node]] or self.hash[node] in common and not self.main[node]
            rest = self._text_of(gone)
            if len(rest) > LEAST_REST * len(text):  # else the page itself recurs, not a part of it
                return rest
        return text

    def _text_of(self, gone: list[bool]) -> str:
        articles = any(self.main[i] and self.tag[i] == "article" and not gone[i] for i in range(len(gone)))
        inside = [False] * len(gone)
        for node in range(1, len(gone)):
            inside[node] = inside[self.parent[node]] or (self.tag[node] == "article" if articles else self.main[node])
        whole = not any(inside)
        kept = []
        for block in self.blocks:
            parts = [(n, t) for n, t in block if not gone[n] and (whole or inside[n])]
            text = " ".join(_decoded("".join(t for _, t in parts)).split())
            if text:
                kept.append(text)
        return "\n\n".join(kept)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, int]] = Counter()
        for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.update((host, h) for h in Page(source or "").subtrees())
        hosts, hashes = zip(*counts) if counts else ((), ())
        yield pa.record_batch({"host": pa.array(hosts, pa.string()), "subtree": pa.array(hashes, pa.int64()), "n_pages": pa.array(counts.values(), pa.int64())})


def templates(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, templates array<long>, common array<long>): subtrees that go everywhere, and those that go outside articles.

    A host has at most (mean elements of a page) / (the rule's ratio) of them."""
    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    counted = slim.mapInArrow(_subtrees, "host string, subtree long, n_pages long").groupBy("host", "subtree").agg(F.sum("n_pages").alias("n_pages"))
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    n, n_all = F.col("n_pages"), F.col("host_pages")
    often = F.when(n_all < least_pages, (n >= SMALL_LEAST) & (n > ratio * n_all)).otherwise((n >= least_pages) & (n > min(ratio, OUTER_RATIO) * n_all))
    strict = (n >= least_pages) & (n > ratio * n_all)
    frequent = counted.filter(n >= min(SMALL_LEAST, least_pages)).join(totals, "host").filter(often | strict)
    sets = [F.collect_set(F.when(rule, F.col("subtree"))).alias(name) for name, rule in (("templates", strict), ("common", often & ~strict))]
    return frequent.groupBy("host").agg(*sets)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, sources, known, common = batch.columns
        texts = [Page(x.as_py() or "").text(set(k.as_py() or ()), set(c.as_py() or ())) for x, k, c in zip(sources, known, common, strict=True)]
        yield pa.record_batch({"page_id": ids, "url": urls, "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract_text(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    The text is the article's blocks in page order, joined by an empty line, with character references decoded and
    white space inside a block turned into one space; '' if there is none. Null html counts as empty; pages whose
    url is null or has no host form one site. Repeated rows are pages of their own. An empty table gives an empty
    result; other columns are not read."""
    known = staged(templates(pages, ratio, least_pages, url_col, html_col), "templates").withColumnRenamed("host", "_host")
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("_host"))
    joined = keyed.join(known, "_host", "left").select("page_id", "url", "html", "templates", "common")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
