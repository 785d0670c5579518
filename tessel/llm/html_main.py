"""Main text of web pages by consensus host paths.

Every page scores its containers and votes for the generalised tag-class path of the best one. Spark sums the votes
per host, and each page is extracted again from the first winning path of its host that it has. Tags and roles that
never hold an article are left out at once; class and id names that hint at boilerplate only discount a container, so
that the votes decide where the article is.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import small, small_batches, staged, tidy

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title noscript iframe xmp noembed noframes".split()}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINER = frozenset("article main section div td body center".split())
_DROP = frozenset("head nav footer aside form script style textarea title noscript iframe template object svg canvas button select dialog menu search audio video map xmp noembed noframes".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that make a container suspect.
_SUSPECT = frozenset(
    "nav navbar navigation menu sidebar footer comment comments reply replies disqus ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager popup modal overlay widget toolbar masthead login discussion feedback".split()
)
_LANDMARK = frozenset("article main".split())
_GOOD = frozenset("article articlebody content post entry story maintext".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: Weight of prose in a suspect container, and how often the prose of a container named an article counts.
DISCOUNT, NAMED = 0.25, 3
#: Characters within which the closing quote of an attribute is looked for.
LONGEST_TAG = 1 << 16


def _words(value: str) -> set[str]:
    return set(_SPLIT.split(_CAMEL.sub(" ", value).lower())) - {""}


class _Open:
    __slots__ = ("tag", "node", "drop", "inside", "head")

    def __init__(self, tag: str, node: int, drop: bool, inside: bool, head: bool) -> None:
        self.tag, self.node, self.drop, self.inside, self.head = tag, node, drop, inside, head


class Page:
    """Blocks of a page outside of boilerplate markup, and the tree of generalised paths that they lie in.

    blocks: (text, characters in links, node) in page order. A node stands for all elements with the same steps from
    the body down; its number is larger than its parent's. Parsing takes time and memory in proportion to the page.
    """

    def __init__(self, html: str) -> None:
        self.parent, self.step, self.depth, self.suspect, self.good, self.container = [-1], [""], [0], [False], [False], [False]
        self.child: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int]] = []
        self._stack: list[_Open] = []
        self._at: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by tag
        self._block_at: list[int] = []  # those of block elements
        self._text: list[str] = []
        self._linked = self._headings = 0
        self._parse(html)

    def _node(self, up: int, step: str, suspect: bool, good: bool, container: bool) -> int:
        n = self.child.get((up, step))
        if n is None:
            n = self.child[up, step] = len(self.step)
            self.parent.append(up)
            self.step.append(step)
            self.depth.append(self.depth[up] + 1)
            self.suspect.append(suspect)
            self.good.append(good)
            self.container.append(container)
        self.good[n] = self.good[n] or good
        return n

    def _flush(self) -> None:
        raw, links = "".join(self._text), self._linked
        self._text.clear()
        self._linked = 0
        if raw and not raw.isspace() and (done := " ".join(entities.unescape(raw).split())):
            self.blocks.append((done, links, self._stack[-1].node if self._stack else 0))

    def _add(self, raw: str) -> None:
        top = self._stack[-1] if self._stack else None
        if not raw or (top and top.drop) or (top and top.head and not self._headings):
            return  # of a header inside an article only its headings belong to the text
        self._text.append(raw)
        if self._at["a"]:
            self._linked += len(raw)

    def _cut(self, size: int) -> None:
        """Closes all elements from place `size` of the stack on."""
        for o in self._stack[size:]:
            self._at[o.tag].pop()
            self._headings -= o.tag in _HEADINGS
        while self._block_at and self._block_at[-1] >= size:
            self._block_at.pop()
        del self._stack[size:]

    def _open(self, tag: str, raw: str) -> None:
        up = self._stack[-1] if self._stack else None
        attrs = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw else {}
        names = attrs.get("class", "")
        words = _words(f"{names} {attrs.get('id', '')}") if attrs else set()
        inside = bool(up and up.inside) or tag in _LANDMARK
        drop, suspect = bool(up and up.drop) or tag in _DROP or (tag == "header" and not inside), False
        if attrs and not drop and tag not in ("body", "html", *_LANDMARK):
            style = attrs.get("style", "").replace(" ", "").lower()
            drop = attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style
            suspect = bool(words & _SUSPECT) or ("header" in words and not inside)
        good = tag in _LANDMARK or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" or bool(words & _GOOD)
        node = up.node if up else 0
        if not drop:
            step = tag + "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c.lower()).replace("/", "_") for c in names.split()}))
            node = self._node(node if up and up.tag != "html" else 0, step + "!" * suspect, suspect, good, tag in _CONTAINER)
        if tag in _BLOCK:
            self._block_at.append(len(self._stack))
        self._at[tag].append(len(self._stack))
        self._headings += tag in _HEADINGS
        self._stack.append(_Open(tag, node, drop, inside or (good and tag != "body"), bool(up and up.head) or tag == "header"))

    def _tag(self, closing: str, tag: str, raw: str) -> None:
        if tag == "br":
            return self._add(" ")
        block = tag in _BLOCK
        if block:
            self._flush()
        if closing:
            if (at := self._at[tag]) and (block or not self._block_at or at[-1] > self._block_at[-1]):
                self._cut(at[-1])  # an inline end tag reaches no further than its block
            return None
        if block and self._block_at and self._stack[self._block_at[-1]].tag == "p":
            self._cut(self._block_at[-1])
        if tag in _CLOSES:
            closes, edges = _CLOSES[tag]
            edge = max((self._at[e][-1] for e in edges if self._at[e]), default=-1)
            found = [at[i] for c in closes if (at := self._at[c]) and (i := bisect_right(at, edge)) < len(at)]
            if found:
                self._cut(min(found))
        if tag in _VOID or (raw.endswith("/") and not block):
            return None
        if tag == "body":
            self._cut(1 if self._stack and self._stack[0].tag == "html" else 0)
        return self._open(tag, raw)

    def _parse(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while (lt := html.find("<", at)) >= 0:
            if html.startswith("<!--", lt):
                self._add(html[at:lt])
                end = html.find("-->", lt + 2)
                at = end + 3 if end >= 0 else len(html)
                continue
            m = _NAME.match(html, lt)
            if not m and html[lt + 1 : lt + 2] not in ("!", "?"):
                self._add(html[at : lt + 1])
                at = lt + 1
                continue
            if lt > last:
                break  # no tag ends any more
            self._add(html[at:lt])
            if not m:
                at = html.find(">", lt) + 1
                continue
            end = self._end(html, m.end())
            tag, at = m[2].lower(), end + 1
            if tag in _RAW and not m[1]:
                if tag in _BLOCK:
                    self._flush()
                close = _RAW[tag].search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(html)
                continue
            self._tag(m[1], tag, html[m.end() : end])
        self._add(html[at:])
        self._flush()

    @staticmethod
    def _end(html: str, at: int) -> int:
        """Place of the > that ends a tag, quoted ones left out where their quote ends."""
        stop = _STOP.search(html, at)
        while stop and stop[0] != ">" and stop.start() - at < LONGEST_TAG:
            close = html.find(stop[0], stop.end(), at + LONGEST_TAG)
            if close < 0:
                break
            stop = _STOP.search(html, close + 1)
        return stop.start() if stop and stop[0] == ">" else html.find(">", at)

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return "/".join(reversed(steps))

    def find(self, path: str) -> int | None:
        """Node of a path, if the page has it."""
        node = 0
        for step in path.split("/"):
            if (node := self.child.get((node, step))) is None:
                return None
        return node

    def best(self) -> tuple[int, int]:
        """(node of the best container, characters of its prose); (0, 0) if no block lies in a container.

        A container scores the prose that would be extracted from it, NAMED times if its markup names it the article,
        discounted if it or a container around it is suspect, and a little more the deeper it lies, so that of two with
        the same text the inner one wins. Ties go to the first on the page.
        """
        prose, some = [0] * len(self.step), [False] * len(self.step)
        for text, links, node in self.blocks:
            prose[node] += max(0, len(text) - 2 * links)
            some[node] = True
        for n in range(len(self.step) - 1, 0, -1):
            some[self.parent[n]] |= some[n]
            if not self.suspect[n]:
                prose[self.parent[n]] += prose[n]
        under, best, most = [False] * len(self.step), 0, -1.0
        for n in range(1, len(self.step)):
            under[n] = under[self.parent[n]] or self.suspect[n]
            if some[n] and self.container[n]:
                score = prose[n] * (NAMED if self.good[n] else 1) * (DISCOUNT if under[n] else 1) * 1.01 ** min(self.depth[n], 100)
                if score > most:
                    best, most = n, score
        return best, prose[best] if best else 0

    def below(self, node: int) -> str:
        """The blocks below a node, without those in suspect containers below it."""
        under = [False] * len(self.step)
        under[node] = True
        for n in range(node + 1, len(self.step)):
            under[n] = under[self.parent[n]] and not self.suspect[n]
        return "\n\n".join(t for t, _, n in self.blocks if under[n])


def extract(html: str | None, paths: list[str] | None = None) -> tuple[str, str]:
    """(main text, path used): blocks below the first of paths that the page has, else below its own best container."""
    page = Page(html or "")
    node = next((n for p in paths or [] if (n := page.find(p)) is not None), None)
    node = page.best()[0] if node is None else node
    return page.below(node), page.path(node)


def host_of(url: Column) -> Column:
    """Host of a url in lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) from rows with host and html: the paths that two pages or more vote for, most pages first, then most prose."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            votes: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                node, prose = page.best()
                if prose:
                    vote = votes.setdefault((host, page.path(node)), [0, 0])
                    vote[0] += 1
                    vote[1] += prose
            hosts, paths, n, prose = [k[0] for k in votes], [k[1] for k in votes], [v[0] for v in votes.values()], [v[1] for v in votes.values()]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(n, pa.int64()), pa.array(prose, pa.int64())], ["host", "path", "n", "prose"])

    votes = pages.filter("host is not null").select("host", "html").mapInArrow(tidy(run), "host string, path string, n long, prose long")
    votes = votes.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose")).filter("n > 1")
    ranked = votes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("prose")).alias("prose"), "path"))).alias("p"))
    return ranked.select("host", F.col("p.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every page, from its whole html.

    Blocks are joined by two line feeds, white space inside them is one space, character references are decoded.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
    tag or role, or as suspect by class or id below the path that is used. Null, empty or textless html gives an empty
    text. A page whose host is unknown, or that has none of its host's paths, uses its own best container; of two equal
    ones the first. Very long or badly nested html takes time in proportion to its length. Rows that repeat are
    extracted alike; columns besides page_id, url and html are ignored, whatever their names; an empty table gives an
    empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    paths = staged(host_paths(rows), "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(small(paths, 50_000), "host", "left").select("page_id", "url", "html", "paths")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = [t for t, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in got], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long, path string")
