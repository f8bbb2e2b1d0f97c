"""Main text of web pages, with site templates found by counting element subtrees of each host.

Each page is read into elements. Every subtree has two hashes: one of its names and texts, and one of its place and shape,
that is the names and classes down to it and the set of shapes inside, without texts and numbers of links. Spark counts on
how many different pages of a host each hash occurs. What recurs is the site's template and is deleted:

* a subtree with the same text on PAGES pages and a SHARE of the host's pages. Inside an article its surroundings must differ,
  so that copied articles stay, and for prose (headings, paragraphs and the like) the share is HALF;
* outside an article, a subtree of the same shape on so many pages that is mostly links;
* beside an article, a subtree of the same shape on HALF of the pages, whatever its text: a slot of the site.

Elements that HTML itself defines as what is not wanted (nav, footer, aside, form, header outside an article ...) go on any
page of any host, and so do those whose class, id or role names boilerplate or comments, but for headings and paragraphs
of an article. Hosts with fewer than PAGES different pages have no counts: there the article or main element decides, where
a page has one, what else is kept.

What is left is read in blocks: character references are decoded, white space in a block becomes one space, blocks are
joined by an empty line. Null and empty html gives empty text. A null url is a host of its own name ''. Broken markup is
read as far as it can be, at any depth, in a time that grows with the page. Repeated rows count as one page. Very long pages are read whole. An empty table
gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sliced

#: A subtree is template if it is on so many different pages of its host, and on such a share of them.
PAGES, SHARE, HALF = 5, 0.2, 0.5
#: Templates are broadcast up to so many (host, subtree) rows of 24 bytes or so; beyond, pages are joined by host.
BROADCAST_ROWS = 1_000_000

#: Names of HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "math", "xmp", "noframes")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead figcaption ul ol dl table figure hr".split())
_SAID = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_GONE = frozenset("nav footer aside form head select button menu dialog object audio video canvas fieldset input option datalist".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that name boilerplate anywhere, those that do so outside an article only, and comments.
_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent newsletter subscribe share sharing social comment comments commentlist disqus pagination pager toolbar login signup contentinfo".split())
_OUTSIDE = frozenset("header masthead topbar banner notice notices alert popup modal subscription related recommended reply replies respond discussion widget search complementary aside".split())
_COMMENTS = frozenset("comment comments".split())

_RAW_OPEN = re.compile("(" + "|".join(_RAW) + r")\b", re.I)
_RAW_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAME_END, _SPECIAL, _LETTER = re.compile(r"[\s/>]"), re.compile("[\"'>]"), re.compile("/?[a-zA-Z]")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NO_MARKS: frozenset[str] = frozenset()


class _Ahead:
    """Where a pattern is found next: what lies between is read once, however often it is asked for."""

    def __init__(self, pattern: re.Pattern, page: str) -> None:
        self.pattern, self.page, self.asked, self.found = pattern, page, 0, -1

    def next(self, at: int) -> int:
        """The first match from `at` on, the length of the page without one."""
        if not self.asked <= at <= self.found:
            m = self.pattern.search(self.page, at)
            self.asked, self.found = at, m.start() if m else len(self.page)
        return self.found


def tokens(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """(text, None, False), or the attributes, name and whether it is an end tag, of what a page consists of.

    Comments, declarations and elements without markup inside are left out. A tag ends at the first > outside quotes; one
    that has none is text. No part of the page is read more than a few times: what was found not to end is remembered.
    """
    n, at, last = len(page), 0, page.rfind(">")
    name_end, special = _Ahead(_NAME_END, page), _Ahead(_SPECIAL, page)
    quote = {q: page.rfind(q) for q in "\"'"}
    endless: set[int] = set()  # marks outside quotes from which no end of a tag is reached

    def end_of_tag(p: int) -> int:
        passed = []
        while True:
            p = special.next(p)
            if p >= n or p in endless:
                break
            if page[p] == ">":
                return p
            passed.append(p)
            if quote[page[p]] == p:
                break
            p = page.find(page[p], p + 1) + 1
        endless.update(passed)
        return -1

    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], None, False
            return
        if start > at:
            yield page[at:start], None, False
        at = start + 1
        if page.startswith("!--", at):
            found = page.find("-->", at + 3)
            at = found + 3 if found >= 0 else n
            continue
        if start < last:
            if m := _LETTER.match(page, at):
                close = m.group()[0] == "/"
                raw = None if close else _RAW_OPEN.match(page, at)
                word = raw.end() if raw else name_end.next(m.end())
                stop = end_of_tag(word)
                if stop >= 0:
                    if raw:
                        closed = _RAW_CLOSE[raw[1].lower()].search(page, stop)
                        at = closed.end() if closed else n
                    else:
                        yield page[word:stop], page[m.end() - 1 : word].lower(), close
                        at = stop + 1
                    continue
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.find(">", at) + 1
                continue
        yield "<", None, False


class Page:
    """The elements of a page in document order: names, class words (marks), parents, and children (numbers of elements, or texts).

    Element 0 is the root. Missing end tags are supplied where a start tag implies them. A child has a higher number than
    its parent, so that a pass over the numbers needs no recursion at any depth.
    """

    def __init__(self, page: str) -> None:
        self.names, self.marks, self.parents, self.children = ["#root"], [_NO_MARKS], [-1], [[]]
        names, stack = self.names, [0]
        places: dict[str, list[int]] = {}  # where in the stack elements of a name are
        blocks = [0]  # and where those that are not inline

        def pop(k: int) -> None:
            for e in reversed(stack[k:]):
                places[names[e]].pop()
                if names[e] not in _INLINE:
                    blocks.pop()
            del stack[k:]

        def last(some: tuple) -> int:
            return max((places[n][-1] for n in some if places.get(n)), default=0)

        def end(ends: tuple, until: tuple) -> None:
            k = last(ends)
            if k > last(until):
                pop(k)

        for said, name, close in tokens(page):
            if name is None:
                self.children[stack[-1]].append(said)
                continue
            if close:
                k = last((name,))
                if k and (name not in _INLINE or blocks[-1] < k):  # an inline end tag does not end blocks
                    pop(k)
                continue
            if name in _CLOSES_P:
                end(("p",), ("td", "th", "li", "button", "table"))
            if name == "li":
                end(("li",), ("ul", "ol", "menu"))
            elif name in ("dt", "dd"):
                end(("dt", "dd"), ("dl",))
            elif name in ("td", "th"):
                end(("td", "th"), ("tr", "table"))
            elif name == "tr":
                end(("tr",), ("table",))
            elif name == "body":
                end(("head",), ())
            marks = frozenset(w for g in _NAMED.findall(said) for w in re.findall(r"[a-z]+", "".join(g).lower())) if "=" in said else _NO_MARKS
            self.children[stack[-1]].append(len(names))
            names.append(name), self.marks.append(marks), self.parents.append(stack[-1]), self.children.append([])
            if name not in _VOID:
                places.setdefault(name, []).append(len(stack))
                if name not in _INLINE:
                    blocks.append(len(stack))
                stack.append(len(names) - 1)
        n = len(names)
        self.inside = [False] * n  # whether an article, or main, is around the element
        self.holds = [False] * n  # whether one is within it
        holder = lambda e: names[e] in ("article", "main") and not (names[e] == "article" and self.marks[e] & _COMMENTS)
        for e in range(1, n):
            self.inside[e] = self.inside[self.parents[e]] or holder(self.parents[e])
        for e in range(n - 1, 0, -1):
            self.holds[self.parents[e]] |= self.holds[e] or holder(e)

    def measure(self) -> None:
        """whole: the hash of each subtree's names and texts ('' without text). shape: that of its place and structure.
        linked: whether most of its text is in links."""
        n = len(self.names)
        digest = xxhash.xxh3_64_hexdigest
        self.whole, shapes = [""] * n, [""] * n
        chars, in_links = [0] * n, [0] * n
        for e in range(n - 1, -1, -1):
            parts, below = [], set()
            for c in self.children[e]:
                if isinstance(c, int):
                    if self.whole[c]:
                        parts.append(self.whole[c])
                        below.add(shapes[c])
                        chars[e] += chars[c]
                        in_links[e] += in_links[c]
                elif said := " ".join(c.split()):
                    parts.append(said)
                    below.add("#text")
                    chars[e] += len(said)
            if parts:
                if self.names[e] == "a":
                    in_links[e] = chars[e]
                own = f"{self.names[e]}.{' '.join(sorted(self.marks[e]))}"
                self.whole[e] = digest("\x1f".join((own, *parts)).encode("utf-8", "replace"))
                shapes[e] = own if self.names[e] in _INLINE else digest("\x1f".join((own, *sorted(below))).encode("utf-8", "replace"))
        places = [""] * n
        self.shape = [""] * n
        for e in range(1, n):
            if self.whole[e] and self.names[e] not in _INLINE:
                places[e] = digest(f"{places[self.parents[e]]}/{self.names[e]}.{' '.join(sorted(self.marks[e]))}".encode("utf-8", "replace"))
                self.shape[e] = digest(f"{places[e]}\x1e{shapes[e]}".encode())
        self.linked = [x * 2 > y for x, y in zip(in_links, chars)]

    def may_go(self, e: int) -> bool:
        """Whether an element can be template: a block with text that neither is nor holds an article."""
        return bool(self.whole[e]) and self.names[e] not in _INLINE and not self.holds[e] and self.names[e] not in ("#root", "html", "body", "article", "main")


def _number(digest: str) -> int:
    h = int(digest, 16)
    return h - (1 << 64) if h >= 1 << 63 else h


def subtrees(page: Page) -> set[tuple[int, int]]:
    """(hash, surroundings) of all that may be template: pages that agree in both count once."""
    page.measure()
    whole = _number(page.whole[0] or "0")
    out = set()
    for e in range(1, len(page.names)):
        if page.may_go(e):
            out.add((_number(page.whole[e]), _number(page.whole[page.parents[e]]) if page.inside[e] else whole))
            out.add((_number(page.shape[e]), whole))
    return out


def main_text(source: str, template: dict[int, float] | None = None) -> str:
    """The blocks of a page's main text, joined by an empty line. template: the share of the host's pages for what recurs
    there; None where the host's pages were not counted."""
    page = Page(source)
    counted = template is not None
    if template:
        page.measure()
    held = page.holds[0]

    def gone(e: int) -> bool:
        name, marks, inside = page.names[e], page.marks[e], page.inside[e]
        if page.holds[e] or name in ("html", "body", "article", "main"):
            return name == "article" and bool(marks & _COMMENTS)
        if name in _GONE or (name == "header" and not inside):
            return True
        if (marks & _BOILERPLATE or (not inside and marks & _OUTSIDE)) and not (inside and name in _SAID and not marks & _COMMENTS):
            return True
        if not template or not page.may_go(e):
            return False
        if template.get(_number(page.whole[e]), 0) >= (HALF if inside and name in _PROSE else SHARE):
            return True
        share = template.get(_number(page.shape[e]), 0)
        return share >= SHARE and not inside and page.linked[e] or share >= HALF and held and not inside

    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    todo: list = [0]  # elements to enter, texts, and None where a block ends
    taken = [counted or not held] * len(page.names)
    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            line.append(e)
        elif not (e and gone(e)):
            name = page.names[e]
            if name in ("br", "hr"):
                line.append(" ")
            if name not in _INLINE:
                flush()
                todo.append(None)
            mine = taken[e] or page.inside[e] or name in ("article", "main")
            todo.extend(c for c in reversed(page.children[e]) if isinstance(c, int) or mine)
    flush()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """The host of a url in lower case, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """host, subtree, share for every subtree that recurs on the pages(host, html) of a host, and a row with a null subtree
    for each host that has enough pages to tell; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "html"):
                seen: set[tuple] = set()
                for name, source in zip(batch.column("host").to_pylist(), batch.column("html")):
                    page = Page(source.as_py() or "")
                    seen.update((name, *x) for x in subtrees(page))
                    seen.add((name, None, _number(page.whole[0] or "0")))  # counts the page
                hosts, hashes, around = zip(*seen) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(around, pa.int64())], ["host", "subtree", "around"])

    found = pages.mapInArrow(run, "host string, subtree bigint, around bigint").distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages"))
    counted = materialize(found.where(F.col("pages") >= least_pages))
    of_host = counted.where("subtree IS NULL").select("host", F.col("pages").alias("all"))
    recurs = counted.join(of_host, "host").select("host", "subtree", (F.col("pages") / F.col("all")).alias("share")).where((F.col("share") >= share) | F.col("subtree").isNull())
    out = materialize(recurs)
    discard(counted)
    return out


def extract(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = templates(pages.select("host", "html"), least_pages, share)
    # At most 1 / share times the subtrees of a page for each host.
    by_host = found.groupBy("host").agg(F.collect_list(F.when(F.col("subtree").isNotNull(), F.struct("subtree", "share"))).alias("template"))
    if found.count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known: dict[str, dict | None] = {}  # templates of the hosts of a batch
            for batch in sliced(whole, "html"):
                texts = []
                for name, source, found in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("template")):
                    if name not in known:
                        rows = found.as_py()
                        known[name] = None if rows is None else {r["subtree"]: r["share"] for r in rows}
                    texts.append(main_text(source.as_py() or "", known[name]))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(by_host, "host", "left").select("page_id", "url", "html", "host", "template")
    return joined.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages)
