"""Main text of web pages: site templates are found by counting element subtrees per host, and deleted.

Every element's subtree is hashed in three ways: its text as it is; its text with all numbers alike, as a menu's counters
change from page to page (for containers without prose, outside of articles); and its shape, which is its tags and class words without text. What says how a page stands
(``active``), and not what an element is, counts in none. Spark counts, for each host, the pages on which a hash occurs,
copies of a page as one; subtrees that recur across many of the host's pages are its template. What is left of the
article after these are deleted, and after elements that are no article by their tag, role or an unmistakable class, is
the text. A class that may as well be said of the subject (``share``, ``discussion``) deletes only what recurs in shape.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, bounded_batches

#: a subtree is a host's template from so many of its pages, and this share of them.
MIN_PAGES, SHARE = 4, 0.25
#: template hashes that may be broadcast (8 bytes each); beyond it, the pages are joined by host.
BROADCAST = 200_000
#: (host, hash, main content) counts that a task holds before it passes them on.
HELD = 100_000

# Fixed values of HTML: elements without content, with raw text, and those that end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
#: what a start tag closes, if open, and where the search for it ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

NO_ARTICLE = frozenset(
    "head script style noscript template iframe object embed svg canvas nav footer aside form button select textarea menu dialog audio video map".split()
)
#: class words that are said of no article, and those that might be: the latter need a shape that recurs.
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead comments disqus respond recommendations adsbygoogle adsense newsletter signup popup modal pager pagination toolbar hidden".split()
)
DOUBTFUL_NAMES = frozenset(
    "promotion banner notice notices header comment reply replies discussion share sharing social related recommended subscribe subscription login overlay"
    " widget copyright skip".split()
)
#: words of an element's state on this page.
STATES = frozenset("active current selected open closed first last odd even here visited".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: words that turn the others round: ``no-sidebar`` and ``has-menu`` are said of a page's content.
ABOUT_LAYOUT = frozenset("no non none without has with is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: in an article, recurring subtrees of these only are template; a recurring paragraph is part of the text.
#: these are text, whatever words their id has: they go by a class that is but one unmistakable word.
TEXT = HEADINGS | frozenset("p pre blockquote td th dd dt tr tbody table figcaption article main body html".split())
PROSE = HEADINGS | frozenset("p pre blockquote td th dd".split())
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center header address".split())

# a value is quoted, or runs up to a space or >; a quote that is never closed, or stands elsewhere, is a character
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|{_VALUE})*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@lru_cache(1 << 14)
def described(attributes: str) -> tuple[frozenset[str], frozenset[str], str]:
    """Of an element's attributes: its class words, but for states; what of it is said of no article (a class of one such
    word also as ``.word``), with ``hidden`` if the element is; and its role."""
    words, found, role = set(), set(), ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, raw = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            for name in raw.split():
                parts = {x.lower() for x in _NAMES.findall(name)}
                words |= parts - STATES
                if not parts & ABOUT_LAYOUT:
                    found |= (parts | {name.lower()}) & (NO_ARTICLE_NAMES | DOUBTFUL_NAMES)
                    if key == "class" and name.lower() in NO_ARTICLE_NAMES:
                        found.add("." + name.lower())
        elif key == "role":
            role = raw.lower().strip()
        elif key == "hidden" or key == "aria-hidden" and raw.lower() == "true" or key == "style" and _UNSEEN.search(raw.lower()):
            found |= {"hidden", ".hidden"}
    return frozenset(words), frozenset(found), role


@lru_cache(1 << 14)
def named(tag: str, attributes: str) -> bytes:
    """An element's tag and class words."""
    label = " ".join(sorted(described(attributes)[0])) if attributes else ""
    return b"\0".join([tag.encode("utf-8", "surrogatepass"), label.encode("utf-8", "surrogatepass")])


@lru_cache(1 << 14)
def shaped(name: bytes, has_text: bool, shapes: tuple[bytes, ...]) -> bytes:
    return b"s" + blake2b(b"\1".join([name, b"t" if has_text else b"", *shapes]), digest_size=8).digest()


class Page:
    """A page as a flat list of events (texts, openings, closings), with parents and hashes of its elements."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes, self.digest, self.loose, self.shape = ["#"], [-1], [""], [b""], [b""], [b""]
        self.begin, self.end, self.size, self.prose = [0], [0], [0], [False]
        self.events: list[int | str] = [0]
        self.holds_article = {0}
        self._parts: list[list[bytes]] = [[]]
        self._children: list[list[int]] = [[]]
        stack, at = [0], 0
        depth: Counter[str] = Counter()
        self._depth = depth
        for m in iter(lambda: _TOKEN.search(html, at), None):
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if depth[name]:
                    while self.tag[stack[-1]] != name:
                        self._close(stack)
                    self._close(stack)
                continue
            self._implied(stack, name)
            self._open(stack, name, m[3])
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(html, at)
                inner, at = html[at : stop.start() if stop else len(html)], stop.start() if stop else len(html)
                if name in ("title", "textarea"):
                    self._text(stack[-1], inner)
                if not stop:
                    self._close(stack)
            elif name in VOID or m[3].endswith("/") and name not in BLOCK:
                self._close(stack)
        if at < len(html):
            self._text(stack[-1], html[at:])
        while stack:
            self._close(stack)

    def _text(self, into: int, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.events.append(text)
        self._parts[into].append(" ".join(text.split()).encode("utf-8", "surrogatepass"))

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        i = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.attributes.append(attributes)
        self.digest.append(b"")
        self.loose.append(b"")
        self.shape.append(b"")
        self.size.append(0)
        self.prose.append(False)
        self.begin.append(len(self.events))
        self.end.append(0)
        self.events.append(i)
        self._parts.append([])
        self._children.append([])
        self._depth[name] += 1
        stack.append(i)
        if name in ("article", "main") or "main" in attributes and described(attributes)[2] == "main":
            self.holds_article.update(stack)

    def _close(self, stack: list[int]) -> None:
        i = stack.pop()
        parts, self._parts[i] = self._parts[i], []
        inner, self._children[i] = self._children[i], []
        self._depth[self.tag[i]] -= 1
        text = sum(len(p) for p in parts)
        self.size[i] += text
        self.prose[i] = self.tag[i] in PROSE or any(self.prose[c] for c in inner)
        name = named(self.tag[i], self.attributes[i] if self.attributes[i].strip() else "")
        own = b"\0".join([name, b" ".join(parts)])
        # runs of children that look alike are one: a list has the shape of a longer list
        shapes = tuple([self.shape[c] for k, c in enumerate(inner) if not k or self.shape[c] != self.shape[inner[k - 1]]])
        self.shape[i] = shaped(name, text > 0, shapes)
        self.digest[i] = digest = blake2b(b"\1".join([own, *[self.digest[c] for c in inner]]), digest_size=8).digest()
        if all(self.loose[c] is self.digest[c] for c in inner) and not _DIGITS.search(own):
            self.loose[i] = digest
        else:
            self.loose[i] = blake2b(b"\1".join([_DIGITS.sub(b"0", own), *[self.loose[c] for c in inner]]), digest_size=8).digest()
        self.events.append(-i - 1)
        self.end[i] = len(self.events)
        if stack:
            self._children[stack[-1]].append(i)
            self.size[stack[-1]] += self.size[i]

    def _implied(self, stack: list[int], name: str) -> None:
        """Close what the start tag ends: an open paragraph before a block, a list item before the next."""
        closes, holds = CLOSES.get(name), HOLDS.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in holds:
                    break
                if self.tag[stack[k]] in closes:
                    while len(stack) > k:
                        self._close(stack)
                    if name != "tr":
                        break
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    while len(stack) > k:
                        self._close(stack)
                    break
                if self.tag[stack[k]] in BLOCK:
                    break

    def articles(self) -> list[int]:
        """The outermost articles; else the main element; else the page."""
        for wanted in (lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main" or described(self.attributes[i])[2] == "main"):
            found, until = [], 0
            for i in sorted(self.holds_article):
                if self.begin[i] >= until and i and wanted(i) and not self._foreign(i):
                    found.append(i)
                    until = self.end[i]
            if found:
                return found
        return [0]

    def _foreign(self, i: int) -> bool:
        """An article that is none of the page's own: a reader's comment, a teaser, or part of one."""
        while i > 0:
            if self.tag[i] in NO_ARTICLE or described(self.attributes[i])[1] and self.tag[i] not in ("body", "article", "main"):
                return True
            i = self.parent[i]
        return False

    def _outside(self, i: int) -> bytes:
        """By what an element outside articles is counted: a container without prose by its text but for numbers, others
        by all of it."""
        return self.loose[i] if self.tag[i] in CONTAINERS and not self.prose[i] else self.digest[i]

    def subtrees(self) -> set[bytes]:
        """Hashes of the elements that may be template: any with text outside articles, containers inside; and shapes of
        those whose class leaves it in doubt."""
        inside, out, until = set(self.articles()) - {0}, set(), 0
        for i in range(1, len(self.tag)):
            if i in inside:
                until = self.end[i]
            if i in self.holds_article or not self.size[i] or self.tag[i] in ("html", "body"):
                continue
            if self.begin[i] >= until:
                out.add(self._outside(i))
            elif self.tag[i] in CONTAINERS:
                out.add(self.digest[i])
            if self.attributes[i] and self.tag[i] not in TEXT and described(self.attributes[i])[1] & DOUBTFUL_NAMES:
                out.add(self.shape[i])
        return out

    def main(self) -> bytes:
        """What copies of a page have in common: the hashes of its articles; of the page, if there are none with text."""
        roots = self.articles()
        return b"".join(self.digest[i] for i in roots) if any(self.size[i] for i in roots) else self.digest[0]

    def text(self, template: frozenset[bytes] = frozenset()) -> str:
        blocks: list[str] = []
        for root in self.articles():
            line: list[str] = []

            def end_block(line: list[str] = line) -> None:
                block = " ".join("".join(line).split())
                if block:
                    blocks.append(block)
                line.clear()

            scope_is_article, at, titles, title_of = root > 0, self.begin[root], 0, -1
            while at < self.end[root]:
                event = self.events[at]
                at += 1
                if isinstance(event, str):
                    if titles <= 0 or titles > 1:
                        line.append(event)
                    continue
                i = event if event >= 0 else -event - 1
                if event < 0:
                    if titles and (self.tag[i] in HEADINGS or i == title_of):
                        titles -= 1
                    if self.tag[i] in BLOCK:
                        end_block()
                    continue
                if i != root and self._dropped(i, root, template, scope_is_article):
                    if not titles and scope_is_article and self._titled(i):
                        titles, title_of = 1, i  # of an article's own header, the headings stay
                        end_block()
                        continue
                    at = self.end[i]
                    if self.tag[i] in BLOCK:
                        end_block()
                    continue
                if titles and self.tag[i] in HEADINGS:
                    titles += 1
                if self.tag[i] in BLOCK:
                    end_block()
                elif self.tag[i] == "br":
                    line.append(" ")
            end_block()
        return "\n\n".join(blocks)

    def _titled(self, i: int) -> bool:
        return (self.tag[i] == "header" or described(self.attributes[i])[1] == {"header"}) and any(
            isinstance(e, int) and e > 0 and self.tag[e] in HEADINGS for e in self.events[self.begin[i] : self.end[i]]
        )

    def _dropped(self, i: int, root: int, template: frozenset[bytes], in_article: bool) -> bool:
        if i in self.holds_article and self.tag[i] not in NO_ARTICLE and not in_article:
            return False
        tag = self.tag[i]
        if tag in NO_ARTICLE or tag == "header":
            return True
        # a subtree that holds most of the text is the article, however many copies of it there are
        part = 2 * self.size[i] <= self.size[root]
        if tag not in ("html", "body") and self.attributes[i].strip():
            _, found, role = described(self.attributes[i])
            if role in NO_ARTICLE_ROLES or "hidden" in found:
                return True
            if any(x[0] == "." for x in found) if tag in TEXT else found & NO_ARTICLE_NAMES:
                return True
            if part and tag not in TEXT and found & DOUBTFUL_NAMES and self.shape[i] in template:
                return True
        may = tag in CONTAINERS if in_article else tag not in ("html", "body")
        return may and part and (self.digest[i] if in_article else self._outside(i)) in template


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\\s]*)", url or "")
    return m[1].lower() if m else ""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, bytes, bytes]] = Counter()

    def passed() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))), pa.array([held[k] for k in keys], pa.int64())],
            ["host", "subtree", "main", "copies"],
        )
        held.clear()
        return out

    for batch in batches:
        for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            host = host_of(url)
            if host and html:
                page = Page(html)
                main = blake2b(page.main(), digest_size=8).digest()
                held[host, b"", main] += 1  # the host's pages
                held.update((host, d, main) for d in page.subtrees())
        if len(held) > HELD:
            yield passed()
    yield passed()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [
            Page(html).text(frozenset(template or ())) if html else ""
            for html, template in zip(batch["html"].to_pylist(), batch["template"].to_pylist(), strict=True)
        ]
        text = [t.encode("utf-8", "replace").decode() for t in text]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, *, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """The main text of each page (page_id, url, html).

    Returns page_id, url, text (blocks joined by an empty line; empty if there is none), n_chars (code points). Null
    or empty html gives an empty text. Pages without a host in their url have no template; neither has a host of
    fewer than ``min_pages`` pages. Repeated rows are each extracted; pages of equal main content count once, but on a
    host that has only copies of one page, where each row counts. Other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark, records=500)
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    counts = pages.select("url", "html").mapInArrow(_counted, "host string, subtree binary, main binary, copies long")
    counts = counts.groupBy("host", "subtree", "main").agg(F.sum("copies").alias("copies"))
    counts = counts.groupBy("host", "subtree").agg(F.count("*").alias("pages"), F.sum("copies").alias("rows"))
    counts = scratch.write(counts, "counts")
    hosts = counts.where("length(subtree) = 0").select("host", (F.col("pages") == 1).alias("single"), F.when(F.col("pages") == 1, F.col("rows")).otherwise(F.col("pages")).alias("all"))
    hosts = hosts.where(F.col("all") >= min_pages).withColumn("least", F.greatest(F.lit(min_pages), F.ceil(F.col("all") * share)))
    recurring = counts.where("length(subtree) > 0").where(F.col("rows") >= min_pages).join(hosts, "host")
    recurring = recurring.where(F.when(F.col("single"), F.col("rows")).otherwise(F.col("pages")) >= F.col("least"))
    # at most (subtrees of a page) / share of them for a host
    template = scratch.write(recurring.groupBy("host").agg(F.collect_list("subtree").alias("template")), "template")
    total = template.agg(F.sum(F.size("template")).alias("n")).first()["n"] or 0
    host = F.lower(F.regexp_extract(F.col("url"), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\\s]*)", 1))
    rows = pages.withColumn("host", host).join(F.broadcast(template) if total <= BROADCAST else template, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
