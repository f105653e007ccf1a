"""Main text of web pages: site style trees over the pages of each host.

Each page is parsed into a tree; text is gathered in blocks (block elements and <br> end a block). A block's
style is the chain of its block elements with their classes. Merging the pages of a host by style gives the
site style tree, menus and footers included: for each style node, on how many pages it occurs and how its texts are distributed. The
content importance of a node is the entropy of that distribution, over its greatest possible value, times the share of its text
outside links: text that comes back on page after page has little, and so have lists of links. The presentation importance is the
entropy of the number of its blocks a page, in the same way; a node's importance is the larger of both. Branches of low
importance on enough pages are removed from every page.

Tags and names are priors. Elements that can't be article text (menus, headers, footers, asides, forms, scripts, styles) go, and so do
those of which a whole class, id or role says so (``ad``, ``notice``, ``sidebar``), and comments of readers. A name that only has such a
word as a part (``side-story``) counts nothing inside an <article> or <main>; elsewhere it removes a branch unless the tree finds
much importance there. If what stays has an <article> or <main>, the text is taken from there; where low nodes are
all that an article has besides headings, they are its body (pages that are copies of each other), and it stays whole.

The tree is aggregated from (host, style, text hash) counts, so a host with a third of all pages is
summed up before it meets; pages join the few low nodes of their host, never each other.

Defined cases: null or empty html gives an empty text; a null or odd url is the host ''; markup that
is cut off ends where the page ends; rows stay, repeated or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

#: A style node must be on so many pages of a host before its importance counts, and is removed below the other.
MIN_PAGES = 10
MIN_IMPORTANCE = 0.25
#: From here on a node overrules a name that only has a word of NAMED as a part.
SURE_IMPORTANCE = 0.5

# Fixed values of HTML: elements by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements without text of the page, and block elements that aren't part of an article.
SILENT = {
    "head", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "audio", "video", "title", "math", "noembed", "noframes", "xmp",
}
APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words of classes, ids and roles of what isn't the article.
NAMED = {
    "nav", "navbar", "navigation", "menu", "menubar", "header", "masthead", "topbar", "footer", "contentinfo", "sidebar", "side", "aside", "complementary", "ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "search", "form", "comment", "comments", "reply", "replies", "respond", "disqus", "widget", "copyright", "legal", "disclaimer", "skip",
}
#: Words of names that say so wherever they stand.
OF_READERS = {"comment", "comments", "disqus", "respond", "replies"}
#: Opening one of these ends a paragraph; list items, cells and the like end their own kind.
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "blockquote", "form", "menu", "dir"}

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=\"'/>]+)")
#: Styles of headings.
HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?[!?]?$")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(text: str) -> dict[str, str]:
    if not text or text == "/":
        return {}
    return {(a or c).lower(): html.unescape(b.strip("\"'")) if b else "" for a, b, c in ATTRIBUTE.findall(text)}


def prior(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """What an element's own name, class, id or role says: 2: it isn't part of the article, 1: perhaps, 0: nothing."""
    if tag in APART:
        return 0 if tag == "header" and inside else 2
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.get("class", "").lower():
        return 0
    if "hidden" in attrs or "none" in re.findall(r"display\s*:\s*(\w+)", attrs.get("style", "")):
        return 2
    found = 0
    for key in ("class", "id", "role", "aria-label"):
        for name in attrs.get(key, "").split():
            if name.lower() in NAMED:
                return 2
            words = {w.lower() for w in NAME.findall(name)}
            if words & OF_READERS:
                return 2
            found |= not inside and not words.isdisjoint(NAMED)
    return int(found)


class _Page:
    """Blocks of a page: (style, text, whether it lies in an article, prior, code points in links)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, str, bool, int, bool]] = []  # tag, silent, style, in an article, prior, in a link
        self.blocks: list[tuple[str, str, bool, int, int]] = []
        self.buffer: list[str] = []
        self.linked = 0

    def top(self) -> tuple[str, bool, str, bool, int, bool]:
        return self.stack[-1] if self.stack else ("", False, "", False, 0, False)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                _, _, style, inside, known, _ = self.top()
                self.blocks.append((style, text, inside, known, min(self.linked, len(text))))
            self.linked = 0

    def close(self, tags: set[str], scope: frozenset | set = frozenset()) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self.flush()
                del self.stack[k:]
                return
            if self.stack[k][0] in scope:
                return

    def open(self, tag: str, raw: str) -> None:
        attrs = attributes(raw)
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
        if tag in ENDS_OWN:
            self.close(ENDS_OWN[tag], SCOPE)
        if tag in ("article", "main"):  # it begins even where a menu or header before it was left open
            removed = [k for k, x in enumerate(self.stack) if x[0] in ("nav", "header", "form", "menu", "head") and (x[1] or x[4] == 2)]
            if removed:
                self.flush()
                del self.stack[removed[0] :]
        if tag in BLOCK or tag == "br":
            self.flush()
        if tag in VOID:
            return
        _, silent, style, inside, known, link = self.top()
        own = prior(tag, attrs, inside)
        if tag in BLOCK:
            names = ".".join(sorted(attrs.get("class", "").split()))
            style = f"{style}/{tag}.{names}" if names else f"{style}/{tag}"
            style += ("", "?", "!")[own] if own > known else ""
            known = max(known, own)
        silent = silent or tag in SILENT or tag not in BLOCK and own == 2
        self.stack.append((tag, silent, style, inside or tag in ("article", "main"), known, link or tag == "a"))

    def text(self, raw: str) -> None:
        _, silent, *_, link = self.top()
        if raw and not silent:
            plain = html.unescape(raw) if "&" in raw else raw
            self.buffer.append(plain)
            self.linked += link * len(plain.strip())


def blocks(source: str | None) -> list[tuple[str, str, bool, int, int]]:
    """The blocks of a page, in page order."""
    page, at, source = _Page(), 0, source or ""
    while True:
        m = MARK.search(source, at)
        page.text(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            page.close({tag})
            if tag in BLOCK:
                page.flush()
            continue
        page.open(tag, raw)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            page.text(source[at : end.start() if end else len(source)])
            at = end.start() if end else len(source)
    page.flush()
    return page.blocks


def main_text(source: str | None, low: set[str] = frozenset(), sure: set[str] = frozenset()) -> str:
    """A page's article; ``low`` has the styles of its host that are removed, ``sure`` those that overrule a weak prior."""
    found = [b for b in blocks(source) if b[3] == 0 or b[3] == 1 and (b[2] or b[0] in sure)]
    kept = [b for b in found if b[0] not in low]
    inside = [b for b in kept if b[2]]
    if not any(HEADING.search(b[0]) is None for b in inside):
        inside = [b for b in found if b[2]]
    return " ".join(b[1] for b in inside or kept)


ROWS = "host string, style string, digest long, blocks int, prior int, chars long, linked long"


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        rows = []
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own: dict[str, list] = {}
            for style, text, _, known, linked in blocks(page):
                own.setdefault(style, []).append((text, known, linked))
            for style, parts in own.items():
                texts = [t for t, _, _ in parts]
                digest = xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63)
                rows.append((h, style, digest, len(texts), parts[0][1], sum(map(len, texts)), sum(x for _, _, x in parts)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, style, prior, pages, content, presentation): the site style trees' nodes with their importances, 0 to 1."""
    rows = materialize(pages.select(host().alias("host"), "html").mapInArrow(_styles, ROWS), "style-counts")

    def entropy(key: str) -> DataFrame:
        counts = rows.groupBy("host", "style", key).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"), F.sum("linked").alias("l"), F.max("prior").alias("prior"))
        sums = [F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.max("prior").alias("prior")]
        own = counts.groupBy("host", "style").agg(*sums)
        share = (F.ln("pages") - F.col("s") / F.col("pages")) / F.ln("pages")
        return own.select("host", "style", "prior", "pages", F.when(F.col("pages") > 1, share).otherwise(1.0).alias(key), (1 - F.col("l") / F.col("c")).alias("prose"))

    content = entropy("digest").withColumn("content", F.col("digest") * F.col("prose")).drop("digest", "prose")
    return content.join(entropy("blocks").select("host", "style", F.col("blocks").alias("presentation")), ["host", "style"])


def judged(tree: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, low, sure): of each host the styles that go, and those that overrule a weak prior; hosts that have neither have no row."""
    known = tree.where(F.col("pages") >= min_pages).withColumn("importance", F.greatest("content", "presentation"))
    low, sure = F.col("importance") < min_importance, (F.col("prior") == 1) & (F.col("importance") >= SURE_IMPORTANCE)
    lists = [F.sort_array(F.collect_set(F.when(x, F.col("style")))).alias(name) for name, x in (("low", low), ("sure", sure))]
    return known.where(low | sure).groupBy("host").agg(*lists)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """``pages`` with ``text``, the article of each page without the nodes that its host's tree finds low."""
    lists = materialize(judged(style_tree(pages), min_pages, min_importance), "low-styles").toDF("_host", "_low", "_sure")
    columns = [c for c in pages.columns if c not in ("text", "_host", "_low", "_sure")]
    joined = pages.select(*columns).withColumn("_host", host()).join(lists, "_host", "left").select(*columns, "_low", "_sure")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(c).to_pylist() for c in ("html", "_low", "_sure"))
            texts = [main_text(page, set(low or ()), set(sure or ())) for page, low, sure in zip(*lists)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    return joined.mapInArrow(clean, T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType())]))
