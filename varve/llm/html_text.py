"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element styles (the tags and classes on the way from the root). A node is
as important as its content and presentation are various: text that returns on every page of the host, in the same
layout, has none. Branches of low importance are cut from each page. Markup that names its role (nav, footer, class="ad", an
article) decides first: on a host with few pages, or with adverts that rotate, entropy alone cannot tell. A class or id
does so only by a whole name or its last part, never for headings, for inline elements only as a whole name of an advert, and, as
forms, not for what holds the article or most of the page's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.llm.words import slices
from varve.session import stage

# Roles of elements in HTML, and names sites give to parts that are not the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg object canvas".split())
_NOISE_TAGS = frozenset("head nav footer aside menu button select dialog".split()) | _RAW
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NOISE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu sidebar
    footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share
    sharing social related recommended recommendations comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager
    widget widgets toolbar login search copyright skip""".split()
)
_ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted".split())
_HEADER_NAMES = frozenset("header masthead".split())
_STATES = frozenset("has with without no".split())  # "has-sidebar" tells of a part elsewhere
_KEEP_TAGS = frozenset("html body main article".split())
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: A form of at least so many characters that holds most of the page's text is the page's frame.
FRAME_CHARS = 200
#: The text outside of article and main elements goes, unless it is more than so many times as long as theirs: then they are teasers.
OUTSIDE = 3

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_NAME = re.compile(r"[a-z]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Node:
    __slots__ = ("tag", "style", "parent", "noise", "main", "styled", "children", "named", "holds_main", "chars")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        names, role, noise, main = "", "", False, tag in ("article", "main")
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                role = value.strip()
            elif key == "itemprop":
                main |= value.strip() == "articlebody"
            else:
                noise |= value != "false" if key == "aria-hidden" else True
        words = set(_NAME.findall(names))
        inside = parent is not None and parent.main
        noise |= tag in _NOISE_TAGS or role in _NOISE_ROLES or (tag == "header" and not inside)
        self.tag, self.parent = tag, parent
        self.noise = noise or (parent is not None and parent.noise)
        self.main = inside or main or role == "main"
        self.styled = bool(words)
        self.style = (parent.style if parent else "") + ">" + tag + "".join("." + w for w in sorted(words))
        self.children: list[str] = []
        self.holds_main, self.chars = False, 0
        named = tag == "form" or (tag not in _KEEP_TAGS | _INLINE | _HEADINGS and _names_noise(names, inside))
        named = named or (tag in _INLINE and not _ADVERT_NAMES.isdisjoint(names.lower().split()))
        self.named: Node | None = self if named else parent.named if parent is not None else None  # the innermost element about it that is noise by its name
        if main or role == "main":
            for n in self.naming():
                n.holds_main |= not self.noise
        if parent is not None:
            parent.children.append(self.style.rpartition(">")[2])


    def naming(self) -> Iterator[Node]:
        n = self.named
        while n is not None:
            yield n
            n = n.parent.named if n.parent is not None else None


def _names_noise(names: str, inside: bool) -> bool:
    """Whether a class or id is, or ends in, the name of a part that is not the article. An article's header has its title."""
    for name in names.split():
        parts = _NAME.findall(name)
        if parts and parts[-1] in _NOISE_NAMES and not (inside and parts[-1] in _HEADER_NAMES) and not _STATES & set(parts[:-1]):
            return True
    return False


def _settle_names(opened: list[Node], blocks: list[tuple[Node, list[tuple[Node, str]]]]) -> None:
    """Makes noise of what is noise by its name, except what holds most of the page's text or, if no other is left, its article."""
    if all(n.named is None for n in opened):
        return
    total = 0
    for _, parts in blocks:
        for node, raw in parts:
            size = sum(map(len, raw.split()))
            total += size
            for n in node.naming():
                n.chars += size
    inside = lambda n: n.parent is not None and n.parent.main
    spared = {n for n in opened if n.named is n and not inside(n) and 2 * n.chars > total and (n.tag != "form" or n.chars >= FRAME_CHARS)}
    live = lambda n: all(x in spared for x in n.naming())
    while not any(n.main and not n.noise and live(n) for n in opened):
        more = {n for n in opened if n.named is n and n.holds_main and n not in spared and (n.parent is None or live(n.parent))}
        if not more:
            break
        spared |= more
    for n in opened:
        n.noise |= (n.named is n and n not in spared) or (n.parent is not None and n.parent.noise)


def read_page(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements that are not noise, and the page's blocks of text with the element each stands in."""
    stack = [Node("html", "", None)]
    opened: list[Node] = []
    blocks: list[tuple[Node, list[tuple[Node, str]]]] = []
    texts: list[tuple[Node, str]] = []

    def flush() -> None:
        if texts:
            at = stack[-1]
            while at.tag in _INLINE and at.parent is not None:
                at = at.parent
            blocks.append((at, texts.copy()))
            texts.clear()

    def close(upto: int) -> None:
        if any(n.tag not in _INLINE for n in stack[upto:]):
            flush()
        del stack[upto:]

    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        raw = html[at : m.start() if m else len(html)]
        if raw and not stack[-1].noise:
            texts.append((stack[-1], unescape(raw)))
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        if tag == "html":
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(html, at) if not m[3].endswith("/") else None
            if end or not m[3].endswith("/"):
                gap = html.find(">", end.end()) if end else -1
                at = gap + 1 if gap >= 0 else len(html)
            if tag not in ("script", "style", "template", "noscript"):
                flush()
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        elif tag in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    close(k)
                    break
                if stack[k].tag in _SCOPE[tag]:
                    break
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            if tag == "br" and not stack[-1].noise:
                texts.append((stack[-1], " "))
            continue
        node = Node(tag, m[3], stack[-1])
        opened.append(node)
        stack.append(node)
    flush()
    _settle_names(opened, blocks)
    joined = ((at, " ".join("".join(raw for node, raw in parts if not node.noise).split())) for at, parts in blocks)
    return [n for n in opened if n.tag not in _INLINE and not n.noise], [(at, text) for at, text in joined if text]


def _code(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and style: the distinct texts below it and the distinct layouts of its children. Style 0 stands for the page; `page` is a code of its text."""
    for part in slices(batches, "html"):
        rows = []
        for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
            nodes, blocks = read_page(html or "")
            host, page, seen = _code(host_of(url)), _code("\n".join(t for _, t in blocks)), set()
            if blocks:
                seen.add((0, False, 0, 0))
            for node in nodes:
                if node.tag not in _KEEP_TAGS:
                    seen.add((_code(node.style), False, _code("|".join(node.children)), len(node.children)))
            for node, text in blocks:
                feature = _code(text)
                while node is not None and node.tag not in _KEEP_TAGS:
                    seen.add((_code(node.style), True, feature, 0))
                    node = node.parent
            rows += [(host, page, *x) for x in seen]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "style", "content", "feature", "children"])


def style_importance(pages: DataFrame, decay: float = 0.9) -> DataFrame:
    """(host, style, pages, importance, host_pages) for the style nodes of each host of `pages(url, html)`; pages of equal text count once.

    Over m pages a feature seen on k of them has entropy log(k) / log(m). Content importance is one less the mean entropy
    of the texts below the node; presentation importance is the entropy of the layouts of its children; the more
    children, the more presentation counts."""
    found = pages.select("url", "html").mapInArrow(_features, "host long, page long, style long, content boolean, feature long, children long")
    once = found.groupBy("host", "page", "style", "content", "feature").agg(F.max("children").alias("children"))
    seen = once.groupBy("host", "style", "content", "feature").agg(F.count(F.lit(1)).alias("k"), F.max("children").alias("children"))
    log_k, k = F.log(F.col("k").cast("double")), F.col("k")
    layout = ~F.col("content")
    sums = seen.groupBy("host", "style").agg(
        F.sum(F.when(layout, k)).alias("layouts"),
        F.sum(F.when(layout, k * log_k)).alias("layout_log"),
        F.sum(F.when(layout, k * F.col("children"))).alias("children"),
        F.sum(F.when(layout, 0).otherwise(log_k)).alias("text_log"),
        F.sum(F.when(layout, 0).otherwise(1)).alias("texts"),
        F.max("k").alias("most"),
    )
    m = F.greatest(F.col("layouts"), F.col("most")).cast("double")
    content = F.when(F.col("texts") > 0, 1 - F.col("text_log") / F.col("texts") / F.log(m)).otherwise(0.0)
    layout_entropy = (F.log(F.col("layouts").cast("double")) - F.col("layout_log") / F.col("layouts")) / F.log(m)
    keep = F.pow(F.lit(decay), F.col("children") / F.col("layouts"))
    importance = F.when(m <= 1, 1.0).when(F.col("children") > 0, (1 - keep) * layout_entropy + keep * content).otherwise(content)
    sums = stage(sums.where("layouts is not null").select("host", "style", m.cast("long").alias("pages"), importance.alias("importance")))
    return sums.where("style <> 0").join(sums.where("style = 0").select("host", F.col("pages").alias("host_pages")), "host")


def main_text(html: str | None, low: set[int] | None = None) -> str:
    """Blocks of the article, one a line, without noise and without the styles in `low`.

    The plain blocks of an article or main element stay in any case. Text outside of such elements goes, unless it outweighs them
    (`OUTSIDE`), as beside a teaser."""
    _, blocks = read_page(html or "")
    verdicts: dict[int, bool] = {}

    def cut(node: Node | None) -> bool:
        if node is None or node.tag in _KEEP_TAGS:
            return cut(node.parent) if node is not None and node.parent is not None else False
        if id(node) not in verdicts:
            plain = node.main and not node.styled
            verdicts[id(node)] = (not plain and _code(node.style) in low) or cut(node.parent)
        return verdicts[id(node)]

    left = [(n.main, t) for n, t in blocks if not n.noise and not (low and cut(n))]
    inside = sum(len(t) for main, t in left if main)
    article = inside and sum(len(t) for _, t in left) <= (1 + OUTSIDE) * inside
    return "\n".join(t for main, t in left if main or not article)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [main_text(html, set(low) if low else None) for html, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist())]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(sizes)], names=["page_id", "url", "text", "n_chars"])


def _host_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_code(host_of(u)) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], names=[*batch.schema.names, "host"])


def unimportant(tree: DataFrame, least_pages: int, low: float) -> DataFrame:
    """The rows of `style_importance` to cut: under a bound of `low` that falls in proportion below `least_pages` pages, to nothing at one page.

    A style that only some of a host's pages have needs `least_pages` pages; on hosts of fewer pages it must be on all of them."""
    bound = F.lit(low) * F.least(F.lit(1.0), (F.col("pages") - 1) / F.lit(max(1, least_pages - 1)))
    return tree.where((F.col("pages") >= F.least(F.lit(least_pages), F.col("host_pages"))) & (F.col("pages") > 1) & (F.col("importance") < bound))


def extract_main_text(pages: DataFrame, least_pages: int = 8, low: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages(page_id, url, html)`.

    Text of a block: character references decoded, white space made one space, trimmed; blocks follow page order, one a
    line. A style node seen on at least `least_pages` pages of its host with importance under `low` is cut with all below it;
    on hosts of two pages or more but fewer than that, one seen on all of them with importance under a part of `low` (`unimportant`).
    Null and empty pages give an empty text; pages without a host share the empty host; pages of equal text count once
    and give a row each; a page of any length is read whole.
    """
    pages = columns_or_null(pages, page_id="long", url="string", html="string")
    noise = unimportant(style_importance(pages), least_pages, low)
    noise = stage(noise.groupBy("host").agg(F.collect_set("style").alias("low")))  # one row a host: its tree, not its pages
    coded = pages.mapInArrow(_host_codes, "page_id long, url string, html string, host long")
    return coded.join(noise, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
