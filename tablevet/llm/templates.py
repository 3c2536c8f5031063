"""Main text of web pages by removal of site templates.

Every element subtree below the body is hashed (tag, class, text and children).  Spark counts on
how many pages of a host each subtree occurs; those on many pages are the site's template and
are deleted.  What a page then still has besides its article, such as an advert that changes
from page to page, is told by the element's role.

Paragraphs, headings, lists and the like inside an article are content even where they recur:
a passage that many pages quote is no template.  Other subtrees that recur go, there too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tablevet.llm.bytegrams import ddl
from tablevet.sources.scratch import staged

LEAST_PAGES = 3
LEAST_SHARE = 0.05
SALTS = 32

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_BLOCKS = _CLOSES_P | frozenset("body caption dd dt html li legend option optgroup summary tbody td tfoot th thead tr".split())
#: An element that is begun ends an open one of these kinds, up to the nearest of the others.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_CONTENT = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption "
    "a abbr b bdi bdo br cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var "
    "article main hr img".split()
)
_MAIN = frozenset(("article", "main"))
_NEVER = frozenset(
    "head script style template noscript nav footer aside form button input select option textarea label fieldset "
    "dialog menu search iframe frame frameset noframes object embed applet audio video canvas svg math map datalist".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note".split())
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices "
    "popup promo promoted promotion recommended related respond share sharing sidebar sidebars sitemap skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: With these a class is still a part: "site-footer", "sidebar-left"; "content-sidebar-wrap" or "has-navbar" is none.
_PLACES = frozenset("area bar block bottom box container global left list main page primary right secondary section side site slot top".split())
_WORD = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "name", "plain", "aside", "parts", "hash")

    def __init__(self, tag: str, name: str = "", plain: bool = True, aside: bool = False):
        self.tag, self.name, self.plain, self.aside = tag, name, plain, aside
        self.parts: list = []
        self.hash = 0


def _is_part(token: str) -> bool:
    """Whether a whole class or id names a part of a page beside its content."""
    words = set(_WORD.findall(token))
    return not _PARTS.isdisjoint(words) and words <= _PARTS | _PLACES


def _look(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """(class and id, whether the element may be content, whether its name tells otherwise, whether it is a main region)."""
    if not raw or raw.isspace():
        return "", tag not in _NEVER, False, tag in _MAIN
    found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(raw)}
    name = f"{found.get('id', '')} {found.get('class', '')}".strip()
    role = found.get("role", "").lower()
    plain = not (
        tag in _NEVER
        or role in _ROLES
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    aside = tag not in ("html", "body") and any(map(_is_part, name.lower().split()))
    return name, plain, aside, tag in _MAIN or role == "main"


def parse(page: str) -> _Node:
    """The element tree of a page, forgiving what is unclosed or misplaced."""
    root = _Node("")
    stack, at = [root], 0
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].parts.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in _BLOCKS and (tag not in _BLOCKS or tag == "p"):
                    if tag == "p":  # as browsers do: an end without a start is an empty paragraph
                        stack[-1].parts.append(_Node("p"))
                    break  # an inline end does not close blocks
            continue
        tag = (found[2] or found[4] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                stack[-1].parts.append(found[0][9:].removesuffix("]]>"))
            continue
        if tag in _CLOSES_P:
            _end(stack, {"p"}, _BLOCKS - {"p"})
        if tag in _ENDS:
            _end(stack, *_ENDS[tag])
        raw = found[3] if found[2] else found[5]
        name, plain, aside, main = _look(tag, raw or "")
        node = _Node("main" if main else tag, name, plain, aside)
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            node.parts.append(page[at : end.start()] if end else page[at:])
            if not end:
                return root
            close = page.find(">", end.end())
            at = len(page) if close < 0 else close + 1
        elif tag not in _VOID:
            stack.append(node)


def _end(stack: list[_Node], ended: set, until: set) -> None:
    lowest = 0
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in ended:
            lowest = depth
        elif stack[depth].tag in until or stack[depth].tag in ("main", "article"):
            break
    if lowest:
        del stack[lowest:]


def _hashed(node: _Node) -> list[_Node]:
    """All elements below ``node``, their hashes set from the leaves up."""
    order, todo = [], [node]
    while todo:
        here = todo.pop()
        order.append(here)
        todo.extend(p for p in here.parts if isinstance(p, _Node))
    for here in reversed(order):
        own = [here.tag, here.name]
        own += [str(p.hash) if isinstance(p, _Node) else _SPACE.sub(" ", p).strip() for p in here.parts]
        here.hash = xxh3_64_intdigest("\x1f".join(x for x in own if x)) - (1 << 63)
    return order


def _subtrees(page: str) -> set[int]:
    """Hashes of the subtrees that a template can consist of."""
    return {n.hash for n in _hashed(parse(page)) if n.tag not in ("", "html", "body", "head") and n.parts}


def _regions(root: _Node) -> list[_Node]:
    regions, todo = [], [root]
    while todo:
        here = todo.pop()
        if not here.plain or here.aside:
            continue
        if here.tag in _MAIN:
            regions.append(here)
        else:
            todo.extend(p for p in reversed(here.parts) if isinstance(p, _Node))
    return regions


def _keep_wrappers(order: list[_Node]) -> None:
    """Names count for nothing on elements that are or hold an article, or else more than half of the page's text."""
    held: dict[int, tuple[int, bool]] = {}
    for here in reversed(order):
        size, main = 0, here.tag in _MAIN
        for p in here.parts if here.plain else ():
            own = held[id(p)] if isinstance(p, _Node) else (len(p.strip()), False)
            size, main = size + own[0], main or own[1]
        held[id(here)] = size, main and here.plain
    size, main = held[id(order[0])]
    for here in order:
        own = held[id(here)]
        if own[1] or (not main and 2 * own[0] > size):
            here.aside = False


def main_text(page: str, template: set[int]) -> str:
    """The text of a page's blocks, one to a line, without the template's subtrees.

    Elements named as a part beside the content go, but not if all of the page's articles, or most
    of the text of a page without one, are inside.
    """
    root = parse(page)
    order = _hashed(root)
    regions = _regions(root)
    if not regions:
        _keep_wrappers(order)
        regions = _regions(root)
    blocks: list[str] = []
    pieces: list[str] = []

    def flush():
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                blocks.append(text)
            pieces.clear()

    inside = bool(regions)
    for region in regions or [root]:
        work: list = [region]
        while work:
            here = work.pop()
            if here is None:
                flush()
            elif isinstance(here, str):
                pieces.append(here)
            elif here.tag == "br":
                pieces.append(" ")
            else:
                if here is not region:
                    recurs = here.hash in template and here.tag not in ("html", "body")
                    if not here.plain or here.aside or (recurs and not (inside and here.tag in _CONTENT)):
                        continue
                    if here.tag == "header" and not (inside and _has_heading(here)):
                        continue
                block = here.tag in _BLOCKS or here.tag == "main"
                if block:
                    flush()
                    work.append(None)
                work.extend(reversed(here.parts))
        flush()
    return "\n".join(blocks)


def _has_heading(node: _Node) -> bool:
    return any(isinstance(p, _Node) and (p.tag == "h1" or _has_heading(p)) for p in node.parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, hashes = [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            own = _subtrees(page.as_py() or "")
            hosts += [host] * len(own)
            hashes += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "subtree"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.drop_columns(["html", "__subtrees"])
        for start in range(0, batch.num_rows, 512):
            own = batch.slice(start, 512)
            texts = []
            for page, hashes in zip(own.column("html"), own.column("__subtrees").to_pylist()):
                texts.append(main_text(page.as_py() or "", set(hashes or ())))
            rest = kept.slice(start, 512)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*rest.schema.names, "text"])


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_subtrees(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host, subtrees``: the hashes of the subtrees on at least ``least_pages`` pages and the given share of a host's.

    At most (subtrees of a page) / ``least_share`` can recur so often, which bounds a host's list.
    """
    hosted = pages.select(_host().alias("host"), "html")
    counts = hosted.mapInArrow(_counted, "host string, subtree bigint").groupBy("host", "subtree").agg(F.count("*").alias("n"))
    sizes = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.filter(F.col("n") >= least_pages).join(sizes, "host").filter(F.col("n") >= F.col("pages") * least_share)
    return staged(often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")))


def main_texts(pages: DataFrame, **options) -> DataFrame:
    """``pages`` with ``text``, the main text, in place of ``html``.

    White space in a block is one space, blocks are joined by one line feed, character references are
    decoded.  A null or empty page has an empty text; pages with a null or odd url share the
    empty host; pages are extracted one by one, so repeated rows stay, and so do other columns.
    """
    templates = template_subtrees(pages, **options)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    salted = templates.select(F.col("host").alias("__host"), salts, F.col("subtrees").alias("__subtrees"))
    rows = pages.drop("text").withColumn("__host", _host()).withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, ["__host", "__salt"], "left").drop("__host", "__salt")
    return rows.mapInArrow(_extracted, f"{ddl(rows.drop('html', '__subtrees'))}, text string")
