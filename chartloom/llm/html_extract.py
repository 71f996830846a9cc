"""Main-text extraction with site template removal.

A page is parsed once, into its text blocks and the hashes of the block elements around each (a subtree's hash takes its
tag, class, id, role, texts and children in order).  Spark counts for each host on how many page versions a subtree occurs,
pages of equal content being one version, and every block inside a subtree that recurs on many versions of its host goes:
menus, banners and notices, and within the article adverts, share lines and author boxes, with or without telling markup.
Where that would leave nothing of a page's article, all of the article stays: it is one that the site repeats.

What markup tells goes by markup as well: elements such as nav, footer, aside, form, script, and elements that name one of
ROLES: outside articles as a part of their class, id or role, inside as a whole class or the role (or as the id of a list of
reader comments), since ids and parts of names there are those of headings and topics (search-algorithms, related-work).  The text is that of the page's article or main elements where it has any, else of what is left of
its body.  Character references are decoded, white space inside a block becomes one space, and blocks are joined by an
empty line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import materialize, pick, python_stage

_NAME = r"[a-zA-Z][^\s/>]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|object|select|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>{_NAME})(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?{_NAME}[^>]*>|<[!?][^>]*>|</[^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr td th ul".split()
)
CONTENT = frozenset(("article", "main"))
REMOVED = frozenset("nav footer aside form button dialog menu search head input label fieldset".split())
#: An element of one of these ends an open p.
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "html", "body", "head"}
_OWN_KIND = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id and role that name what is not main text.
ROLES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer contentinfo sidebar aside complementary widget rail notice notices cookie cookies consent gdpr alert popup modal overlay "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe signup login search share sharing social related recommended comment comments commentlist disqus respond replies reactions pagination pager toolbar skip".split()
)
_ROLES_INSIDE = ROLES - {"header", "masthead"}  # an article's own header holds its title
_COMMENT_IDS = frozenset("comment comments commentlist disqus respond replies".split())
_ROLE_TAGS = frozenset("div section ul ol dl p span aside header table article li figure blockquote details center h2 h3 h4 h5 h6 address".split())


class _Element:
    __slots__ = ("tag", "parts", "children", "hash", "content", "gone", "block")

    def __init__(self, tag: str, gone: bool):
        self.tag, self.parts, self.gone = tag, [], gone  # parts: texts and elements, in order
        self.children: list[_Element] = []
        self.hash, self.content, self.block = 0, False, tag in BLOCK


def _telling(attrs: str, tag: str, inside: bool) -> tuple[str, bool]:
    """What a subtree's hash takes of the attributes, and whether they name a part that is not main text."""
    key, gone = [], False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        key.append(f"{name}={value}")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            gone = True
        elif inside and name in ("class", "role") and tag in _ROLE_TAGS:
            gone = gone or not _ROLES_INSIDE.isdisjoint(value.split())
        elif inside and name == "id" and tag in ("div", "section", "ul", "ol"):
            gone = gone or value.strip() in _COMMENT_IDS
        elif not inside and name != "hidden" and tag in _ROLE_TAGS:
            gone = gone or not ROLES.isdisjoint(re.split(r"[^a-z0-9]+", value))
    return " ".join(key), gone


def parse(page: str) -> _Element:
    """The element tree of a page; unclosed and stray tags are repaired as browsers do in the common cases."""
    root = _Element("html", False)
    stack, keys, at = [root], [""], 0

    def shut() -> None:
        e = stack.pop()
        parts = [e.tag, keys.pop()]
        content = e.tag in CONTENT
        for p in e.parts:
            if isinstance(p, str):
                parts.append(" ".join(p.split()))
            else:
                parts.append(f"{p.hash:x}")
                content = content or p.content
        e.hash, e.content = xxhash.xxh64_intdigest("\x1f".join(parts)), content

    def add_text(text: str) -> None:
        if text:
            stack[-1].parts.append(text)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add_text(html.escape(m[0][9:-3]))
            continue
        tag = name.lower()
        if m["close"]:
            if tag in VOID:
                if tag == "br":
                    add_text(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        shut()
                    break
                if stack[depth].tag in CONTENT or stack[depth].tag in ("td", "th", "table", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main"):
                    break  # a stray end tag does not close what is around an article or a cell
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                add_text("" if tag == "wbr" else " ")
            continue
        if tag in _ENDS_P or tag in _OWN_KIND:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag == "p" and tag in _ENDS_P or open_tag == tag and tag in _OWN_KIND or tag in ("dt", "dd") and open_tag in ("dt", "dd"):
                    while len(stack) > depth:
                        shut()
                    if open_tag != "p":
                        break
                elif open_tag in _OWN_KIND.get(tag, ()) or open_tag in BLOCK and open_tag not in ("li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "p"):
                    break
        attrs = m["attrs"]
        if tag in REMOVED:
            key, gone = attrs, True
        elif attrs and ("=" in attrs or "hidden" in attrs.lower()):
            key, gone = _telling(attrs, tag, any(e.tag in CONTENT for e in stack))
        else:
            key, gone = "", False
        if tag == "header" and not gone:
            gone = not any(e.tag in CONTENT for e in stack)
        e = _Element(tag, gone)
        stack[-1].parts.append(e)
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(e)
        keys.append(key)
    if at < len(page):
        add_text(page[at:])
    while stack:
        shut()
    return root


def blocks_of(root: _Element) -> tuple[list[tuple[str, tuple[int, ...]]], bool]:
    """The text blocks of the content elements, or else of all that markup does not remove, each with the hashes of the
    block elements around it (content elements, and what is around one, left out); and whether there are content elements."""
    content = list(_outermost(root))
    kept = content or [root]
    blocks: list[tuple[str, tuple[int, ...]]] = []
    held: list[str] = []

    def flush(chain: tuple[int, ...]) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append((text, chain))
        held.clear()

    for top in kept:
        todo: list[tuple[_Element, int, tuple[int, ...]]] = [(top, 0, ())]
        while todo:
            e, i, chain = todo.pop()
            if i == 0 and e.block:
                flush(chain)
                if not e.content and e is not root:
                    chain = (*chain, e.hash)
            while i < len(e.parts):
                p = e.parts[i]
                i += 1
                if isinstance(p, str):
                    held.append(p)
                elif p.gone:
                    if p.block:
                        flush(chain)
                else:
                    if p.tag in ("td", "th"):
                        held.append(" ")
                    if p.block:
                        flush(chain)
                    todo += [(e, i, chain), (p, 0, chain)]
                    break
            else:
                if e.block:
                    flush(chain)
        flush(())
    return blocks, bool(content)


def main_text(blocks: list[tuple[str, tuple[int, ...]]], article: bool, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks outside all templates; all blocks of an article of which none would be left."""
    left = [text for text, chain in blocks if templates.isdisjoint(chain)]
    return "\n\n".join([text for text, _ in blocks] if article and not left else left)


def _outermost(root: _Element) -> Iterator[_Element]:
    """The content elements that lie in no other and in nothing that markup removes."""
    todo = [root]
    while todo:
        e = todo.pop()
        if e.gone:
            continue
        if e.tag in CONTENT:
            yield e
        else:
            todo += [p for p in reversed(e.parts) if not isinstance(p, str) and p.content]


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_HELD_TEMPLATES = 1_000_000  # template hashes sent to every task at most; with more, they come by a join
_PARSED = "row_id bigint, page_id bigint, url string, host string, version bigint, article boolean, texts array<string>, chains array<array<bigint>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b in batches:
        found = [blocks_of(parse(t or "")) for t in b.column("html").to_pylist()]
        pages, article = [blocks for blocks, _ in found], [a for _, a in found]
        texts = [[t for t, _ in blocks] for blocks in pages]
        version = [signed(xxhash.xxh64_intdigest("\x1f".join(t))) for t in texts]
        chains = [[list(map(signed, c)) for _, c in blocks] for blocks in pages]
        names = ("row_id", "page_id", "url", "host")
        yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(version, pa.int64()), pa.array(article, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(chains, pa.list_(pa.list_(pa.int64())))], [*names, "version", "article", "texts", "chains"])


def _templates(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, hash): subtrees on at least `least_pages` page versions and `least_share` of those of their host."""
    rows = pages.select("host", "version", F.explode(F.array_distinct(F.flatten("chains"))).alias("hash")).distinct()
    counts = rows.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    of_host = pages.select("host", "version").distinct().groupBy("host").agg(F.count("*").alias("versions"))
    return counts.join(of_host, "host").where(F.col("n") >= F.lit(least_share) * F.col("versions")).select("host", "hash")


def _texts(pages: Iterator[pa.RecordBatch], own_of) -> Iterator[pa.RecordBatch]:
    for b in pages:
        every = zip(*(b.column(c).to_pylist() for c in ("texts", "chains", "article")), own_of(b), strict=True)
        texts = [main_text(list(zip(t, c, strict=True)), article, own) for t, c, article, own in every]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, least_pages: int = 5, least_share: float = 0.3, held: int = _HELD_TEMPLATES) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars): one row per input row.

    Null html has empty text; null urls share the host ''.  Repeated rows come back each, and are one version in the counts.
    Very long pages are parsed whole.  An empty table gives no rows.

    Up to `held` templates are broadcast; more of them are joined to the pages by host and hash.
    """
    spark = pages.sparkSession
    python_stage(spark)
    rows = pick(pages, page_id="bigint", url="string", html="string")
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", host_of(F.col("url")).alias("host"), "html")
    parsed = materialize(rows.mapInArrow(_parsed, _PARSED), "html-parsed")
    found = materialize(_templates(parsed, least_pages, least_share), "html-templates")
    kind = "page_id bigint, url string, text string"
    if found.count() <= held:
        known: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            known.setdefault(r["host"], set()).add(r["hash"])
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _texts(batches, lambda b: [shared.value.get(h, frozenset()) for h in b.column("host").to_pylist()])

        out = parsed.mapInArrow(run, kind)
    else:
        hits = parsed.select("row_id", "host", F.explode(F.array_distinct(F.flatten("chains"))).alias("hash")).join(found, ["host", "hash"])
        own = hits.groupBy(F.col("row_id").alias("hit_id")).agg(F.collect_list("hash").alias("hashes"))  # of one page's subtrees

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _texts(batches, lambda b: [frozenset(h or ()) for h in b.column("hashes").to_pylist()])

        out = parsed.join(own, parsed["row_id"] == own["hit_id"], "left").select("page_id", "url", "texts", "chains", "article", "hashes").mapInArrow(run_joined, kind)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
