"""Main text of web pages: what a site repeats across its pages, and what its elements name as furniture, is deleted.

A page is read once into its element tree. Every element gets a hash of its whole subtree (names, classes, text). Spark
counts, per host, on how many different pages each subtree occurs; one that occurs on at least ``LEAST_PAGES`` of them and
at least ``SHARE`` of the host's is a template and is deleted wherever it occurs on that host. Pages of a host are copies,
and count once, if they have the same text without what elements name as furniture. Only block elements with text can be
templates, and inside ``article`` and ``main`` only those of ``LEAST_WORDS`` words or more, so that recurring headings and
emphasis of articles stay; what is deleted still ends a line if it is a block. If templates would leave a page
without any of its ``article`` and ``main`` elements, all of these stay. Deleted too are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element name, role,
class or id. If what is left holds an ``article`` or ``main`` element, the text is taken from there.

Text is one line per block element: character references decoded, white space folded to one space, empty lines left out.
Broken markup is read as browsers do as far as it matters here: unknown or unclosed elements end with their parent, a
``p`` or ``li`` ends at the next one, a cut-off tag at the end is dropped, stray ``<`` are text.

NULL and empty pages give an empty text. Pages without a host share the empty host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cut

LEAST_PAGES, SHARE, LEAST_WORDS = 8, 0.3, 8

SKIP = frozenset("script style noscript template head title iframe object svg canvas".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select textarea input label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a start tag of the given name closes.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of a class or id that name furniture; words are split at anything but letters and digits.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars"
    " nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead cookie cookies consent notice"
    " notices notification gdpr newsletter subscribe subscription signup share sharing social related recommended"
    " comment comments commentlist disqus reply replies respond popup modal overlay toolbar pagination pager widget".split()
)
MAIN = frozenset(("article", "main"))
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Element:
    __slots__ = ("name", "marks", "children", "furniture", "digest", "words")

    def __init__(self, name: str, marks: str, furniture: bool):
        self.name, self.marks, self.furniture = name, marks, furniture
        self.children: list = []
        self.digest = self.words = 0


def named_furniture(name: str, attributes: str) -> tuple[str, bool]:
    """What identifies an element besides its name, and whether it is furniture."""
    if name in FURNITURE:
        return "", True
    if not attributes or attributes.isspace():
        return "", False
    marks, bad = [], False
    for found in ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        marks.append(f"{key}={value}")
        if key == "role":
            bad |= value in ROLES
        elif key in ("class", "id"):
            bad |= not MARKS.isdisjoint(SPLIT.split(value)) and name not in ("html", "body", *MAIN)
        else:
            bad |= key == "hidden" or value == "true"
    return " ".join(marks), bad


def parse(page: str) -> Element:
    """The element tree of a page; text children are strings, already decoded."""
    root = Element("html", "", False)
    stack, at, size = [root], 0, len(page)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        text(page[at:begin])
        found = TAG.match(page, begin) or LOOSE.match(page, begin)
        if not found:
            text("<")
            at = begin + 1
            continue
        at = found.end()
        if found.group(0).startswith(("<!", "<?")):
            continue
        name = found[2].lower()
        if at == size and not found.group(0).endswith(">"):
            break  # a tag that the page cuts off
        if found[1]:
            if any(e.name == name for e in stack[1:]):
                while stack[-1].name != name:
                    stack.pop()
                stack.pop()
            continue
        closes = ENDS.get(name, set())
        if name in BLOCK:
            closes = closes | {"p"}
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in closes:
                    del stack[depth:]
                    break
                if stack[depth].name in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "td"):
                    break
        element = Element(name, *named_furniture(name, found[3]))
        stack[-1].children.append(element)
        if name in VOID or found[3].endswith("/"):
            continue
        if name in RAW:
            end = CLOSE_RAW[name].search(page, at)
            stop = end.start() if end else size
            if name not in SKIP:
                element.children.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else size
            at = at or size
            continue
        stack.append(element)
    return root


def can_recur(element: Element, inside: bool) -> bool:
    """Whether an element, ``inside`` a main element or not, can be a template."""
    return element.name in BLOCK and element.words >= (LEAST_WORDS if inside else 1)


def digest(root: Element) -> list[int]:
    """Sets the subtree hash and words of every element below ``root``, children first, and lists the hashes of those that
    can be templates."""
    out, todo = [], [(root, False, False)]
    while todo:
        element, ready, inside = todo.pop()
        if not ready:
            todo.append((element, True, inside))
            below = inside or element.name in MAIN
            todo += [(c, False, below) for c in element.children if not isinstance(c, str)]
            continue
        h = hashlib.blake2b(f"{element.name}\x00{element.marks}\x00".encode(), digest_size=8)
        for child in element.children:
            element.words += len(child.split()) if isinstance(child, str) else child.words
            h.update(" ".join(child.split()).encode("utf-8", "surrogatepass") if isinstance(child, str) else child.digest.to_bytes(8, "big", signed=True))
            h.update(b"\x00")
        element.digest = int.from_bytes(h.digest(), "big", signed=True)
        if element is not root and element.name not in ("html", "body") and can_recur(element, inside):
            out.append(element.digest)
    return out


def main_elements(root: Element, template: frozenset[int]) -> list[Element]:
    mains, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.furniture or element.digest in template or element.name in SKIP:
            continue
        if element.name in MAIN:
            mains.append(element)
            continue
        todo += [c for c in reversed(element.children) if not isinstance(c, str)]
    return mains


def blocks(root: Element, template: frozenset[int]) -> list[str]:
    """The text lines below ``root``, from its main elements if any survive."""
    mains = main_elements(root, template)
    if not mains and (mains := main_elements(root, frozenset())):
        template = frozenset()
    lines: list[str] = []
    parts: list[str] = []

    def end_line() -> None:
        line = " ".join("".join(parts).split())
        if line:
            lines.append(line)
        parts.clear()

    for top in mains or [root]:
        walk: list = [top]
        while walk:
            node = walk.pop()
            if node is None:
                end_line()
            elif isinstance(node, str):
                parts.append(node)
            elif node.furniture or node.name in SKIP or (node.digest in template and can_recur(node, bool(mains) and node is not top)):
                if node.name in BLOCK:
                    end_line()
            else:
                if node.name == "br":
                    parts.append(" ")
                if node.name in BLOCK:
                    end_line()
                    walk.append(None)
                walk += reversed(node.children)
        end_line()
    return lines


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    root = parse(page)
    digest(root)
    return "\n".join(blocks(root, template))


def host_of(url: str) -> Column:
    """Host of a url in lower case, without user and port; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


def templates(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """(host, template): the recurring subtrees of each host that has any. The list is bounded by the page size: each
    entry is on SHARE of the pages, so there are at most 1 / SHARE times as many as a page has elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts, pages, trees = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                root = parse(page or "")
                own = set(digest(root))
                own.add(0)  # counts the page itself
                text = "\n".join(blocks(root, frozenset())) or page or ""
                hosts.append(host)
                texts.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                pages.append(hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
                trees.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(texts, pa.binary()), pa.array(pages, pa.binary()), pa.array(trees, pa.list_(pa.int64()))],
                names=["host", "text", "page", "trees"],
            )

    seen = (
        pages.select(host_of(url).alias("host"), F.col(html_column).alias("page"))
        .mapInArrow(run, "host string, text binary, page binary, trees array<bigint>")
        .groupBy("host", "text")
        .agg(F.min_by("trees", "page").alias("trees"))
        .select("host", F.explode("trees").alias("tree"))
        .groupBy("host", "tree")
        .agg(F.count("*").alias("pages"))
    )
    frequent = cut(seen.filter(F.col("pages") >= LEAST_PAGES), "trees")
    total = frequent.filter("tree = 0").select("host", F.col("pages").alias("all"))
    recurring = frequent.filter("tree <> 0").join(total, "host").filter(F.col("pages") >= SHARE * F.col("all"))
    return cut(recurring.groupBy("host").agg(F.collect_list("tree").alias("template")), "templates")


def extract(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """Every column of ``pages`` but the page itself, and text, n_chars (existing columns of these names are replaced)."""
    found = templates(pages, url, html_column)
    keep = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    marked = pages.select(*keep, host_of(url).alias("_tpl_host"), F.col(html_column).alias("_tpl_page"))
    joined = marked.join(found.withColumnsRenamed({"host": "_tpl_host", "template": "_tpl_set"}), "_tpl_host", "left")

    @F.arrow_udf("string")
    def text_of(page: pa.Array, template: pa.Array) -> pa.Array:
        out, known = [], {}
        for p, t in zip(page.to_pylist(), template):
            key = tuple(t.as_py() or ())
            if key not in known:
                known = {key: frozenset(key)}
            out.append(main_text(p, known[key]) if p else "")
        return pa.array(out, pa.string())

    return joined.select(*keep, text_of("_tpl_page", "_tpl_set").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
