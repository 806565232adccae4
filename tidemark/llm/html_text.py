"""Main text of web pages, with site templates removed.

Every element that may be a template is hashed with its whole subtree. Spark counts, per host, in how many
different pages each hash occurs; subtrees that recur across many pages of their host are deleted when the
text is taken, however many pages the host has, unless they hold more than half of a page's text. Elements that are not text of the article by their
nature (menus, footers, forms, scripts, adverts, comments and so on) go by tag, role and class name.

Class and id names count whole: a known name, or one that ends in a known name or goes on with a usual ending
(``left-sidebar``, ``related-posts``; not ``no-sidebar`` or ``related-work``). If every ``article`` and ``main``
lies inside such elements, these are kept.

The article is the longest ``article`` element, unless it is less than a quarter of the longest ``main``, or of
the body if there is none; then ``main``, by the same measure, else the body. Inside an ``article`` or
``main``, its own paragraphs, headings and list items are text however often they recur; only containers can
be templates there. Copies of a page count as one page, so copied articles are no template.

Defined results: null html gives an empty text; a page cut off inside a tag ends there; a null url is a host
of its own; repeated rows repeat their result; an empty table gives no rows; a line break is white space; a
computed column replaces one of its name. Whole pages are read, in one pass over their tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import slices, stored

LEAST_PAGES = 5
MOST_OF_TEXT = 0.5
ROOT_SHARE = 0.25

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(>|\Z)|</[^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[a-z0-9]+")

SKIPPED = frozenset("script style noscript template iframe object svg math canvas head title nav header footer aside form button select textarea input dialog menu".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption".split())
CONTAINERS = frozenset("div section ul ol dl table tbody thead tfoot tr figure address center details fieldset hgroup summary article main body html".split())
BLOCKS = PROSE | CONTAINERS | SKIPPED | {"hr", "legend"}
CLOSED_BY = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table article main section div body".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer cookie"
    " cookies consent gdpr notice banner popup modal newsletter subscribe share sharing social comment comments reply replies respond related widget alert masthead".split()
)
ENDINGS = frozenset(
    "list area section box bar wrapper wrap container slot links link buttons button posts articles stories signup form items item inner block unit thread"
    " left right top bottom primary secondary content message overlay icons toggle".split()
)
NEGATIONS = frozenset("no not non has have with without hide".split())
#: Skipped elements that are kept when the only article stands inside them.
HOLDERS = frozenset("header aside form dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


@dataclass
class Element:
    tag: str
    first: int  # place of its first block
    skipped: bool
    parts: list[str] = field(default_factory=list)
    size: int = 0


@dataclass
class Page:
    """Blocks of text in page order; candidate roots and candidate templates as ``(hash, first, end, size)``."""

    blocks: list[str]
    roots: list[tuple[str, int, int, int]]
    templates: list[tuple[int, int, int, int, bool]]


def named(value: str) -> bool:
    """Whether one of the blank-separated names marks something else than the article."""
    for name in value.split():
        parts = NAME_PARTS.findall(name)
        if not parts or not NEGATIONS.isdisjoint(parts):
            continue
        if parts[-1] in NAMES or len(parts) > 1 and parts[-1] in ENDINGS and parts[-2] in NAMES:
            return True
    return False


def unwanted(tag: str, attributes: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and named(value):
            return True
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def read(source: str) -> Page:
    """A page's blocks, with what holds its only articles kept."""
    page, holders = parse(source, frozenset())
    if holders and not any(r[3] and r[0] != "body" for r in page.roots):
        page, _ = parse(source, frozenset(holders))
    return page


def parse(source: str, kept: frozenset[int]) -> tuple[Page, set[int]]:
    """One pass over the tags of a page; also the places of skipped elements that hold an ``article`` or ``main``.

    Elements at the places ``kept`` are not skipped.
    """
    page = Page([], [], [])
    holders: set[int] = set()
    open_holders: list[tuple[int, int, bool]] = []  # depth and place of skipped elements, and whether they may be kept
    stack = [Element("", 0, False)]
    text: list[str] = []
    skipped = articles = 0

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                page.blocks.append(block)
                stack[-1].parts.append(block)
                stack[-1].size += len(block)

    def close() -> None:
        nonlocal skipped, articles
        if stack[-1].tag in BLOCKS:
            flush()
        node = stack.pop()
        skipped -= node.skipped
        if node.skipped or skipped:
            return
        stack[-1].size += node.size
        if node.tag not in BLOCKS:
            stack[-1].parts += node.parts
            return
        code = xxhash.xxh3_64_intdigest(f"{node.tag}\x1f{'\x1e'.join(node.parts)}".encode("utf-8", "surrogatepass"))
        stack[-1].parts.append(f"{code:x}")
        end = len(page.blocks)
        if node.tag in ("article", "main", "body"):
            articles -= node.tag != "body"
            page.roots.append((node.tag, node.first, end, node.size))
        elif node.size and (not articles or node.tag in CONTAINERS):
            page.templates.append((code - (1 << 63), node.first, end, node.size, node.tag in PROSE))

    at = 0
    while True:
        found = TOKEN.search(source, at)
        plain = source[at : found.start() if found else len(source)]
        if plain and not skipped:
            text.append(html.unescape(plain) if "&" in plain else plain)
        if not found:
            break
        at = found.end()
        slash, name, attributes, ended = found.groups()
        if name is None:
            continue
        if not ended:
            break  # the page ends inside a tag
        tag = name.lower()
        if tag == "br":
            text.append(" ") if not skipped else None
            continue
        if slash:
            place = len(stack) - 1
            while place > 0 and stack[place].tag != tag:
                if tag not in BLOCKS and stack[place].tag in BLOCKS or tag in PROSE and stack[place].tag in SCOPES:
                    place = 0  # an end tag reaches out of its own scope only for containers
                    break
                place -= 1
            if place > 0:
                while len(stack) > place:
                    close()
            continue
        if tag in BLOCKS:
            flush()
            place = len(stack) - 1
            while place > 0 and stack[place].tag not in SCOPES:
                if tag in CLOSED_BY.get(stack[place].tag, ()):
                    while len(stack) > place:
                        close()
                    break
                place -= 1
        if tag in VOID:
            continue
        bad = unwanted(tag, attributes) and found.start() not in kept
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = stop.end() if stop else len(source)
            if bad or skipped:
                continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        while open_holders and open_holders[-1][0] >= len(stack):
            open_holders.pop()
        if bad:
            open_holders.append((len(stack), found.start(), tag not in SKIPPED or tag in HOLDERS))
        elif skipped and tag in ("article", "main") and all(h[2] for h in open_holders):
            holders.update(h[1] for h in open_holders)
        stack.append(Element(tag, len(page.blocks), bad))
        skipped += bad
        articles += tag in ("article", "main") and not skipped
    while len(stack) > 1:
        close()
    flush()
    return page, holders


def root_of(page: Page) -> tuple[int, int]:
    """Where the article's blocks begin and end."""
    longest = {tag: max((r for r in page.roots if r[0] == tag), key=lambda r: r[3], default=None) for tag in ("article", "main", "body")}
    whole = sum(map(len, page.blocks))
    for tag, around in (("article", longest["main"]), ("main", None)):
        found = longest[tag]
        outer = around[3] if around and around[3] else whole
        if found and found[3] and found[3] >= ROOT_SHARE * outer:
            return found[1:3]
    return longest["body"][1:3] if longest["body"] and longest["body"][3] else (0, len(page.blocks))


def candidates(page: Page) -> tuple[int, list[int]]:
    """A digest of the article's text, and the hashes of subtrees inside it that may be templates."""
    low, high = root_of(page)
    digest = xxhash.xxh3_64_intdigest("\n".join(page.blocks[low:high]).encode("utf-8", "surrogatepass")) - (1 << 63)
    most = MOST_OF_TEXT * sum(map(len, page.blocks[low:high]))
    return digest, sorted({code for code, a, b, size, _ in page.templates if low <= a and b <= high and size <= most})


def main_text(page: Page, recurring: frozenset[int]) -> str:
    low, high = root_of(page)
    blocks = page.blocks[low:high]
    if recurring:
        most = MOST_OF_TEXT * sum(map(len, blocks))
        gone = [(a, b) for code, a, b, size, _ in page.templates if code in recurring and low <= a and b <= high and size <= most]
        dropped = {i for a, b in gone for i in range(a, b)}
        blocks = [x for i, x in enumerate(blocks, low) if i not in dropped]
    return "\n".join(blocks)


def page_codes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``host, source, page, codes`` of every different source: its digest, its article's, and the subtrees that may be templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                found = [candidates(read(page or "")) for page in part.column(2).to_pylist()]
                digests, codes = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], digests, codes], names=["host", "source", "page", "codes"])

    rows = pages.select(host_of(url).alias("host"), F.md5(F.col(f"`{source}`")).alias("source"), F.col(f"`{source}`").alias(source))
    return rows.mapInArrow(run, "host string, source string, page long, codes array<long>").dropDuplicates(["host", "source"])


def site_templates(pages: DataFrame, url: str = "url", source: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, source, codes``: of each different source the subtrees found in ``least_pages`` different pages of its host.

    Codes meet pages by host and code, so a list is bounded by its own page.
    """
    seen = stored(page_codes(pages, url, source)).where("size(codes) > 0").select("host", "source", "page", F.explode("codes").alias("code"))
    many = seen.select("host", "code", "page").distinct().groupBy("host", "code").agg(F.count("*").alias("n")).where(f"n >= {least_pages}")
    return seen.join(many, ["host", "code"]).groupBy("host", "source").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, url: str = "url", source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to the kept columns of every page."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    templates = stored(site_templates(pages, url, source)).selectExpr("host AS _host", "source AS _source", "codes AS _codes")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("_html"), host_of(url).alias("_of"), F.md5(F.col(f"`{source}`")).alias("_md5"))
    joined = rows.join(templates, (F.col("_of") == F.col("_host")) & (F.col("_md5") == F.col("_source")), "left").drop("_of", "_host", "_md5", "_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                out = [main_text(read(page or ""), frozenset(codes or ())) for page, codes in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = StructType([pages.schema[c] for c in keep] + list(StructType.fromDDL("text string, n_chars long").fields))
    return joined.mapInArrow(run, schema)
