"""Main text of web pages: markup where it tells, and runs that repeat across a host's pages where it does not."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cladeflow.llm.common import settle

#: A repeated run is long from so many words on.
LONG = 5

# Element names by what they mean for a page's text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head map menu nav object select svg math template video".split())
# Words in `class`, `id` and `role` that name page furniture; the first set holds inside an article as well.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus replies respond discussion "
    "share sharing social related recommended recommendations paywall".split()
)
LAYOUT = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary widget toolbar pagination "
    "pager login search skip".split()
)
MAIN_NAMES = frozenset(
    "main content maincontent main-content article post entry story articlebody article-body article-content post-content post-body "
    "entry-content story-body".split()
)
# A start tag of the key closes these when they are open in the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table div section article main body td th blockquote".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+)(>|\Z)|<(?=/?[a-zA-Z]).*\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
SKIP, NEUTRAL, MAIN, ARTICLE = -1, 0, 1, 2


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}


def _zone(tag: str, attributes: str, inside: int, in_furniture: bool, seen_article: bool) -> tuple[int, bool]:
    """The zone of an element in a parent's zone, and whether it is furniture that no article inside can undo."""
    names = _names(attributes) if attributes and not attributes.isspace() else {}
    text = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}"
    parts = {p.lower() for p in _NAME_PARTS.findall(text)} if names else set()
    hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
    whole = {w.lower() for w in text.split()} | {names.get("itemprop", "").lower()}
    if tag in ("html", "body"):
        return inside, in_furniture
    if in_furniture or hidden or tag in DROPPED or parts & FURNITURE and not whole & MAIN_NAMES:
        return SKIP, True
    if tag == "article":
        return (ARTICLE, False) if inside != SKIP or not seen_article else (SKIP, True)
    if tag == "main" or "main" in names.get("role", "").split():
        return max(inside, MAIN), False
    if inside == SKIP:
        return SKIP, False
    if whole & MAIN_NAMES:
        return max(inside, MAIN), False
    if tag == "header" and inside < MAIN or parts & LAYOUT and inside < ARTICLE:
        return SKIP, False
    return inside, False


def page_blocks(source: str) -> list[tuple[int, str]]:
    """`(zone, text)` of the blocks of a page in order: references decoded, white space turned into single spaces."""
    found: list[tuple[int, str]] = []
    run: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    zone, furniture, seen_article, at = NEUTRAL, False, False, 0

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append((zone, text))

    def pop(to: int) -> None:
        nonlocal zone, furniture
        flush()
        del stack[to:]
        zone, furniture = (stack[-1][1], stack[-1][2]) if stack else (NEUTRAL, False)

    size = len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if not m:
            run.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            run.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS or stack[i][1] != zone:
                        pop(i)
                    else:
                        del stack[i:]
                        zone, furniture = (stack[-1][1], stack[-1][2]) if stack else (NEUTRAL, False)
                    break
            continue
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else size
            continue
        if tag in BLOCKS:
            flush()
            closes = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" and tag not in ("br", "option") or name in closes:
                    pop(i)
                    break
                if name in CONTAINERS:
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("br", "hr", "img"):
            continue
        here, hard = _zone(tag, m[3], zone, furniture, seen_article)
        if here != zone:
            flush()
        seen_article |= here == ARTICLE
        stack.append((tag, here, hard))
        zone, furniture = here, hard
    flush()
    return found


def _windows(texts: list[str], long: int) -> list[tuple[int, int, int]]:
    """`(digest, first, last)` of the shortest runs of `long` words that start, and that end, at each block."""
    words = [t.count(" ") + 1 for t in texts]
    marks = [xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
    spans, total, j = set(), 0, 0
    for i in range(len(texts)):
        while j < len(texts) and total < long:
            total += words[j]
            j += 1
        if total >= long:
            spans.add((i, j - 1))
        total -= words[i]
    total, i = 0, len(texts) - 1
    for j in range(len(texts) - 1, -1, -1):
        while i >= 0 and total < long:
            total += words[i]
            i -= 1
        if total >= long:
            spans.add((i + 1, j))
        total -= words[j]
    return [(xxhash.xxh64_intdigest(b"".join(marks[a : b + 1])) - (1 << 63), a, b) for a, b in sorted(spans)]


_PARSED = pa.struct([
    ("text", pa.string()), ("zone", pa.int32()), ("page", pa.int64()),
    ("blocks", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))),
    ("windows", pa.list_(pa.struct([("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))),
])
_PARSED_SQL = (
    "struct<text:string,zone:int,page:bigint,blocks:array<struct<at:int,text:string>>,windows:array<struct<mark:bigint,first:int,last:int>>>"
)


def parse_pages(pages: DataFrame, html_col: str = "html", long: int = LONG) -> DataFrame:
    """Replace the source of each page by `parsed`: its text where markup marks it, else its unmarked blocks; and its windows."""
    kept = [c for c in pages.columns if c != html_col]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.schema if f.name != html_col)}, parsed {_PARSED_SQL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source in batch.column(html_col):
                found = page_blocks(source.as_py() or "")
                best = max((z for z, _ in found), default=NEUTRAL)
                texts = [t for _, t in found]
                page = xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)
                marked = best > NEUTRAL
                out.append({
                    "text": "\n".join(t for z, t in found if z == best) if marked else None,
                    "zone": best, "page": page,
                    "blocks": [] if marked else [{"at": i, "text": t} for i, (z, t) in enumerate(found) if z == NEUTRAL],
                    "windows": [{"mark": w, "first": a, "last": b} for w, a, b in _windows(texts, long)],
                })
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, _PARSED)], names=[*kept, "parsed"])

    return pages.mapInArrow(run, schema)


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """`host, mark`: runs of at least `LONG` words that occur on distinct pages of a host.

    The pages of a host form one stream of blocks; its suffixes are compared by their first `LONG` words, which is all
    that decides whether a longer common run begins there. Suffixes that begin alike, neighbours in the sorted suffix
    array, meet by grouping on the host and the digest of that beginning; only the least and the greatest page digest of
    a group travel, so a host with a third of all pages is combined before the shuffle. Copies of a page are one page.
    """
    marks = parsed.select("host", "parsed.page", F.explode(F.array_distinct("parsed.windows.mark")).alias("mark"))
    pages = marks.groupBy("host", "mark").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    return pages.where("low < high").select("host", "mark")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars, zone`: the main text of every page, blocks joined by line feeds.

    Blocks inside page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) are left
    out. Where a page marks an article or a main part, its blocks are the text, repeated or not. Where it marks none,
    blocks covered by runs that repeat across pages of the host go and the unique runs stay. Null sources and pages
    without text give the empty text; null addresses are one host; repeated rows stay; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("_html"))
    parsed = settle(parse_pages(rows, "_html").withColumn("_row", F.monotonically_increasing_id()), "pages")
    unmarked = parsed.where("parsed.zone <= 0")
    windows = unmarked.select("_row", "host", F.explode("parsed.windows").alias("w")).select("_row", "host", "w.*")
    covered = windows.join(repeated_runs(parsed), ["host", "mark"], "left_semi")
    spans = covered.groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    unique = F.filter("parsed.blocks", lambda b: ~F.exists("spans", lambda s: b["at"].between(s["first"], s["last"])))
    left = F.when(F.col("spans").isNull(), F.col("parsed.blocks")).otherwise(unique)
    plain = unmarked.join(spans, "_row", "left").select("page_id", "url", F.array_join(F.transform(left, lambda b: b["text"]), "\n").alias("text"), "parsed.zone")
    marked = parsed.where("parsed.zone > 0").select("page_id", "url", "parsed.text", "parsed.zone")
    both = marked.unionByName(plain)
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "zone")
