"""HTML extraction: a page's markup says which blocks can be its article; a host's suffix array says which of the others
are boilerplate.

The blocks outside of article elements form a page's token streams. The streams of a host's pages are concatenated and
sorted by prefix doubling; suffixes that agree on RUN_TOKENS tokens are neighbours in the suffix array and form an
interval. Intervals that occur in MIN_PAGES distinct pages of a host are boilerplate, and the tokens that they cover are
removed from blocks that no article element vouches for; unique runs stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import WordHashes, Workspace, mix, signed

#: A repeated run has at least so many tokens; a power of two, as prefix doubling ranks these lengths.
RUN_TOKENS = 8
#: Distinct pages (of different content) of a host that must share a run before it counts as boilerplate.
MIN_PAGES = 3

# Element and attribute names of HTML, and the usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg math object canvas audio video select datalist button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture input".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adunit banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs footer "
    "sidebar sidenav aside widget widgets cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond replies pagination pager toolbar searchform skip copyright masthead topbar".split()
)
PAGE_HEADERS = frozenset("header".split())
CONTENT_NAMES = frozenset("content article post entry story maincontent articlebody".split())
TEASER_NAMES = CHROME_NAMES | frozenset("teaser reply".split())
IGNORED_FIRST = frozenset("has no with without is not js".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes the open elements of these names, up to one of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
CELLS = frozenset("td th caption table".split())

MARKUP = re.compile(r"<(?:!--(?:>|->|(?:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/[^A-Za-z>][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

REST, NAMED, MAIN, ARTICLE = range(4)


def _names(value: str) -> Iterator[list[str]]:
    for name in value.split():
        yield [p.lower() for p in NAME_PARTS.findall(name)]


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _zone(tag: str, text: str, level: int, in_article: bool) -> tuple[int, bool]:
    """The level of an element's text, given that of what it stands in, and whether it is no main text at all."""
    a = _attributes(text) if text.strip(" /") else {}
    role = a.get("role", "").lower()
    if tag in CHROME_TAGS or role in CHROME_ROLES or "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return level, True
    named = [p for k in ("class", "id") for p in _names(a.get(k, "")) if p and p[0] not in IGNORED_FIRST]
    if tag not in ("html", "body", "main"):
        known = TEASER_NAMES if tag == "article" else CHROME_NAMES if in_article else CHROME_NAMES | PAGE_HEADERS
        if any(x in known for p in named for x in p):
            return level, True
    if tag == "header" and not in_article:
        return level, True
    if tag == "article" or role == "article" or a.get("itemprop", "").lower() == "articlebody":
        return ARTICLE, False
    if tag == "main" or role == "main":
        return max(level, MAIN), False
    if tag not in INLINE and tag not in ("html", "body") and any(x in CONTENT_NAMES for p in named for x in p):
        return max(level, NAMED), False
    return level, False


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """(level, is chrome, text) of each block of text of a page, in order, of the whole page. Character references are
    decoded, white space is one space; comments, raw text elements and markup are no text."""
    out: list[tuple[int, bool, str]] = []
    parts: list[str] = []
    # tag, level, chrome, in an article's header, in an inline element that is no main text
    stack: list[tuple[str, int, bool, bool, bool]] = []
    open_tags: Counter[str] = Counter()
    level, chrome, heading_only, muted = REST, False, False, False
    at, end = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                held = heading_only and not any(open_tags[h] for h in HEADINGS)
                out.append((level, chrome or held, text))

    def pop() -> None:
        nonlocal level, chrome, heading_only, muted
        open_tags[stack.pop()[0]] -= 1
        level, chrome, heading_only, muted = stack[-1][1:] if stack else (REST, False, False, False)

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            parts.append(" " if muted else page[at:])
            break
        parts.append(" " if muted else page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif tag in INLINE:
                if open_tags[tag]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] not in INLINE:
                            break
            else:
                flush()
                if open_tags[tag]:
                    barrier = not (tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot", "body", "html"))
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            while len(stack) > i:
                                pop()
                            break
                        if barrier and stack[i][0] in CELLS:
                            break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not m[3].rstrip().endswith("/") or tag not in ("svg", "math") else None
            if close:
                at = close.end()
            elif tag in ("script", "style", "title", "textarea", "xmp", "template"):
                at = end
            if tag in ("title", "textarea", "iframe", "object", "audio", "video", "canvas"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            if open_tags["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in CELLS or stack[i][0] == "button":
                        break
            if tag in IMPLIED:
                closes, stops = IMPLIED[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in closes:
                        while len(stack) > i and stack:
                            pop()
                        if tag != "tr":
                            break
        new, is_chrome = _zone(tag, m[3], level, level == ARTICLE)
        heading_only = heading_only or (tag == "header" and level == ARTICLE)
        muted = tag in INLINE and (muted or (is_chrome and not chrome))
        level, chrome = new, chrome or (is_chrome and not muted)
        stack.append((tag, level, chrome, heading_only, muted))
        open_tags[tag] += 1
    flush()
    return out


def divided(found: list[tuple[int, bool, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The blocks that can be the main text, those of the highest level that has any, with their numbers; and the
    blocks that repetition speaks of: all outside of article elements."""
    best = max((level for level, chrome, _ in found if not chrome), default=REST)
    main = [(i, text) for i, (level, chrome, text) in enumerate(found) if not chrome and level == best]
    others = [(i, text) for i, (level, chrome, text) in enumerate(found) if chrome or level < ARTICLE]
    return main, others


def _parsed(pages: DataFrame) -> DataFrame:
    block = pa.list_(pa.struct([("no", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, main, others = [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                own, rest = divided(found)
                decided = not own or found[own[0][0]][0] == ARTICLE
                text.append("\n".join(t for _, t in own) if decided else None)
                main.append(None if decided else [{"no": i, "text": t} for i, t in own])
                others.append([{"no": i, "text": t} for i, t in rest])
            columns = [batch.column(c) for c in ("key", "host", "page_id", "url")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(main, block), pa.array(others, block)], ["key", "host", "page_id", "url", "text", "main", "others"])

    blocks_type = "array<struct<no: int, text: string>>"
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"key long, host long, page_id {kinds['page_id']}, url {kinds['url']}, text string, main {blocks_type}, others {blocks_type}")


def suffix_intervals(tokens: np.ndarray, run: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token sequence as far as `run` tokens decide it, by prefix doubling, and where its
    intervals of suffixes with equal first `run` tokens start. Suffixes shorter than that are interval members of their
    own."""
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < run:
        nxt = np.full(len(rank), -1, np.int64)
        nxt[:-width] = rank[width:]
        _, rank = np.unique(rank * (len(rank) + 1) + nxt + 1, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    return order, np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]) if len(order) else np.empty(0, np.int64)


def _intervals(parsed: DataFrame, run_tokens: int) -> DataFrame:
    """One row for each interval of the suffix array of a batch's streams: prefix, a hash of its host and first tokens;
    its places (key of the page, token number); and the distinct contents of the pages in it."""
    place = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            streams, page, at, contents = [], [], [], []
            rows = zip(batch.column("host").to_pylist(), batch.column("others").to_pylist(), strict=True)
            for i, (host, others) in enumerate(rows):
                words = [w for b in others for w in b["text"].encode().split(b" ")]
                breaks = np.flatnonzero(np.diff([b["no"] for b in others]) > 1) if len(others) > 1 else ()
                ends = np.cumsum([len(b["text"].split(" ")) for b in others])
                h = hashes.of(words)
                contents.append(xxhash.xxh64_intdigest(b" ".join(words)) if words else 0)
                # an article between two blocks, and the end of a page, are tokens that occur once
                cuts = [*(int(ends[b]) for b in breaks), len(words)]
                for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                    if b - a >= run_tokens:
                        streams.append(np.r_[mix(h[a:b] ^ np.uint64(host & 0xFFFFFFFFFFFFFFFF)), np.uint64(len(streams))])
                        page.append(np.full(b - a + 1, i))
                        at.append(np.r_[np.arange(a, b), -1])
            if not streams:
                continue
            tokens, page_no, where = np.concatenate(streams), np.concatenate(page), np.concatenate(at)
            left = np.concatenate([np.arange(len(s) - 1, -1, -1) for s in streams])
            order, starts = suffix_intervals(tokens, run_tokens)
            keep = np.add.reduceat((left[order] < run_tokens).astype(np.int64), starts) == 0
            keys = batch.column("key").to_numpy()
            content = np.array(contents, np.uint64).view(np.int64)
            bounds = np.r_[starts, len(order)]
            first = order[starts[keep]]
            prefix = tokens[first]
            for k in range(1, run_tokens):
                prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + tokens[first + k])
            member = np.repeat(keep, np.diff(bounds))
            sizes = np.diff(bounds)[keep]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            inside = order[member]
            places = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(keys[page_no[inside]]), pa.array(where[inside].astype(np.int32))], ["key", "at"]))
            seen = pa.ListArray.from_arrays(offsets, pa.array(content[page_no[inside]]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(prefix)), places.cast(place), seen], ["prefix", "places", "contents"])

    return parsed.select("key", "host", "others").where("size(others) > 0").mapInArrow(run, "prefix long, places array<struct<key: long, at: int>>, contents array<long>")


def _unique_runs(undecided: DataFrame, run_tokens: int) -> DataFrame:
    """The main blocks without the tokens that boilerplate covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for main, others, starts in zip(*(batch.column(c).to_pylist() for c in ("main", "others", "starts")), strict=True):
                covered: dict[int, np.ndarray] = {}
                sizes = [len(b["text"].split(" ")) for b in others]
                gone = np.zeros(sum(sizes) + run_tokens, bool)
                for s in starts or ():
                    gone[s : s + run_tokens] = True
                a = 0
                for b, n in zip(others, sizes, strict=True):
                    covered[b["no"]] = gone[a : a + n]
                    a += n
                lines = (" ".join(w for w, g in zip(b["text"].split(" "), covered[b["no"]].tolist(), strict=True) if not g) for b in main)
                out.append("\n".join(x for x in lines if x))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in undecided.schema}
    return undecided.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def main_text(pages: DataFrame, *, run_tokens: int = RUN_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Text is the page's main text: one line per block, white space in a block one space. Menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments go by their elements, roles, and class and id names. What is
    inside an article element stays, repeated or not: other articles may quote it. Where a page has no article element,
    the blocks of its main element, of elements named as content, or all blocks lose the tokens of runs of `run_tokens`
    that `min_pages` distinct pages of the host share (pages of equal text count once). Headings in an article's own
    header are part of it.

    Null html has no text and gives an empty one; a null url is a host of its own; a null page_id stays null; repeated
    rows come back as often as they came; an empty table gives no rows; other columns are ignored.
    """
    work = Workspace(pages.sparkSession, "pages")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), F.xxhash64(host).alias("host"), "page_id", "url", "html")
    parsed = work.save(_parsed(rows), "parsed")
    intervals = work.save(_intervals(parsed, run_tokens), "intervals")
    shared = intervals.select("prefix", F.explode("contents").alias("content")).distinct().groupBy("prefix").count().where(F.col("count") >= min_pages).select("prefix")
    undecided = parsed.where("main is not null")
    places = intervals.join(shared, "prefix").select(F.explode("places").alias("p")).select("p.key", "p.at")
    starts = places.join(undecided.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_list("at").alias("starts"))
    cleaned = _unique_runs(undecided.join(starts, "key", "left"), run_tokens)
    out = parsed.where("main is null").select("page_id", "url", "text").unionByName(cleaned)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
