"""Main text of web pages: markup, plus the token strings that the pages of a host share.

A page is cut into blocks at block-level tags, once for evidence and once for its text.  Markup tells three kinds: blocks
inside <article> or <main>; blocks of a frame (navigation, footers, forms, or a class, id or role that says advert,
comment, sidebar and so on); plain ones.  Where a page marks its article, that is its text, whole: nothing is removed from
it but frames inside it, such as reader comments.  Elsewhere the text is the plain blocks without boilerplate.

Boilerplate is every token inside a string of ``LEAD`` or more tokens that stands outside the articles of ``MIN_PAGES`` or
more distinct pages of a host.  A page's token stream runs across all its blocks outside the article, frames included: a
notice that one page marks as a frame is known on those that do not mark it.

The articles are searched as well: every page also has a stream of all its blocks, in page order, and the strings of these
streams are counted apart, under a host key of their own.  What they share is reported (``n_repeated``), not removed: a
sentence that several articles of a host share is still their text, and no evidence against a block elsewhere.

A string of ``LEAD`` or more tokens stands on ``MIN_PAGES`` pages only if each of its runs of ``LEAD`` tokens does, and
such a run is such a string itself.  So sorted arrays of the suffixes' leading ``LEAD`` tokens give just the tokens that
the longest shared strings of a full suffix array would cover.  Positions are not sorted along: all pages of a hot host
share their frame, and its positions would be one group without bound.  The leading tokens are counted in two passes:

1. ``seeds``: each run's smallest-hashed run of ``GRAM`` tokens, chosen by content wherever a block begins, is counted
   by host; about one token in three is one.
2. ``repeated``: only runs whose seed is frequent enough are counted themselves.

Pages whose whole blocks are equal are copies of one page: they count once.

Both counts are aggregated map-side by (host, tokens), so a hot host is spread over all tasks.  Frequent keys are
stored as sorted hash arrays in the shared folder and memory-mapped by the next pass.

Defined cases: null html = empty text; null url = a host of its own; unclosed tags end with the page; an unfinished tag
at the end is dropped; repeated rows are copies; an empty table gives no rows.  Extra columns, whatever their names, are
not read.  Very long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import arrays
from storelens.llm.common import (ROLL2, Texts, covered, i64, mix, runs, small_batches, stored, text_chunks, word_hashes,
                                  words)
from storelens.session import fresh_dir

LEAD, GRAM = 8, 4
MIN_PAGES = 4
EVEN = ~np.uint64(1)
WHOLE = np.uint64(0x9E3779B97F4A7C15)  # tells a host's streams of all blocks from those outside the articles

# fixed values: element names and name parts with a meaning
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")
SILENT = {"script", "style", "noscript", "template", "head", "iframe", "svg", "select", "textarea", "object", "title",
          "canvas", "xmp"}
FRAMES = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "meter", "output", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
         "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "signup", "popup",
         "modal", "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social",
         "related", "recommended", "widget", "pagination", "login", "masthead", "toolbar", "disclaimer", "alert"}
# what may follow a name in a compound: "ad-box", "comment-list", "sidebar-2"
PLACES = {"area", "bar", "block", "body", "box", "container", "content", "form", "inner", "item", "left", "links", "list",
          "panel", "right", "section", "slot", "text", "top", "bottom", "unit", "wrap", "wrapper", "zone"}
# a class that only tells what a block has, or has not, around it
ABOUT = {"has", "have", "is", "no", "non", "not", "with", "without", "hide", "show", "toggle", "js", "layout"}
# heads of a page, not of an article
HEADERS = {"header", "siteheader", "pageheader", "topbar"}
HEADER_OF = {"site", "page", "main", "global", "top", "app", "blog", "web"}
COMMENTS = {"comment", "comments", "reply", "replies", "commentlist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog",
         "alertdialog", "toolbar"}
MAIN, PLAIN, FRAME = 2, 1, 0

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
                 r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|</?[A-Za-z][^>]*\Z", re.S | re.I)
CUE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PART = re.compile(r"[^a-z0-9]+")


def says(cue: str, names: set[str]) -> bool:
    """Whether one class or id is one of the names, ends in one, or is one followed by a place."""
    parts = [p for p in PART.split(cue) if p]
    if not parts or parts[0] in ABOUT:
        return False
    if parts[-1] in names and not ABOUT & set(parts):
        return True
    return parts[0] in names and all(p in PLACES or p.isdigit() for p in parts[1:])


def is_header(cue: str) -> bool:
    parts = [p for p in PART.split(cue) if p]
    return "".join(parts) in HEADERS or (len(parts) > 1 and parts[-1] == "header" and parts[0] in HEADER_OF)


def cue_of(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element's cues say that it is a frame; ``inside``: in an article or main element."""
    if not attrs or name in ("body", "html", "main"):
        return False
    for kind, *value in CUE.findall(attrs):
        cues = "".join(value).lower().split()
        if kind.lower() == "role":
            if any(c in ROLES for c in cues):
                return True
        elif name == "article":  # an article is a frame only as a reader's comment within another
            if inside and any(says(c, COMMENTS) for c in cues):
                return True
        elif any(says(c, NAMES) or (not inside and is_header(c)) for c in cues):
            return True
    return name != "article" and bool(HIDDEN.search(attrs))


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page."""
    out: list[tuple[int, int, str]] = []  # kind, frame by cue that holds it (0: none), text
    text: list[str] = []
    # open elements: name, silent, frame by its name, frame by cue (number), in main content
    stack: list[tuple[str, bool, bool, int, bool]] = []
    top = ("", False, False, 0, False)
    at = frames = 0

    def end_block() -> None:
        if text:
            got = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if got:
                out.append((FRAME if top[2] or top[3] else MAIN if top[4] else PLAIN, 0 if top[2] else top[3], got))

    for m in TAG.finditer(page):
        if not top[1] and m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        closing, name, attrs = m.group(2), m.group(3), m.group(4)
        if name is None:
            if m.group(1) is not None:
                end_block()
            continue
        name = name.lower()
        if name == "br":
            if not top[1]:
                text.append(" ")
            continue
        inline = name in INLINE  # ends no block, and matters only where its cues say that it is a frame
        if inline:
            if not any(s[0] == name for s in stack) and (closing or not cue_of(name, attrs, top[4])):
                continue
        else:
            end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # a paragraph or item that was never closed
            up = stack[-1] if stack else ("", False, False, 0, False)
            cue = up[3]
            if inline:
                stack.append((name, True, *up[2:]))
                top = stack[-1]
                continue
            if not cue and cue_of(name, attrs, up[4]):
                frames += 1
                cue = frames
            stack.append((name, up[1] or name in SILENT, up[2] or (name in FRAMES and not (name == "header" and up[4])),
                          cue, up[4] or name in ("article", "main")))
        top = stack[-1] if stack else ("", False, False, 0, False)
    if not top[1] and at < len(page):
        text.append(page[at:])
    end_block()
    if not any(kind == MAIN for kind, _, _ in out):
        # a cue on the block that holds most of the page names the page, not a frame
        size: dict[int, int] = {}
        for _, cue, got in out:
            size[cue] = size.get(cue, 0) + len(got)
        most = max(size, key=size.__getitem__, default=0)
        if most and 2 * size[most] > sum(size.values()):
            out = [(PLAIN if cue == most else kind, cue, got) for kind, cue, got in out]
    return [(kind, got) for kind, _, got in out]


HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_hash(url: str | None) -> int:
    m = HOST.match(url or "")
    return xxhash.xxh64_intdigest((m.group(1) if m else url or "").lower(), 7)


class Windows:
    """The runs of ``LEAD`` tokens of a chunk of streams, at every token: ``doc`` and first token ``at`` of each, its
    ``key`` (host and all tokens) and ``low``, the key of its smallest-hashed run of ``GRAM`` tokens."""

    def __init__(self, t: Texts, hosts: np.ndarray):
        starts, ends, first = words(t)
        self.n, self.first = len(starts), first
        prefix = ROLL2.prefix(word_hashes(t, starts, ends))
        of = np.repeat(np.arange(len(t)), np.diff(first))
        self.at = np.flatnonzero(np.arange(self.n) + LEAD <= first[of + 1])
        self.doc = of[self.at]
        host = hosts[self.doc]
        gram = np.arange(max(0, self.n - GRAM + 1))
        gram = ROLL2.ranges(prefix, gram, gram + GRAM)
        low = gram[self.at]
        for k in range(1, LEAD - GRAM + 1):
            low = np.minimum(low, gram[self.at + k])
        self.low = mix(low ^ host) & EVEN
        self.key = mix(ROLL2.ranges(prefix, self.at, self.at + LEAD) ^ host)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[list[tuple[int, str]]], np.ndarray, np.ndarray, Windows]]:
    """(blocks, host, stream, windows) of runs of the streams of a batch of (url, html).  A page has two, one after the
    other: its blocks outside the article, and all its blocks; ``stream`` is the odd key of its host and all its blocks."""
    found = [blocks(p) for p in batch.column(1).to_pylist()]
    hosts = np.repeat(np.array([host_hash(u) for u in batch.column(0).to_pylist()], np.uint64), 2)
    hosts[1::2] ^= WHOLE
    page = np.array([xxhash.xxh64_intdigest(" ".join(x for _, x in f)) for f in found], np.uint64)
    stream = mix(np.repeat(page, 2) ^ hosts) | ~EVEN
    streams = ["\n".join(x for kind, x in f if every or kind != MAIN) for f in found for every in (False, True)]
    found = [f for f in found for _ in range(2)]
    for t in text_chunks(pa.array(streams, pa.large_string())):
        yield found[t.rows], hosts[t.rows], stream[t.rows], Windows(t, hosts[t.rows])


def once_a_page(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices of the first of each (page, key)."""
    order = np.lexsort((key, doc))
    return order[runs(doc[order], key[order])[:-1]]


def saved_keys(keys: DataFrame, kind: str) -> list[tuple[int, str]]:
    """Stores ``keys`` as sorted arrays of disjoint ranges; (least key, address) of each."""
    spark = keys.sparkSession
    folder = fresh_dir(spark, kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if got:
            key = np.sort(np.concatenate(got))
            address = arrays.save(folder, {"key": key})
            yield pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array([address])], names=["least", "address"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    parts = stored(keys, kind + "-keys").repartitionByRange(n, "key").mapInArrow(write, "least long, address string")
    return sorted((r.least, r.address) for r in parts.collect())


def known(files: list[tuple[int, str]], key: np.ndarray) -> np.ndarray:
    """Whether each key is in the stored arrays."""
    hit = np.zeros(len(key), bool)
    if not files or not len(key):
        return hit
    key = i64(key)
    order = np.argsort(key)
    key = key[order]
    cut = np.searchsorted(key, np.array([f[0] for f in files], np.int64)).tolist() + [len(key)]
    for (_, address), a, b in zip(files, cut, cut[1:]):
        if a < b:
            hit[order[a:b]] = arrays.find(arrays.load(address)["key"], key[a:b]) >= 0
    return hit


def seeds(pages: DataFrame) -> list[tuple[int, str]]:
    """Keys of the smallest runs on ``MIN_PAGES`` or more pages of a host (even), and of streams that two or more pages
    have (odd)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, stream, w in chunks(b):
                one = once_a_page(w.doc, w.low)
                yield pa.RecordBatch.from_arrays([pa.array(i64(np.concatenate([w.low[one], stream])))], names=["key"])

    counts = pages.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("pages"))
    return saved_keys(counts.where(F.expr(f"pages >= if(key & 1 = 1, 2, {MIN_PAGES})")).select("key"), "seeds")


def repeated(pages: DataFrame) -> list[tuple[int, str]]:
    """Keys of the windows that stand on ``MIN_PAGES`` or more distinct pages of a host; equal streams are one page."""
    files = seeds(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, stream, w in chunks(b):
                some = np.flatnonzero(known(files, w.low))
                doc, key = w.doc[some], w.key[some]
                one = once_a_page(doc, key)
                copied = known(files, stream)[doc[one]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i64(key[one])), pa.array(i64(stream)[doc[one]], mask=~copied)], names=["key", "stream"])

    # a page of its own counts as it is, the copies of a stream count once
    by = pages.mapInArrow(run, "key long, stream long").groupBy("key", "stream").agg(F.count("*").alias("n"))
    counts = by.groupBy("key").agg(F.sum(F.when(F.col("stream").isNull(), F.col("n")).otherwise(1)).alias("pages"))
    return saved_keys(counts.where(F.col("pages") >= MIN_PAGES).select("key"), "boilerplate")


def kept_text(found: list[tuple[int, str]], gone: np.ndarray) -> str:
    """The text of a page: its article whole, or its plain blocks without the marked tokens (those of the blocks outside
    the article, in order)."""
    if any(kind == MAIN for kind, _ in found):
        return "\n".join(x for kind, x in found if kind == MAIN)
    out, at, gone = [], 0, gone.tolist()
    for kind, block in found:
        tokens = block.split(" ")
        left = [x for x, g in zip(tokens, gone[at:at + len(tokens)]) if not g]
        at += len(tokens)
        if left and kind == PLAIN:
            out.append(" ".join(left))
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_boilerplate (tokens outside the article that are
    repeated on the host outside the articles), n_repeated (tokens of all blocks that are repeated on the host)."""
    small_batches(pages.sparkSession)
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), page.alias("html"))
    files = repeated(source.select("url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, gone, again = [], [], []
            for found, _, _, w in chunks(b.select(["url", "html"])):
                at = w.at[known(files, w.key)]
                mask = covered(w.n, at, at + LEAD)
                for f, x, y in zip(found, w.first.tolist(), w.first[1:].tolist()):
                    if len(gone) > len(again):
                        again.append(int(mask[x:y].sum()))
                        continue
                    text.append(kept_text(f, mask[x:y]))
                    gone.append(int(mask[x:y].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(again, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_boilerplate", "n_repeated"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_boilerplate long, n_repeated long")
