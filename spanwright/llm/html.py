"""Main text of web pages: markup roles, and the word windows that recur on each host's page streams.

A page is parsed once into blocks of text. Blocks inside an article or main element are vouched for
by the page itself; blocks inside menus, headers, footers, sidebars, notices, adverts, forms and
comments are chrome; the rest is plain. In the word streams of chrome and plain blocks, every
substring of `least` words that recurs on `pages` distinct pages of the whole host is covered, and
covered words go. What is left of chrome goes too (a sure sign is not needed twice); a page that
vouches for no block keeps the unique runs of its plain blocks.

The suffix array of a host is held in parts: each block of pages sorts the suffixes of its own
concatenated streams to a depth of `least` words, neighbours that share that many form a group, and
groups of all blocks meet by (host, their words' hash), distinct pages added up. So a host of any size
spreads out, and the result is that of one array over the whole host, up to 64-bit hashes. `covered`
is that one array in memory; tests compare the two.

Defined results: null html is the empty page; pages without text give ''; a null url is a host of
its own; equal pages count once among distinct pages; repeated rows are extracted each; an empty
table gives no rows. References cut off by the end of the page stay as written.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import blocks, grams, released, span_hash, staged, utf8, words

CHROME, PLAIN, VOUCHED = 0, 1, 2

#: Names of the HTML standard, by what they mean for a page's text (fixed values).
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
SKIPPED = frozenset("head nav header footer aside form button select option datalist menu dialog".split())
HOLDERS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class and id names that mark what is not the article (fixed values).
MARKS = frozenset("ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager skip".split())
#: Words that only tell where or in what shape such a part stands (fixed values).
PLACES = frozenset("site page global main top bottom left right inner outer primary secondary bar box block area section list item items link links wrap wrapper container holder slot unit form".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")


def _chrome_name(name: str) -> bool:
    """A class or id that says nothing but a mark, with or without a place: ad, site-footer, cookie-banner."""
    words = set(_WORD.findall(name))
    return not MARKS.isdisjoint(words) and words <= MARKS | PLACES


def _marked(name: str, attrs: str) -> bool:
    """Whether the element's own attributes say that it is not part of the article."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    bare = _ATTR.sub(" ", attrs).lower().split()
    if "hidden" in bare:
        return True
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in ("html", "body", "main", "article"):
            if any(map(_chrome_name, value.split())):
                return True
        elif key == "role" and value.strip() in ROLES or key == "aria-hidden" and value.strip() == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def parse(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block with text, in page order."""
    page = page or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, is chrome, is a holder
    chrome = held = at = 0

    def close() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                out.append((block, CHROME if chrome else VOUCHED if held else PLAIN))
            text.clear()

    def pop(upto: int) -> None:
        nonlocal chrome, held
        for _, c, h in stack[upto:]:
            chrome -= c
            held -= h
        del stack[upto:]

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name in RAW and not ends:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at) if not attrs.rstrip().endswith("/") else None
            if end or not attrs.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif not ends and _marked(name, attrs):
                close()
                stack.append((name, True, False))
                chrome += 1
            elif ends and stack and stack[-1][0] == name:
                close()
                pop(len(stack) - 1)
            continue
        close()
        if name in VOID:
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        if name in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name or stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if name in ("body", "main") and chrome and not any(s[0] == "dialog" for s in stack):
            # The head, or chrome that was never closed, ends where the body or main begins.
            pop(next(i for i, s in enumerate(stack) if s[1]))
        is_chrome = name in SKIPPED or _marked(name, attrs)
        is_holder = name in HOLDERS or "main" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs) is not None
        stack.append((name, is_chrome, is_holder and not is_chrome))
        chrome += is_chrome
        held += is_holder and not is_chrome
    close()
    return out


def suffix_array(stream: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, for each suffix but the first, the words it shares with the one before.

    Prefix doubling: ranks by the first 1, 2, 4 ... words until all differ (a distinct end mark after
    each page bounds this by the longest repeat) or `depth` words are told apart; shared lengths, up
    to that depth at least, follow from the same ranks.
    """
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while n and rank.max() < n - 1 and step < min(n, depth or n):
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        pair = rank * (n + 1) + after + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, shared


def covered(streams: list[list[str]], least: int, pages: int) -> list[np.ndarray]:
    """For each page stream, which words lie in substrings of `least` words that `pages` distinct streams hold."""
    number: dict[str, int] = {}
    first: dict[tuple, int] = {}
    same = [first.setdefault(tuple(s), i) for i, s in enumerate(streams)]  # equal streams are one page
    use = [i for i, s in enumerate(streams) if same[i] == i and s]
    if not use:
        return [np.zeros(len(s), bool) for s in streams]
    parts, owner = [], []
    for i in use:
        parts += [number.setdefault(w, len(number)) for w in streams[i]] + [-1]
        owner += [i] * (len(streams[i]) + 1)
    stream, owner = np.array(parts), np.array(owner)
    stops = np.flatnonzero(stream < 0)
    stream[stops] = len(number) + np.arange(len(stops))
    order, shared = suffix_array(stream)
    group = np.concatenate([[0], np.cumsum(shared < least)])
    pairs = np.unique(group * len(streams) + owner[order])
    enough = np.bincount(pairs // len(streams), minlength=group[-1] + 1) >= pages
    starts = order[enough[group]]
    edge = np.zeros(len(stream) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + least, len(stream)), -1)
    mark = np.cumsum(edge)[:-1] > 0
    begin = {i: a for i, a in zip(use, np.concatenate([[0], stops[:-1] + 1]), strict=True)}
    return [mark[begin[same[i]] : begin[same[i]] + len(s)] if s else np.zeros(0, bool) for i, s in enumerate(streams)]


def kept_text(stream: str, kinds: bytes, mark: np.ndarray) -> str:
    """The words of a page's plain blocks that are not marked. stream: its blocks, a line each."""
    at, kept = 0, []
    for text, kind in zip(stream.split("\n"), kinds, strict=True):
        own = text.split(" ")
        gone = mark[at : at + len(own)]
        at += len(own)
        if kind == PLAIN:
            kept.append(" ".join(w for w, g in zip(own, gone, strict=True) if not g) if gone.any() else text)
    return "\n".join(k for k in kept if k)


def windows(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `least` words (across pages too; callers mask those), and n+1 word offsets by page."""
    data, off = utf8(column)
    start, end, by = words(data, off)
    return grams(span_hash(data, start, end), least) if len(start) else np.zeros(0, np.uint64), by


def marked_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages' words as numbers, one stream with a distinct end mark after each page; the page of
    each place; hashes of all words; and n+1 word offsets by page."""
    data, off = utf8(column)
    start, end, by = words(data, off)
    hashes = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    size = np.diff(by)
    number = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    page = np.repeat(np.arange(len(size)), size + 1)
    stop = np.cumsum(size + 1) - 1
    stream = np.empty(len(page), np.int64)
    word = np.ones(len(page), bool)
    word[stop] = False
    stream[word] = number
    stream[stop] = len(number) + np.arange(len(size))
    return stream, page, hashes, by


def repeats_within(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(page, key) of the groups of suffixes that share their first `least` words, each page once a
    group; key is those words' hash. Groups of one suffix count: other blocks may hold their fellows."""
    stream, page, hashes, by = marked_stream(column)
    order, shared = suffix_array(stream, least)
    group = np.concatenate([[0], np.cumsum(shared < least)]) if len(order) else np.zeros(0, np.int64)
    place = order - page[order]  # of the word, without the end marks before it
    inside = place + least <= by[page[order] + 1]
    order, group, place = order[inside], group[inside], place[inside]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, at = np.unique(group * (len(by) + 1) + page[order], return_index=True)
    return page[order[at]], span_hash_at(hashes, place[at], least)


def span_hash_at(hashes: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    return grams(hashes, least)[place]


def extract(pages_df: DataFrame, least: int = 8, pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Pages that vouch for a block, and empty ones, are finished where they are read. The word streams
    of all are staged; the suffix groups of the distinct ones are counted by host, and go back, once
    a block of pages, to the pages that vouch for nothing.
    """

    def finished(batches):
        for batch in blocks(batches, "html"):
            at, texts = [], []
            for i, page in enumerate(batch.column("html").to_pylist()):
                found = parse(page)
                own = [t for t, kind in found if kind == VOUCHED]
                if own or not found:
                    at.append(i)
                    texts.append("\n".join(own))
            done = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([done.column("page_id"), done.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def streams(batches):
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(blocks(batches, "html")):
            at, texts, kinds, vouched, hosts, same = [], [], [], [], [], []
            for i, (page, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                found = parse(page)
                rest = [(t, kind) for t, kind in found if kind != VOUCHED]
                if rest:
                    at.append(i)
                    texts.append("\n".join(t for t, _ in rest))
                    kinds.append(bytes(kind for _, kind in rest))
                    vouched.append(len(rest) < len(found))
                    hosts.append(int.from_bytes(hashlib.md5(host.encode()).digest()[:8], "big", signed=True))
                    same.append(hashlib.md5(f"{host}\n{' '.join(t for t, _ in rest)}".encode()).digest())
            left = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + number] * len(at), pa.int64()), pa.array(at, pa.int32()), left.column("page_id"), left.column("url"), pa.array(hosts, pa.int64()), pa.array(same, pa.binary()), pa.array(vouched, pa.bool_()), pa.array(texts, pa.string()), pa.array(kinds, pa.binary())],
                names=["blk", "i", "page_id", "url", "host", "same", "vouched", "stream", "kinds"],
            )

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(bitmap.passes(batch.column("host").to_numpy(zero_copy_only=False).view(np.uint64), shared.value)))

    def counted(batches):
        for batch in blocks(batches, "stream"):
            page, g = repeats_within(batch.column("stream"), least)
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(page)), pa.array(g.view(np.int64))], names=["host", "h"])

    def asked(batches):
        for batch in blocks(batches, "stream"):
            page, g = repeats_within(batch.column("stream"), least)
            rows = pa.table([batch.column("blk").take(pa.array(page)), batch.column("host").take(pa.array(page)), pa.array(g.view(np.int64))], names=["blk", "host", "h"])
            yield from rows.group_by(["blk", "host", "h"]).aggregate([]).select(["blk", "host", "h"]).to_batches()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[int]] = {}
        for host, h in zip(right.column("host").to_pylist(), right.column("h").to_pylist(), strict=True):
            found.setdefault(host, []).append(h)
        repeats = {host: np.array(h, np.int64).view(np.uint64) for host, h in found.items()}
        column = left.column("stream").combine_chunks()
        g, by = windows(column, least)
        texts = []
        for i, (host, stream, kinds) in enumerate(zip(left.column("host").to_pylist(), column.to_pylist(), left.column("kinds").to_pylist(), strict=True)):
            n = int(by[i + 1] - by[i])
            edge = np.zeros(n + 1, np.int64)
            if host in repeats and n >= least:
                at = np.flatnonzero(np.isin(g[by[i] : by[i + 1] - least + 1], repeats[host]))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + least, -1)
            texts.append(kept_text(stream, kinds, np.cumsum(edge)[:-1] > 0))
        return pa.table([left.column("page_id"), left.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    rows = pages_df.select(F.col("page_id").cast("long"), "url", "html").withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    parsed = staged(rows.mapInArrow(released(streams), "blk long, i int, page_id long, url string, host long, same binary, vouched boolean, stream string, kinds binary"), "streams")
    # Only hosts with a page that vouches for nothing need counts; the bitmap lets few others pass.
    left = parsed.filter("NOT vouched")
    shared = pages_df.sparkSession.sparkContext.broadcast(bitmap.build(left.select("host").distinct(), "host"))
    evidence = parsed.select("blk", "i", "host", "same", "stream").mapInArrow(released(wanted), "blk long, i int, host long, same binary, stream string")
    once = evidence.groupBy("same").agg(F.min(F.struct("blk", "i")).alias("r")).select("r.blk", "r.i")
    repeated = evidence.join(once, ["blk", "i"]).select("host", "stream").mapInArrow(released(counted), "host long, h long").groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= pages)
    hits = left.select("blk", "host", "stream").mapInArrow(released(asked), "blk long, host long, h long").join(repeated, ["host", "h"]).select("blk", "host", "h")
    compared = left.select("blk", "page_id", "url", "host", "stream", "kinds").groupBy("blk").cogroup(hits.groupBy("blk")).applyInArrow(finish, schema)
    return rows.select("page_id", "url", "html").mapInArrow(released(finished), schema).unionByName(compared)
