"""Main text of HTML pages: markup, and a suffix array of each host.

A page is read into blocks.  What stands in an article (or main) element is the article; what stands in
menus, headers, footers, sidebars, forms, adverts, notices and comments is marked by element or class;
the rest is free.  A page's own blocks are its article's, or the free ones where it has none.

A host's pages are then compared by their token streams, all blocks in a row.  The streams of its
distinct contents are concatenated, their suffixes sorted, and neighbours that share a long prefix give
the repeated substrings: LONG tokens inside a block, or whole blocks of SHORT tokens at least.  A
substring is boilerplate if it stands in a SHARE of the contents, and LEAST at least.  The tokens that
boilerplate covers are cut from a page's own blocks, in an article too, and the unique runs are kept.
An article that it covers by more than half is a copy of others, not boilerplate, and is kept whole.

A host of more than GROUP bytes is dealt over several arrays by a hash of the contents, so an array is
bounded.  What stands on a share of all contents stands on that share of at least one array's, so the
arrays give all candidates; the contents that hold each candidate are then counted over the host, and
the rule is the same as for one array.  Pages of the same text are one content and meet in one array, so
a page's copies don't make it boilerplate; a task drops the copies it has met before they are shuffled.
Pages are read twice, once for the arrays and once to be cut (a third time where a host of several arrays has
candidates), which is cheaper than to write down what was read.

Defined cases: null or empty html gives empty text; a page cut off in the middle gives what stands
before the cut; repeated rows give their rows each; a url without a host shares the host "" with its
like; mirrored pages keep their text; very long pages are read whole; character references are decoded
as browsers do, unknown ones stay; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tokens of the shortest repeated substring inside a block that is boilerplate.
LONG = 20
#: Tokens of the shortest repeated row of whole blocks that is; blocks of LONG tokens are no part of such a row.
SHORT = 5
#: Tokens by which suffixes are compared: a row of blocks has SHORT + LONG at most, and its edges.
DEPTH = 32
#: Bytes of pages of one suffix array, about, and pages that it has at least.
GROUP, LEAST_PAGES = 4 << 20, 30
#: Boilerplate substrings, and hosts of several arrays, up to which they are broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 100_000
#: Part of a host's distinct contents in which either must stand, and how many they must be.
SHARE, LEAST = 1 / 3, 3

_RAW = "script|style|noscript|template|svg|iframe|object|select|textarea|math|head|title"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b)|(?=<article\b)|\Z)", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_MARKED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_MAIN = {"article", "main"}
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup"
    r"|sidebar|sidenav|side|rail|widget|menu|menubar|nav|navbar|navigation|breadcrumb|breadcrumbs|toc|footer|foot|masthead|topbar|header|comment|comments|reply|replies|discussion|disqus|respond|share|sharing|social"
    r"|related|recommended|recirc|login|search|pagination|pager|complementary|contentinfo|skip)(?:$|[\s_-]|\d)",
    re.I,
)
_COMMENTS = re.compile(r"comment|repl(?:y|ies)|discussion|disqus|respond", re.I)


def blocks(page: str | None) -> tuple[list[str], list[str], list[str]]:
    """(article, free, marked) blocks in page order, with references decoded and white space joined."""
    out: dict[str, list[str]] = {"article": [], "free": [], "marked": []}
    text = _HEAD.sub(" ", page or "", count=1)
    stack: list[tuple[str, str]] = []  # element and its zone: "", article, marked or comments
    parts: list[str] = []
    zone, owner, at = "free", "free", 0

    def flush() -> None:
        if parts:
            got = " ".join(html.unescape("".join(parts)).split())
            if got:
                out[owner].append(got)
            parts.clear()

    def current() -> str:
        for _, z in reversed(stack):
            if z:
                return "marked" if z == "comments" else z
        return "free"

    for m in _TAG.finditer(text):
        if m.start() > at:
            if not parts:
                owner = zone
            parts.append(text[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if m[1] or not name:
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if m[2]:
            if any(n == name for n, _ in stack):
                if name not in _INLINE:
                    flush()
                while stack:
                    n, _ = stack.pop()
                    if n not in _INLINE:
                        flush()
                    if n == name:
                        break
                zone = current()
            continue
        attrs = m[4] or ""
        names = " ".join(v.strip("\"'") for v in _CLASS.findall(attrs)) if attrs else ""
        hidden = bool(attrs) and bool(_HIDDEN.search(attrs))
        if name not in _INLINE:
            flush()
            if any(n == "p" for n, _ in stack):  # a block ends an open paragraph
                while stack and stack.pop()[0] != "p":
                    pass
                zone = current()
        if name in _MAIN and not any(z == "comments" for _, z in stack) and not _COMMENTS.search(names):
            while any(z == "marked" for _, z in stack):  # a menu or advert that was never closed
                stack.pop()
            kind = "article"
        elif name in _MARKED or hidden or (name == "header" and zone != "article"):
            kind = "marked"
        elif names and name not in ("body", "html", *_INLINE) and _WORDS.search(names):
            kind = "comments" if _COMMENTS.search(names) else "marked"
        else:
            kind = ""
        if name in _VOID or attrs.endswith("/"):
            if name in ("hr",):
                flush()
            continue
        if kind:
            flush()
        stack.append((name, kind))
        zone = current()
    if at < len(text):
        if not parts:
            owner = zone
        parts.append(text[at:])
    flush()
    return out["article"], out["free"], out["marked"]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_rows(sizes: list[int], long: int = LONG, short: int = SHORT) -> set[tuple[int, int]]:
    """(first, end) of rows of whole blocks, each of fewer than ``long`` tokens: as few from a block on, or up to one, as have ``short`` tokens."""
    found = set()
    for step in (1, -1):
        for first in range(len(sizes)):
            at, n = first, 0
            while 0 <= at < len(sizes) and sizes[at] < long and n < short:
                n += sizes[at]
                at += step
            if n >= short:
                found.add((first, at) if step > 0 else (at + 1, first + 1))
    return found


def suffixes(ids: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): places of ``ids`` sorted by what follows them, and how much of it each shares with the one before, exact up to ``depth``."""
    n, levels, step = len(ids), [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while step < depth:  # ranks of runs that double in length
        rank, after = levels[-1], np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        levels.append(np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, lcp = order[1:], order[:-1], np.zeros(n, np.int64)
    for rank in reversed(levels):
        off = lcp[1:]
        inside = np.flatnonzero(np.maximum(a, b) + off < n)
        off[inside] += step * (rank[a[inside] + off[inside]] == rank[b[inside] + off[inside]])
        step //= 2
    return order, lcp


def repeats(pages: list[list[str]], share: float = SHARE, least: int = LEAST) -> set[str]:
    """Boilerplate substrings of pages of different contents, each a list of blocks: tokens joined by a blank, or whole blocks with a line end before and after each."""
    need = max(least, share * len(pages))
    if len(pages) < need:
        return set()
    words: dict[str, int] = {}
    streams, owner, starts, rows = [], [], [], []  # an edge (0) stands before each block and at the end, then a number that no other page has
    at = 0
    for number, page in enumerate(pages):
        tokens = [block.split() for block in page]
        edges = [at]
        for block in tokens:
            edges.append(edges[-1] + 1 + len(block))
            starts.append(np.arange(edges[-2] + 1, edges[-1] - LONG + 1))
            streams += [0, *(words.setdefault(t, len(words) + 1) for t in block)]
        streams += [0, -1 - number]
        rows += [(edges[i], edges[j] - edges[i] + 1) for i, j in block_rows([len(b) for b in tokens])]
        owner.append(np.full(edges[-1] + 2 - at, number))
        at = edges[-1] + 2
    ids, page_of = np.array(streams, np.int64), np.concatenate(owner)
    order, lcp = suffixes(ids)
    names = np.array(["\n", *words], object)

    def common(places: np.ndarray, length: int) -> set[str]:
        """Substrings of this length at the places that enough pages have."""
        if not len(places):
            return set()
        kind = np.empty(len(ids), np.int64)
        kind[order] = np.cumsum(lcp < length)  # neighbours that share so much are of one kind
        pair = np.unique(kind[places] * len(pages) + page_of[places])
        which, count = np.unique(pair // len(pages), return_counts=True)
        _, first = np.unique(kind[places], return_index=True)
        return {" ".join(names[ids[p : p + length]]).replace(" \n", "\n").replace("\n ", "\n") for p in places[first[count >= need]].tolist()}

    found = common(np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64), LONG)
    begin, length = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    for n in np.unique(length).tolist():
        found |= common(begin[length == n], n)
    return found


def uncovered(page: list[str], known: set[str]) -> tuple[list[str], float]:
    """The blocks without the tokens that known substrings cover, and the share of tokens that was cut."""
    tokens = [block.split() for block in page]
    keep = [[True] * len(block) for block in tokens]
    for block, on in zip(tokens, keep, strict=True):
        for at in range(len(block) - LONG + 1):
            if " ".join(block[at : at + LONG]) in known:
                on[at : at + LONG] = [False] * LONG
    for first, end in block_rows([len(b) for b in tokens]):
        if "\n" + "\n".join(" ".join(b) for b in tokens[first:end]) + "\n" in known:
            for on in keep[first:end]:
                on[:] = [False] * len(on)
    cut, every = sum(not x for on in keep for x in on), sum(map(len, tokens))
    left = (" ".join(t for t, x in zip(block, on, strict=True) if x) for block, on in zip(tokens, keep, strict=True))
    return [block for block in left if block], cut / max(1, every)


def host(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def contents(pages: DataFrame) -> DataFrame:
    """(host, content, blocks): the blocks of distinct contents, own ones first; a task gives each content of a host once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, out = batch.slice(begin, 256), []
                for own_host, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    article, free, marked = blocks(raw)
                    key = own_host, _key("\n".join(article or free))
                    if key not in met:
                        met.add(key)
                        out.append((*key, [*article, *free, *marked]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], ["host", "content", "blocks"])

    return pages.select(host().alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, content long, blocks array<string>")


def contained(page: list[str], known: set[str]) -> set[str]:
    """The known substrings that stand in a page's blocks."""
    tokens = [block.split() for block in page]
    found = {" ".join(block[at : at + LONG]) for block in tokens for at in range(len(block) - LONG + 1)}
    found |= {"\n" + "\n".join(" ".join(b) for b in tokens[first:end]) + "\n" for first, end in block_rows([len(b) for b in tokens])}
    return found & known


def _with_runs(pages: DataFrame, known: DataFrame) -> tuple[DataFrame, Callable[[str, list[str] | None], set[str]]]:
    """``pages`` (with a column host) with ``runs``, and how a task finds a page's host's runs in them.

    A short list is broadcast as it is, and each task makes a host's set once; else runs are joined by host.
    """
    if known.count() <= BROADCAST_ROWS:
        lists: dict[str, set[str]] = {}
        for r in known.select("host", "run").collect():  # BROADCAST_ROWS rows at most
            lists.setdefault(r["host"], set()).add(r["run"])
        held = pages.sparkSession.sparkContext.broadcast(lists)
        return pages.withColumn("runs", F.lit(None).cast("array<string>")), lambda own, runs: held.value.get(own, set())
    # A host's list is bounded by its pages: each run stands in a third of them.
    each = known.groupBy("host").agg(F.collect_list("run").alias("runs"))
    return pages.join(each, "host", "left"), lambda own, runs: set(runs or [])


def boilerplate(pages: DataFrame, group: int | None = None, least_pages: int | None = None) -> DataFrame:
    """(host, run): substrings that stand in a SHARE of the host's distinct contents, and LEAST of them at least."""
    sizes = pages.groupBy(host().alias("host")).agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("pages"))
    group, least_pages = group or GROUP, least_pages or LEAST_PAGES
    arrays = F.least(F.ceil(F.col("bytes") / group), F.greatest(F.floor(F.col("pages") / least_pages), F.lit(1))).cast("long")
    large = written(sizes.filter(F.col("bytes") > group).select("host", arrays.alias("arrays")).filter("arrays > 1"), "hosts")
    read = contents(pages).join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "host", "left")
    dealt = read.withColumn("part", F.pmod("content", F.coalesce("arrays", F.lit(1)))).repartition("host", "part")
    dealt = dealt.withColumn("several", F.coalesce("arrays", F.lit(1)) > 1).sortWithinPartitions("host", "part", "content").select("host", "part", "content", "blocks", "several")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for (own_host, _), part in groupby(rows, key=lambda r: r[:2]):
            own, several = {}, False
            for r in part:
                own[r[2]], several = r[3], r[4]
            held = list(own.values())
            found = [None, *(repeats(held, least=1) if several else repeats(held))]
            n = [len(own), *[0] * (len(found) - 1)]  # the first row has the array's contents
            yield pa.RecordBatch.from_arrays([pa.array([own_host] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array([several] * len(found))], ["host", "run", "n", "several"])

    got = written(dealt.mapInArrow(run, "host string, run string, n long, several boolean"), "runs")
    sure = got.filter("run is not null and not several").select("host", "run")
    if large.isEmpty():
        return sure
    maybe = written(got.filter("run is not null and several").select("host", "run").distinct(), "candidates")
    if maybe.isEmpty():
        return sure
    total = got.filter("several").groupBy("host").agg(F.sum("n").alias("total"))
    near = written(maybe.select(F.col("host").alias("near_")).distinct(), "near")
    met, runs_of = _with_runs(contents(pages.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, host() == F.col("near_"), "left_semi")), maybe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, content, page, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = sorted(contained(page, runs_of(own, runs)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.string()), pa.array([content] * len(found), pa.int64()), pa.array(found, pa.string())], ["host", "content", "run"])

    held = met.select("host", "content", "blocks", "runs").mapInArrow(count, "host string, content long, run string").distinct()
    counted = held.groupBy("host", "run").agg(F.count("*").alias("n")).join(total, "host")
    return sure.unionByName(counted.filter((F.col("n") >= LEAST) & (F.col("n") >= F.col("total") * SHARE)).select("host", "run"))


def main_text(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row, cut by the boilerplate ``known`` (host, run) of its host."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    rows, runs_of = _with_runs(rows, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, texts = batch.slice(begin, 256), []
                for raw, own_host, runs in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    article, free, _ = blocks(raw)
                    kept, own = article or free, runs_of(own_host, runs)
                    if own:
                        left, cut = uncovered(kept, own)
                        kept = kept if article and cut > 0.5 else left
                    texts.append("\n".join(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "host", "runs").mapInArrow(run, "page_id long, url string, text string")


def op9(pages: DataFrame) -> DataFrame:
    out = main_text(pages, written(boilerplate(pages), "boilerplate"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
