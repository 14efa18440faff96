"""Main text of web pages, with boilerplate found by repeats within a host.

1. A page is cut into blocks in page order. Menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles and reader comments are named by their elements, classes or ids and leave at once.
   Blocks of a declared article (``article``, ``main``) are text of the page and stay whole. All other
   blocks are open.
2. Open blocks are judged per host, over all its pages. Passages are every ``LONG`` tokens of a page's open
   stream, and the shortest runs of whole blocks with ``LONG_BLOCKS`` tokens that start or end at a block. They are
   hashed (128 bits), distinct pages are counted per host and hash, and hashes found on ``PAGES`` pages and on
   one page in ``ONE_IN`` go back to the streams that hold them. Tokens they cover are boilerplate; the
   uncovered runs of a block stay. So shorter phrases that pages share inside their sentences stay too.
   No task holds a host: a stream is cut by itself, whatever its host's size. Pages are distinct if any of their
   blocks differ; those with equal open streams are cut once, but each of them counts.

Results on edge cases: a null or empty page, or one without text, gives an empty text; a page without a
host is judged among those without; equal rows all get the result; null ``page_id`` stays null; an
empty table gives an empty result; other columns are ignored. Broken markup (elements left open, cut-off
tags) is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.scale import stage

#: Tokens of a repeat that may be cut out of a block, and of a repeat that is whole blocks.
LONG = 20
LONG_BLOCKS = 5
#: A repeat is on so many pages of its host at least, and on one in ``ONE_IN`` of those with open blocks.
PAGES = 3
ONE_IN = 1000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    # A tag with a quote that never ends stops at its first bracket.
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template")}
#: Elements whose text is never the page's own.
_OUTSIDE = frozenset(
    "nav footer aside form head iframe svg button select dialog object menu fieldset".split()
)
#: Words of classes, ids and roles that mark such a part.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments reply replies disqus share sharing social related recommended newsletter subscribe "
    "subscription login signup search pagination pager toolbar widget".split()
)
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr br img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second, up to a container.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"},
           "dd": {"dt", "dd"}, "option": {"option"}}


#: Marks that hold for an article of their own too.
_COMMENTS = frozenset("comment comments reply replies disqus".split())
_BY_MARK, _BY_NAME = 1, 2


def _outside(tag: str, attributes: str, in_article: bool, marks: frozenset = _MARKS) -> int:
    """Whether an element is outside the main text, and by what: its marks (or being a form), or its name."""
    if tag == "form":
        return _BY_MARK
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return _BY_NAME
    if not attributes or "=" not in attributes:
        return 0
    for found in _NAMES.findall(attributes):
        words = re.split(r"[^a-z]+", html.unescape("".join(found)).lower())
        if not marks.isdisjoint(words):
            return _BY_MARK if tag not in ("body", "html") else 0
    return 0


def page_blocks(page: str) -> list[tuple[str, bool]]:
    """Blocks in page order: text with single spaces, and whether it is open.

    Marks say little about a wrapper of the whole article. Where every article of a page lies in marked parts or forms, or is
    marked itself, the page is read again with its articles freed from them.
    """
    blocks, declared, hidden = _page_blocks(page, False)
    return _page_blocks(page, True)[0] if hidden and not declared else blocks


def _page_blocks(page: str, freed: bool) -> tuple[list[tuple[str, bool]], bool, bool]:
    """The blocks, whether an article was met, and whether one was met in a marked part."""
    blocks: list[tuple[str, bool]] = []
    text: list[str] = []
    # Open elements as (tag, outside, named, article); phrases are kept only inside a marked one of their name.
    stack: list[tuple[str, int, bool, bool]] = []
    n_open: dict[str, int] = {}
    at, outside, named, article = 0, 0, 0, 0
    declared = hidden = False

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                blocks.append((block, article == 0))

    def enter(tag: str, marked: int, is_article: bool) -> None:
        nonlocal outside, named, article
        out = -outside if is_article and freed else int(marked > 0)
        stack.append((tag, out, marked == _BY_NAME, is_article))
        n_open[tag] = n_open.get(tag, 0) + 1
        outside += out
        named += marked == _BY_NAME
        article += is_article

    def leave(k: int) -> None:
        nonlocal outside, named, article
        for tag, out, by_name, is_article in stack[k:]:
            n_open[tag] -= 1
            outside -= out
            named -= by_name
            article -= is_article
        del stack[k:]

    for m in iter(lambda: _TAG.search(page, at), None):
        if not outside and m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            # Closing tags that open nothing are passed over without a look at what is open.
            if not n_open.get(tag):
                if not outside and tag not in _INLINE:
                    flush()
                continue
            if not outside:
                flush()
            leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = m.group(3) or m.group(6)
        is_main = tag in ("article", "main")
        marked = _outside(tag, attributes, article > 0, _COMMENTS if is_main and freed else _MARKS)
        if is_main and not named and (outside or marked):
            hidden = hidden or not _outside(tag, attributes, article > 0, _COMMENTS)
        if tag in _INLINE or tag in _VOID:
            if not outside:
                text.append(" ") if tag in ("br", "img") else None
                if tag not in _INLINE:
                    flush()
            if tag in _VOID:
                continue
            if not marked:
                if n_open.get(tag):
                    enter(tag, 0, False)
                continue
        elif not outside:
            flush()
        if tag in _CLOSES:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in _CLOSES[tag]:
                k -= 1
            leave(k + 1)
        if tag != "p":
            is_article = is_main and not marked and not (named if freed else outside)
            declared = declared or is_article
            enter(tag, marked, is_article)
        elif marked:
            enter(tag, marked, False)
    if not outside and at < len(page):
        text.append(page[at:])
    flush()
    return blocks, declared, hidden


def repeated(tokens: np.ndarray, pages: np.ndarray, long: int = LONG, least: int = PAGES) -> np.ndarray:
    """Tokens covered by a substring of ``long`` tokens that returns on ``least`` distinct pages.

    ``pages`` ascends. Ranks are doubled until they compare ``long`` tokens, as in building a suffix array. It
    says for tokens in memory what the hashes say for hosts of any size, and is what they are tested against.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < long:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    seen = 1
    while seen < long:
        step = min(seen, long - seen)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
        seen += step
    starts = np.flatnonzero(pages[: n - long + 1] == pages[long - 1 :])
    order = starts[np.lexsort((pages[starts], rank[starts]))]
    first = np.r_[True, np.diff(rank[order]) != 0]
    new_page = first | np.r_[True, np.diff(pages[order]) != 0]
    group = np.cumsum(first) - 1
    often = np.bincount(group[new_page])[group] >= least if len(order) else np.zeros(0, bool)
    return _covered(n, order[often], order[often] + long)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("open", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[{"text": t, "open": o} for t, o in page_blocks(h or "")] for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, kind)], names=["page_id", "url", "blocks"]
                )

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    schema = "page_id long, url string, blocks array<struct<text:string,open:boolean>>"
    return columns.mapInArrow(run, schema)


def _gone(covered: np.ndarray, long: int = LONG) -> np.ndarray:
    """What leaves a block: all of it if all is covered, else covered runs that are long by themselves.

    A repeat may begin in the blocks before; its last words alone do not make a block's own begin boilerplate.
    """
    if covered.all() or not covered.any():
        return covered
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= long
    return out


_HASH = np.dtype([("h1", "<i8"), ("h2", "<i8")])
#: Odd factors of the two rolling hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def passages(stream: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a stream's passages, and the places of the tokens they start at and end before."""
    tokens = [w for block in stream for w in block.split(" ")]
    n = max(len(tokens) - LONG + 1, 0)
    digest = {w: _digest(w) for w in set(tokens)}
    codes = np.frombuffer(b"".join(map(digest.__getitem__, tokens)), "<u8").reshape(-1, 2)
    found = np.zeros(n, _HASH)
    for lane, name in enumerate(_HASH.names):
        h = np.zeros(n, np.uint64)
        for k in range(LONG if n else 0):
            h = h * np.uint64(_FACTORS[lane]) + codes[k : k + n, lane]
        found[name] = h.view(np.int64)
    starts = np.arange(n)
    edge = np.r_[0, np.cumsum([block.count(" ") + 1 for block in stream])]
    # The shortest runs that start at a block, and those that end with one.
    first = np.arange(len(stream))
    behind = np.searchsorted(edge, edge[:-1] + LONG_BLOCKS)
    before = np.searchsorted(edge, edge[1:] - LONG_BLOCKS, "right") - 1
    runs = {(int(a), int(b)) for a, b in zip(first, behind) if b <= len(stream)}
    runs |= {(int(a), int(b) + 1) for a, b in zip(before, first) if a >= 0}
    whole = np.frombuffer(b"".join(_digest("\n".join(["", *stream[a:b]])) for a, b in runs), _HASH)
    ends = np.array([(edge[a], edge[b]) for a, b in runs], np.int64).reshape(-1, 2)
    return np.r_[found, whole], np.r_[starts, ends[:, 0]], np.r_[starts + LONG, ends[:, 1]]


def _hashed(streams: DataFrame) -> DataFrame:
    """Per stream its distinct passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.unique(passages(batch.column(2)[row].as_py())[0])
                one = np.zeros(len(found), np.int64)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    same = pa.array(one[at : at + 50_000])
                    columns = [pc.take(batch.column(k).slice(row, 1), same) for k in (0, 1, 3)]
                    hashes = [pa.array(np.ascontiguousarray(part[h])) for h in _HASH.names]
                    yield pa.RecordBatch.from_arrays(columns + hashes, names=["host", "stream_key", "n_pages", "h1", "h2"])

    columns = streams.select("host", "stream_key", "stream", "n_pages")
    return columns.mapInArrow(run, "host string, stream_key string, n_pages long, h1 long, h2 long")


def unique_runs(stream: list[str], often: np.ndarray) -> list[str]:
    """The blocks of a stream without the passages that the host repeats."""
    found, starts, ends = passages(stream)
    hit = np.isin(found, often)
    cut = [block.split(" ") for block in stream]
    covered = _covered(sum(map(len, cut)), starts[hit], ends[hit])
    kept, at = [], 0
    for block in cut:
        gone = _gone(covered[at : at + len(block)])
        kept.append(" ".join(w for w, g in zip(block, gone) if not g))
        at += len(block)
    return kept


def _without_repeats(streams: DataFrame) -> DataFrame:
    """host, stream_key and ``kept`` of streams with their ``often`` repeated passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                often = part.column(3)[0].values
                hashes = np.zeros(len(often), _HASH)
                for h in _HASH.names:
                    hashes[h] = often.field(h).to_numpy()
                kept = unique_runs(part.column(2)[0].as_py(), hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([kept], pa.list_(pa.string()))],
                    names=["host", "stream_key", "kept"],
                )

    columns = streams.select("host", "stream_key", "stream", "often")
    return columns.mapInArrow(run, "host string, stream_key string, kept array<string>")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url and text, blocks joined by an empty line."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    stream = F.transform(F.filter("blocks", lambda b: b["open"]), lambda b: b["text"])
    parsed = _parsed(pages).withColumn("host", host).withColumn("stream", stream)
    page = F.array_join(F.transform("blocks", lambda b: F.concat(b["open"].cast("string"), b["text"])), "\n")
    parsed = stage(
        parsed.withColumn("stream_key", F.when(F.size("stream") > 0, F.sha2(F.array_join("stream", "\n"), 256)))
        .withColumn("page_key", F.sha2(page, 256)),
        "pages",
    )
    open_ = parsed.where(F.col("stream_key").isNotNull())
    streams = open_.select("host", "stream_key", "page_key", "stream").dropDuplicates(["host", "stream_key", "page_key"])
    streams = streams.groupBy("host", "stream_key").agg(
        F.first("stream").alias("stream"), F.count("*").alias("n_pages")
    )
    streams = stage(streams, "page-streams")
    hashed = _hashed(streams)
    least = F.greatest(F.lit(PAGES), F.ceil(F.sum("n_pages") / ONE_IN))
    hosts = streams.groupBy("host").agg(least.alias("least"))
    often = hashed.groupBy("host", "h1", "h2").agg(F.sum("n_pages").alias("n")).where(F.col("n") >= PAGES)
    often = often.join(hosts, "host").where("n >= least").select("host", "h1", "h2")
    held = hashed.join(often, ["host", "h1", "h2"]).groupBy("host", "stream_key").agg(
        F.collect_list(F.struct("h1", "h2")).alias("often")
    )
    kept = _without_repeats(streams.join(held, ["host", "stream_key"]))
    # Streams in which nothing repeats keep their blocks.
    rows = parsed.join(kept, ["host", "stream_key"], "left").withColumn("kept", F.coalesce("kept", "stream"))
    # The n-th open block of a page takes the n-th kept run.
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def take(a, b):
        run = F.when(b["open"], F.get("kept", a["n"])).otherwise(b["text"])
        return F.struct((a["n"] + b["open"].cast("int")).alias("n"), F.array_append(a["out"], run).alias("out"))

    whole = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    picked = F.aggregate("blocks", start, take, lambda a: a["out"])
    text = F.array_join(F.filter(picked, lambda t: t != ""), "\n\n")
    return rows.select("page_id", "url", F.when(F.col("stream_key").isNull(), whole).otherwise(text).alias("text"))
