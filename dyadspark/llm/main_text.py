"""Main text of web pages: page structure, and suffix arrays over the token streams of a host.

Each page is read into blocks (a block ends where a block element begins or ends) by a scanner that takes time in
proportion to the page, however broken its markup. The elements around a block say what it is: inside
``article``/``main`` or a container named like a body of text it is *content*; inside menus, headers, footers,
sidebars, forms, adverts, notices, comments, scripts, styles or hidden parts it is *dropped*; anything else is
*open*. The words of the blocks that are not dropped make the page's token stream.

A run of ``min_tokens`` tokens is a *window*. How many distinct pages of a host hold a window is counted exactly,
whatever the size of the host, and no page is shuffled for it:

1. Every window has an anchor, the smallest hash among its ``k``-token grams; equal windows have equal anchors.
   Tasks count the pages of each anchor, the counts are added by anchor, and anchors on fewer than ``min_pages``
   pages are out. The others set bits of a bitmap, 16 for each up to 32 MB; a false bit costs work and changes nothing.
2. A task concatenates the streams of its pages host by host and sorts their suffix array up to ``min_tokens``
   tokens, for the windows whose anchor is in the bitmap. Rows with equal beginnings are one window; the pages in
   each such interval are counted, and the counts of all tasks are added by host and window.
3. Windows on ``min_pages`` pages or more *repeat*; those on ``site_pages`` or more and on over ``site_share`` of
   the host's pages are *site-wide*. They go back to the pages (broadcast if they are counted to be few, else by a
   join on the window) and every token that they cover is marked.

Repeated tokens are removed from open blocks and site-wide ones from content as well; what is left of a block, its
unique runs, is kept. An article may quote or repeat another page, so mere repeats stay in content. Leftovers of
one or two tokens in a block that is mostly covered go with it. A page that would lose 90 % of its words or more
is a mirror of other pages and stays whole. Open blocks go if they are mostly link text, or if the page marks its
article by an element or a name for just that. Inside content, names that are ordinary words (``legal``, ``share``) drop
nothing by themselves: where one is the whole class or id of an element, its blocks go if they are mostly link text, and lose
what repeats on the host as open blocks do. ``covered`` reports the share of repeated tokens of every page.

Defined results: null html is an empty page with text ''; pages with a null url are one host, apart from urls
without a host; every row is a page, also where ids repeat; very long pages are one step of their own and are read
whole; equal counts need no order (ties do not arise); an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.operators.checkpoints import cut, stored

#: Zones of a block: inside the article under an ordinary name, marked as the article, in a container named like one,
#: anything else, dropped.
_DOUBTFUL, _ARTICLE, _CONTENT, _OPEN, _DROP = 4, 3, 2, 1, 0
#: Bits of the bitmap of anchors that repeat, at least and at most.
_BITS, _MOST_BITS = 1 << 24, 1 << 28

#: Elements and name parts that tell a page's regions.
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline-share captcha chrome colophon comment comments consent cookie cookies copyright disclaimer "
    "discussion disqus dropdown feedback footer footnav gdpr hidden legal links login masthead menu menus menubar modal nav navbar navi navigation newsletter notice notices overlay pager pagination "
    "paywall popup popups promo promoted promotion recommend recommended recommendations related replies reply respond search share sharing shoutbox sidebar signin signup skip skyscraper social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar trackback tracking widget widgets".split()
)
#: Of these, words that articles use for parts of their own; inside content they drop nothing by themselves.
_ORDINARY = frozenset("copyright disclaimer discussion feedback hidden legal links login notice notices recommend recommended recommendations reply replies respond search share signin signup social subscription tags tracking".split())
_HEADERS = frozenset("header head topbar masthead banner".split())
_ARTICLE_NAMES = frozenset("article main articlebody maincontent maintext hentry".split())
_GOOD_NAMES = _ARTICLE_NAMES | frozenset("content entry post story body".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())

def _markup(attributes: str) -> re.Pattern:
    """Comments, raw elements, declarations and tags; a tag that never ends matches as its first character.

    No part gives back what it has taken, so a failed attempt reads the rest of the page once.
    """
    raw = rf"<(script|style|textarea|title|noscript|template|iframe|svg)\b{attributes}>(?:.*?</\1\s*>|.*)"
    return re.compile(rf"<!--(?:.*?-->|.*)|{raw}|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>|<(?=/?[a-zA-Z])", re.S | re.I)


#: Attributes with quotes; once a quote is found to stay open, tags end at the next ``>``.
_MARKUP, _UNQUOTED = _markup(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"), _markup(r"[^>]*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def _zone(tag: str, attributes: str, zone: int) -> int:
    """The zone inside an element that opens in ``zone``."""
    if zone == _DROP or tag in _DROPPED:
        return _DROP
    if tag == "header":
        return zone if zone >= _CONTENT else _DROP
    bad = good = article = doubtful = False
    if attributes and attributes.strip(" /"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                parts = {p.lower() for p in _PART.findall(value)} | set(value.lower().split())
                own = parts & _BAD_NAMES
                if zone >= _CONTENT:
                    doubtful |= bool(own & _ORDINARY & set(value.lower().split()))  # the whole name, not a part of one
                    own -= _HEADERS | _ORDINARY
                bad |= bool(own) or (bool(parts & _HEADERS) and zone < _CONTENT and not parts & _GOOD_NAMES)
                good |= bool(parts & _GOOD_NAMES)
                article |= bool(parts & _ARTICLE_NAMES)
            elif name == "role":
                bad |= value.lower() in _BAD_ROLES
                article |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                bad = True
            elif name == "style":
                bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    good |= article
    if tag in ("article", "main"):
        return _DROP if bad and not good and zone >= _CONTENT else _ARTICLE
    if tag in ("html", "body"):
        return zone
    if bad:
        return _DROP
    zone = max(zone, _ARTICLE if article else _CONTENT) if good else zone
    return _DOUBTFUL if doubtful else zone


def blocks(page: str) -> list[tuple[str, int, float]]:
    """``(text, zone, share of link text)`` of the blocks of a page in order; empty blocks are left out."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    zone, links, linked = _OPEN, 0, 0
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of the open elements on the stack
    block_at: list[int] = []  # of those, block elements

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=-1)

    def pop(depth: int) -> None:
        nonlocal zone, links
        zone = stack[depth][1]
        for t, _ in stack[depth:]:
            where[t].pop()
            links -= t == "a"
        del stack[depth:]
        while block_at and block_at[-1] >= depth:
            block_at.pop()

    def end() -> None:
        nonlocal text, linked
        if text:
            own = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if own:
                out.append((own, zone, min(1.0, linked / len(own))))
        text, linked = [], 0

    at, markup = 0, _MARKUP
    while m := markup.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            if zone != _DROP or piece.strip():
                text.append(piece)
                if links:
                    linked += len(piece)
        at = m.end()
        if m[3] is None:
            if at == m.start() + 1:  # a tag that does not end
                at = m.start()
                if markup is _UNQUOTED:
                    at = len(page)
                    break
                markup = _UNQUOTED
            elif m[1] and m[1].lower() in _BLOCKS:
                end()
            continue
        tag = m[3].lower()
        if m[2]:
            depth = last(tag)
            if tag not in _BLOCKS and block_at and block_at[-1] > depth:
                depth = -1
            if tag in _BLOCKS:
                end()
            if depth >= 0:
                if any(z != zone for _, z in stack[depth:]):
                    end()
                pop(depth)
            continue
        if tag in _BLOCKS:
            end()
        if tag in _VOID or m[4].rstrip().endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a"):  # these close one of their kind
            depth = last(tag)
            if depth >= 0 and depth > last("ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "aside", "footer", "header", "body", "select", *(["tr"] if tag in ("td", "th") else [])):
                pop(depth)
        where[tag].append(len(stack))
        if tag in _BLOCKS:
            block_at.append(len(stack))
        stack.append((tag, zone))
        inside = _zone(tag, m[4], zone)
        if inside != zone:
            end()
            zone = inside
        links += tag == "a"
    text.append(page[at:])
    end()
    return out


def intervals(tokens: np.ndarray, page: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of ``starts``, sorted up to ``size`` tokens by doubling: ``(rows, cuts, pages)``.

    ``cuts`` are the first rows of the intervals with equal beginnings, ``pages`` the distinct pages in each.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width * 2 <= size:
        rank = _pair_ranks(rank, rank, width)
        width *= 2
    if size > width:  # two overlapping halves make any length
        rank = _pair_ranks(rank, rank, size - width)
    rows = starts[np.lexsort((page[starts], rank[starts]))]
    group, own = rank[rows], page[rows]
    new_group = np.ones(len(rows), bool)
    new_group[1:] = group[1:] != group[:-1]
    new_page = new_group.copy()
    new_page[1:] |= own[1:] != own[:-1]
    cuts = np.flatnonzero(new_group)
    return rows, cuts, np.add.reduceat(new_page, cuts, dtype=np.int64) if len(cuts) else np.zeros(0, np.int64)


def _pair_ranks(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of ``(a[i], b[i + shift])``; past the end nothing follows."""
    after = np.full(len(b), -1, np.int64)
    after[: len(b) - shift] = b[shift:]
    _, rank = np.unique(a * (int(b.max()) + 2) + after + 1, return_inverse=True)
    return rank


def window_starts(page: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` tokens of one page begin; ``page`` numbers the page of each token, ascending."""
    return np.flatnonzero(page[: max(0, len(page) - size + 1)] == page[size - 1 :])


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window that begins in ``starts``."""
    level = np.zeros(n + 1, np.int64)
    np.add.at(level, starts, 1)
    np.add.at(level, starts + size, -1)
    return np.cumsum(level)[:-1] > 0


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, min_tokens: int, min_pages: int) -> np.ndarray:
    """Whether each token lies in a window of ``min_tokens`` tokens that ``min_pages`` distinct pages hold."""
    rows, cuts, pages = intervals(tokens, page, window_starts(page, min_tokens), min_tokens) if len(tokens) else (tokens, tokens, tokens)
    return covered(len(tokens), rows[np.repeat(pages >= min_pages, np.diff(np.append(cuts, len(rows))))], min_tokens)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` tokens."""
    n = len(tokens) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * _MIX + tokens[i : i + n]
    return _mixed(out)


class Streams:
    """The token streams of the pages of one part, host after host."""

    def __init__(self, table: pa.Table, min_tokens: int, k: int):
        self.size = min_tokens
        texts, zones = table.column("texts").to_pylist(), table.column("zones").to_pylist()
        host = table.column("host").to_numpy()
        self.order = np.argsort(host, kind="stable")
        self.host = host[self.order].view(np.uint64)  # of each page
        ids: dict[str, int] = {}
        code: list[int] = []
        page_sizes, block_sizes, self.blocks = [], [], []  # blocks: (page, words, zone, block's place in the page)
        for number, i in enumerate(self.order.tolist()):
            total = 0
            for place, (text, zone) in enumerate(zip(texts[i], zones[i], strict=True)):
                if zone == _DROP:
                    continue
                words = text.split(" ")
                code += [ids.setdefault(w, len(ids)) for w in words]
                block_sizes.append(len(words))
                self.blocks.append((number, words, zone, place))
                total += len(words)
            page_sizes.append(total)
        self.page = np.repeat(np.arange(len(page_sizes)), page_sizes)
        self.block_at = np.concatenate([[0], np.cumsum(block_sizes)]).astype(np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)
        self.tokens = hashes[np.array(code, np.int64)] if code else np.zeros(0, np.uint64)
        self.starts = window_starts(self.page, min_tokens)
        salt = self.host[self.page] if len(self.page) else np.zeros(0, np.uint64)
        self.salt = salt
        grams, wide = _rolled(self.tokens, k), min_tokens - k + 1
        low = grams
        width = 1
        while 2 * width <= wide:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        if wide > width:
            low = np.minimum(low[: len(low) - (wide - width)], low[wide - width :]) if len(low) > wide - width else low[:0]
        self.anchor = _mixed(low[self.starts] + salt[self.starts] * _MIX) if len(self.starts) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors of the part and how many of its pages hold each."""
        by = np.lexsort((self.page[self.starts], self.anchor))
        a, p = self.anchor[by], self.page[self.starts][by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
        return np.unique(a[new], return_counts=True)

    def open_starts(self, bitmap: np.ndarray) -> np.ndarray:
        """Windows whose anchor may repeat."""
        bit = self.anchor & np.uint64(64 * len(bitmap) - 1)
        return self.starts[(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]

    def names(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows at ``starts`` with their hosts."""
        all_ = _rolled(self.tokens, self.size)
        return _mixed(all_[starts] + self.salt[starts] * _MIX)

    def windows(self, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(host, window, pages)`` of the distinct windows that may repeat, from the suffix array of each host's pages."""
        starts = self.open_starts(bitmap)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # tokens of other hosts are other tokens, so no interval reaches over hosts
        rows, cuts, pages = intervals(_mixed(self.tokens + self.salt * _MIX), self.page, starts, self.size)
        first = rows[cuts]
        return self.salt[first], self.names(first), pages

    def texts(self, repeated: np.ndarray, site: np.ndarray, given: pa.Table) -> tuple[list[str], list[float]]:
        """``(texts, shares of repeated tokens)`` of the pages in their first order; the two arrays mark window starts."""
        n = len(self.tokens)
        in_repeat, in_site = covered(n, repeated, self.size), covered(n, site, self.size)
        zone = np.repeat(np.array([b[2] for b in self.blocks], np.int64), np.diff(self.block_at))
        gone = np.where((zone == _OPEN) | (zone == _DOUBTFUL), in_repeat, in_site)
        n_pages = len(self.order)
        size = np.bincount(self.page, minlength=n_pages)
        mirror = np.bincount(self.page, weights=gone, minlength=n_pages) >= 0.9 * np.maximum(size, 1)
        share = np.bincount(self.page, weights=in_repeat, minlength=n_pages) / np.maximum(size, 1)
        article = {b[0] for b in self.blocks if b[2] == _ARTICLE}
        linked = given.column("linked").to_pylist()
        parts: list[list[str]] = [[] for _ in range(n_pages)]
        lost = np.concatenate([[0], np.cumsum(gone)])[self.block_at]
        order = self.order.tolist()
        for i, (number, words, z, place) in enumerate(self.blocks):
            if (z == _OPEN and number in article) or (z in (_OPEN, _DOUBTFUL) and linked[order[number]][place] >= 0.6):
                continue
            if lost[i + 1] > lost[i] and not mirror[number]:
                words = _unique_runs(words, gone[self.block_at[i] : self.block_at[i + 1]])
            if words:
                parts[number].append(" ".join(words))
        texts, shares = [""] * n_pages, [0.0] * n_pages
        for number, i in enumerate(order):
            texts[i], shares[i] = "\n".join(parts[number]), float(share[number])
        return texts, shares


def _unique_runs(words: list[str], gone: np.ndarray) -> list[str]:
    """The words that are not covered; runs of one or two go too where the block is mostly covered."""
    keep = ~gone
    if 2 * gone.sum() >= len(words):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a <= 2:
                keep[a:b] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _parts(batches, part_bytes: int):
    """Tables of pages with about ``part_bytes`` of text; a longer page is a part of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("bytes").to_numpy()).cumsum(), prepend=0)
        a = 0
        for i, own in enumerate(sizes.tolist()):
            if size and size + own > part_bytes:
                held.append(batch.slice(a, i - a))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, a = [], 0, i
            size += own
        held.append(batch.slice(a))
    if size or any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def parsed(pages: DataFrame) -> DataFrame:
    """``(row, page_id, url, host, bytes, texts, zones, linked)`` of every page; ``host`` is a hash."""
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.xxhash64(F.col("url").isNull(), name).alias("host"), "html")
    kind = given.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [blocks(p) if p else [] for p in batch.column("html").to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            nested = lambda j, to: pa.ListArray.from_arrays(ends, pa.array([b[j] for x in found for b in x], to))
            own = {c: batch.column(c) for c in ("row", "page_id", "url", "host")}
            own |= {"bytes": pa.array([sum(len(b[0]) for b in x) for x in found], pa.int64()), "texts": nested(0, pa.string()), "zones": nested(1, pa.int8()), "linked": nested(2, pa.float32())}
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    return given.mapInArrow(run, f"row long, page_id {kind}, url string, host long, bytes long, texts array<string>, zones array<tinyint>, linked array<float>")


def extract(pages: DataFrame, *, min_tokens: int = 10, k: int = 3, min_pages: int = 3, site_pages: int = 8, site_share: float = 0.5, part_bytes: int = 2 << 20, most_broadcast: int = 1 << 20) -> DataFrame:
    """``(page_id, url, text, n_chars, covered)`` of every row."""
    spark = pages.sparkSession
    own = stored(parsed(pages))
    kind = own.schema["page_id"].dataType.simpleString()
    hosts = own.groupBy("host").agg(F.count("*").alias("all"))

    def count_anchors(batches):
        for table in _parts(batches, part_bytes):
            h, n = Streams(table, min_tokens, k).anchors()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    often = own.mapInArrow(count_anchors, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    often = cut(often.select("h"))
    bits = min(_MOST_BITS, max(_BITS, 1 << (16 * often.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = often.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")).toPandas()  # at most _MOST_BITS / 64 rows
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def count_windows(batches):
        for table in _parts(batches, part_bytes):
            host, w, n = Streams(table, min_tokens, k).windows(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(host.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int32))], ["host", "w", "n"])

    found = own.mapInArrow(count_windows, "host long, w long, n int").groupBy("host", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    found = cut(found)
    site = (F.col("n") >= site_pages) & (F.col("n") > site_share * F.col("all"))
    verdicts = cut(found.join(hosts, "host").groupBy("w").agg(F.max(site).alias("site")))
    few = verdicts.count() <= most_broadcast
    if few:
        known = verdicts.toPandas().sort_values("w")
        at = spark.sparkContext.broadcast((known["w"].to_numpy(np.int64), known["site"].to_numpy(bool)))

    def marked(streams):
        """``(starts, site-wide)`` of the windows that the broadcast verdicts name."""
        starts = streams.open_starts(shared.value)
        names, wide = at.value
        own_names = streams.names(starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(names, own_names), max(0, len(names) - 1))
        hit = names[place] == own_names if len(names) else np.zeros(len(starts), bool)
        return starts[hit], wide[place[hit]] if len(names) else np.zeros(0, bool)

    def finish(batches):
        for table in _parts(batches, part_bytes):
            streams = Streams(table, min_tokens, k)
            if few:
                starts, wide = marked(streams)
            else:  # places count from the start of a page
                first = np.searchsorted(streams.page, np.arange(len(streams.order)))
                own_at = [(first[number] + p["at"], p["site"]) for number, i in enumerate(streams.order.tolist()) for p in table.column("spans")[i].as_py() or []]
                starts, wide = np.array([x for x, _ in own_at], np.int64), np.array([x for _, x in own_at], bool)
            texts, shares = streams.texts(starts, starts[wide], table)
            yield pa.RecordBatch.from_arrays([table.column("page_id").combine_chunks(), table.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shares, pa.float64())], ["page_id", "url", "text", "n_chars", "covered"])

    def places(batches):
        for table in _parts(batches, part_bytes):
            streams = Streams(table, min_tokens, k)
            starts = streams.open_starts(shared.value)
            number = streams.page[starts]
            first = np.searchsorted(streams.page, np.arange(len(streams.order)))
            row = table.column("row").to_numpy()[streams.order[number]]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(streams.names(starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)), pa.array(starts - first[number])], ["row", "w", "at"])

    if not few:
        spans = own.mapInArrow(places, "row long, w long, at long").join(verdicts, "w").groupBy("row").agg(F.collect_list(F.struct("at", "site")).alias("spans"))
        own = own.join(spans, "row", "left")
    return own.mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, covered double")
