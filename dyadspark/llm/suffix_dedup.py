"""Exact removal of repeated substrings by threshold-bounded interval expansion on a BWT.

A byte is removed if a ``length``-byte string that covers it also starts earlier: in a text of a smaller
``doc_id``, or in the same text further left. Strings are judged on the input, overlaps count, and none
crosses a text.

1. Every ``length``-byte window has an anchor: the place of the smallest hash among its ``k``-byte substrings.
   Equal windows have equal anchors at equal places, so only windows whose anchor occurs twice or more can
   repeat. Windows that follow each other and share an anchor form one context of at most ``2 * length`` bytes.
2. Anchors are counted with map-side combining; texts with anchors that repeat give their contexts, dealt out
   by anchor. An anchor with very many contexts is dealt out to several tasks first; only contexts that hold
   the first occurrence of some window in their task go on to the second round, so a passage that a third of
   all texts share never meets in one task. There the windows are dealt out by a second anchor as well, one away from
   the first, so different surroundings of a frequent phrase do not meet in one task either.
3. A task merges equal contexts (the first one stands for the others) and builds the Burrows-Wheeler transform
   of the rest, block by block. Starting from the empty string, breadth-first backward extension visits the
   intervals of ever longer strings; the boundary to the right of an interval that has none yet gets the
   length reached as its common prefix, and intervals whose boundary is known are not extended. After
   ``length`` levels exactly the boundaries with shorter common prefixes are known, so what stands between two
   of them are the occurrences of one ``length``-byte string. All but the first are marked.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; rows with a null id stay whole
and match nothing; rows that repeat id and text are one document, and rows that repeat only the id are documents of
their own, in an order that follows from their texts; very long texts are read in overlapping pieces and whole; an
empty table gives an empty result; other columns, whatever their names, are ignored or carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import as_bytes, partitions, ranges, steps, unused
from dyadspark.operators.checkpoints import stored

_RANDOM = np.random.default_rng(0x5EED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = 23
#: Never part of UTF-8.
_SEPARATOR = 0xFF


def _power(e: int) -> np.uint64:
    return np.uint64(pow(_BASE, e, 1 << 64))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-byte substrings, by doubling."""
    doubled, width, parts, at = _RANDOM[data], 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            take = doubled[at:] if at else doubled
            if parts is None:
                parts = take
            else:
                n = len(take)
                parts = parts[:n] * _power(width) + take
            at += width
        rest >>= 1
        if rest:
            doubled = doubled[:-width] * _power(width) + doubled[width:]
            width *= 2
    h = parts ^ (parts >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (w - width)], v[w - width :]) if w > width else v


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, anchor)`` of each maximal run of windows with one anchor; starts count from the text's."""
    lengths = np.maximum(np.diff(offsets) - length + 1, 0)
    empty = np.zeros(0, np.int64)
    if not lengths.any():
        return empty, empty, empty, empty
    out = []
    piece = 1 << (_PLACE - 1)
    if len(data) <= piece:
        jobs = [(0, len(offsets) - 1, 0, len(data))]
    else:  # one very long text: its windows in pieces
        jobs = [(i, i + 1, a, min(a + piece, offsets[i] + lengths[i]) + length - 1) for i in np.flatnonzero(lengths) for a in range(offsets[i], offsets[i] + lengths[i], piece)]
    for i, j, a, b in jobs:
        own = data[a:b]
        h = _gram_hashes(own, k)
        packed = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        best = _sliding_min(packed, length - k + 1)
        if j - i == 1:
            doc, at = np.full(len(best), i), np.arange(len(best))
        else:
            doc, at = np.repeat(np.arange(i, j), lengths[i:j]), ranges(offsets[i:j] - a, lengths[i:j])
        best = best[at]
        new = np.ones(len(at), bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        place = (best[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        out.append((doc[first], at[first] + a - offsets[doc[first]], np.diff(np.append(first, len(at))), h[place].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text in the order of their first ``depth`` bytes or more, by prefix doubling.

    A rotation's rank is the first row of its group, so ranks stay when other groups are refined, and only rows
    of groups that still have several members are sorted again.
    """
    n = len(text)
    key, width = text.astype(np.uint64), 1
    while width < 8:
        key = key << np.uint64(8 * width) | np.roll(key, -width)
        width *= 2
    order = np.argsort(key)
    at, sorted_keys = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    while True:
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        sizes = np.diff(np.append(first, len(at)))
        rank[order[at]] = np.repeat(at[first], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if width >= depth or not len(at):
            return order
        rows = order[at]
        after = rows + width
        after[after >= n] -= n
        key = rank[rows] * n + rank[after]
        by = np.argsort(key)
        order[at], sorted_keys = rows[by], key[by]
        width *= 2


def bounded_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each row of the sorted rotations differs from the row before within the first ``length`` bytes.

    Level by level, the intervals of the strings of that many bytes are extended to the left by every byte
    that the transform holds in them. An interval is kept only if the boundary at its end was not known.
    """
    n = len(text)
    bwt = text[order - 1]
    head = text[order]
    back = np.empty(n, np.int64)  # row of the rotation that starts one byte earlier
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    tag = np.full(n, -1, np.int64)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        single = hi - lo == 1
        one = back[lo[single]]
        wide_lo, wide = lo[~single], (hi - lo)[~single]
        rows = back[ranges(wide_lo, wide)]
        tag[rows] = np.repeat(np.arange(len(wide)), wide)
        rows = np.flatnonzero(tag >= 0) if len(rows) > n >> 4 else np.sort(rows)
        own, byte = tag[rows], head[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])
        begin = np.flatnonzero(new)
        tag[rows] = -1
        lo = np.concatenate([one, rows[begin]])
        hi = np.concatenate([one + 1, rows[np.append(begin[1:], len(rows)) - 1] + 1]) if len(rows) else one + 1
        keep = ~known[hi]
        lo, hi = lo[keep], hi[keep]
        known[hi] = True
    return known[:n]


def repeated_windows(contexts: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """For ``(bytes, offsets)`` of contexts in the order of their occurrence: per byte, 0 if no window starts there,
    1 if the window there is the first of its kind, 2 if an equal one comes before."""
    data, offsets = contexts
    n_ctx = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(n_ctx), np.diff(offsets))
    text = np.full(len(data) + n_ctx, _SEPARATOR, np.uint8)
    text[at] = data
    starts = np.zeros(len(text), bool)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    starts[ranges(offsets[:-1] + np.arange(n_ctx), windows)] = True
    order = suffix_array(text, length)
    group = np.cumsum(bounded_boundaries(text, order, length))
    rows = np.flatnonzero(starts[order])
    found = np.zeros(len(text), np.uint8)
    if len(rows):
        place, group = order[rows], group[rows]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.minimum.reduceat(place, cuts)
        found[place] = np.where(place > np.repeat(first, np.diff(np.append(cuts, len(rows)))), 2, 1)
    return found[at]


def _resolve(table: pa.Table, length: int, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Marked byte ranges of the contexts in ``table``, and those contexts that a second round has to see."""
    codes = table.column("ctx").combine_chunks().dictionary_encode().indices
    table = table.drop_columns(["code"] if "code" in table.schema.names else []).append_column("code", codes).append_column("row", pa.array(np.arange(table.num_rows)))
    order = table.select(["code", "doc_id", "s0", "row"]).sort_by([("code", "ascending"), ("doc_id", "ascending"), ("s0", "ascending")])
    row, code = order.column("row").to_numpy(), order.column("code").to_numpy()
    new = np.ones(len(row), bool)
    new[1:] = code[1:] != code[:-1]
    head = row[np.flatnonzero(new)][np.cumsum(new) - 1]
    ids, s0 = table.column("doc_id").combine_chunks(), table.column("s0").to_numpy()
    width = _lengths(table.column("ctx"))
    later = row[~new]
    # equal contexts after the first are marked whole, unless they are the same place of a repeated row
    same = np.zeros(len(later), bool)
    if len(later):
        same = (s0[later] == s0[head[~new]]) & pc.equal(ids.take(pa.array(later)), ids.take(pa.array(head[~new]))).to_numpy(zero_copy_only=False)
    later = later[~same]
    yield _ranges(ids, later, s0[later], s0[later] + width[later])

    firsts = table.take(pa.array(np.sort(row[new]))).sort_by([("h", "ascending"), ("salts", "ascending"), ("doc_id", "ascending"), ("s0", "ascending")])
    sizes = _lengths(firsts.column("ctx"))
    h = firsts.column("h").to_numpy()
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    a = 0
    while a < len(h):
        want = (ends[a - 1] if a else 0) + block
        i = int(np.searchsorted(ends, want, side="right"))
        nxt = cuts[np.searchsorted(cuts, max(i, a + 1), side="left") :]
        nxt = nxt[0] if len(nxt) else len(h)
        prev = cuts[(cuts > a) & (cuts <= i)]
        b = int(prev[-1]) if len(prev) and nxt > i else int(nxt)
        yield from _block(firsts.slice(a, b - a), length, k)
        a = b


def _block(part: pa.Table, length: int, k: int) -> Iterator[pa.RecordBatch]:
    part = part.sort_by([("doc_id", "ascending"), ("s0", "ascending")]).combine_chunks()
    ctx = part.column("ctx").combine_chunks()
    data, offsets = as_bytes(ctx)
    found = repeated_windows((data, offsets), length)
    ids, s0 = part.column("doc_id").combine_chunks(), part.column("s0").to_numpy()
    hit = found == 2
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    end = hit.copy()
    end[:-1] &= ~hit[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    row = np.searchsorted(offsets, a, side="right") - 1
    yield _ranges(ids, row, s0[row] + a - offsets[row], s0[row] + b - offsets[row] + length)
    firsts = np.add.reduceat(found == 1, offsets[:-1]) if len(data) else np.zeros(0)
    again = np.flatnonzero((firsts > 0) & (part.column("salts").to_numpy() > 1))
    if len(again):
        rows, keys, starts, texts = [], [], [], []
        for i, h in zip(again.tolist(), part.column("h").to_numpy()[again].tolist(), strict=True):
            own = data[offsets[i] : offsets[i + 1]]
            for key, a, b in second_anchors(own, h, length, k):
                rows.append(i)
                keys.append(key)
                starts.append(int(s0[i]) + a)
                texts.append(own[a : b + length - 1].tobytes())
        n = len(rows)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "a", "b", "h", "s0", "ctx"])


def second_anchors(own: np.ndarray, h: int, length: int, k: int) -> list[tuple[int, int, int]]:
    """``(key, first window, end)`` of the runs of a context's windows by a second anchor, away from the first.

    A window's second anchor is the smallest hash among its ``k``-byte substrings that start 0.4 lengths or more from
    the first one, on the side that has more of the window. It follows from the window alone, so equal windows
    keep equal keys, while contexts that only share what is around the first anchor part.
    """
    grams = _gram_hashes(own, k)
    n, far = len(own) - length + 1, 2 * length // 5
    at = int(np.flatnonzero(grams == np.int64(h).view(np.uint64))[0])
    window = np.arange(n)
    keys = np.full(n, np.uint64(h & (1 << 64) - 1))
    left = (at - window >= far) & (window <= at - far)
    if left.any():  # from the window's start up to the far side of the anchor
        low = np.minimum.accumulate(grams[: at - far + 1][::-1])[::-1]
        keys[left] = low[window[left]]
    right = ~left & (window + length - k >= at + far)
    if right.any():
        low = np.minimum.accumulate(grams[at + far :])
        keys[right] = low[window[right] + length - k - at - far]
    keys = ((keys ^ np.uint64(h & (1 << 64) - 1)) * np.uint64(_BASE)).view(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(int(keys[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], n), strict=True)]


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64)


def _ranges(ids: pa.Array, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["doc_id", "a", "b", "h", "s0", "ctx"])


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by ``(h, salt)`` in tables of about ``most`` bytes that never part a key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        h, salt = table.column("h").to_numpy(), table.column("salt").to_numpy()
        other = np.flatnonzero((h != h[-1]) | (salt != salt[-1]))
        if len(other):
            yield table.slice(0, int(other[-1]) + 1)
            held = table.slice(int(other[-1]) + 1).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _round(contexts: DataFrame, kind: str, length: int, k: int, block: int) -> DataFrame:
    """One pass of :func:`_resolve` over ``(h, salt, salts, doc_id, s0, ctx)`` dealt out by ``(h, salt)``."""

    def run(batches):
        for table in _gathered(batches, 4 * block):
            for out in _resolve(table, length, k, block):
                if out.num_rows:
                    yield out

    dealt = contexts.repartition(partitions(contexts), "h", "salt").sortWithinPartitions("h", "salt")
    return dealt.mapInArrow(run, f"doc_id {kind}, a long, b long, h long, s0 long, ctx binary")


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: the id, or where ids repeat the id and a hash of the text, in the order of the ids.

    Rows with equal id and text stay one document. Ids that are not whole numbers are then ordered as text.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.col("doc_id")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.concat(F.col("doc_id").cast("string"), F.lit("\0"))
    return F.concat(number, F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def repeated_ranges(docs: DataFrame, *, length: int = 100, k: int = 20, hot: int = 4096, block: int = 3 << 18) -> DataFrame:
    """``(doc_id, a, b)``: byte ranges to remove, possibly overlapping, of texts with an id; ``doc_id`` is :func:`row_key`."""
    given = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(row_key(docs).alias("doc_id"), "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def counts(batches):
        for _, data, offsets in steps(batches):
            h, n = np.unique(anchor_runs(data, offsets, length, k)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    def places(batches):
        for part, data, offsets in steps(batches):
            doc, s0, n, h = anchor_runs(data, offsets, length, k)
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(pa.array(doc)), pa.array(s0), pa.array(n.astype(np.int32))], ["h", "doc_id", "s0", "n"])

    often = stored(given.select("text").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n_all")).where("n_all > 1"), free=True)
    at = given.mapInArrow(places, f"h long, doc_id {kind}, s0 long, n int").join(often, "h")
    per_doc = stored(at.withColumn("salts", F.ceil(F.col("n_all") / hot).cast("int")).groupBy("doc_id").agg(F.collect_list(F.struct("h", "s0", "n", "salts")).alias("at")), free=True)
    with_text = given.join(per_doc, "doc_id").select("doc_id", "text", "at.h", "at.s0", "at.n", "at.salts")

    def contexts(batches):
        for part, data, offsets in steps(batches):
            lists = {c: part.column(c) for c in ("h", "s0", "n", "salts")}
            flat = {c: x.flatten() for c, x in lists.items()}
            many = np.diff(np.asarray(lists["h"].offsets))
            doc = np.repeat(np.arange(part.num_rows), many)
            s0, n = flat["s0"].to_numpy(), flat["n"].to_numpy().astype(np.int64)
            width = n + length - 1
            ok = s0 + width <= np.diff(offsets)[doc]  # rows that repeat an id may have a shorter text
            doc, s0, width = doc[ok], s0[ok], width[ok]
            own = data[ranges(offsets[doc] + s0, width)]
            ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
            ctx = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(own)])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([flat["h"].filter(keep), flat["salts"].filter(keep), part.column("doc_id").take(pa.array(doc)), pa.array(s0), ctx], ["h", "salts", "doc_id", "s0", "ctx"])

    found = with_text.mapInArrow(contexts, f"h long, salts int, doc_id {kind}, s0 long, ctx binary")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.shiftright("s0", 16)), F.col("salts")).cast("int"))
    first = stored(_round(found, kind, length, k, block), free=True)
    again = first.where("ctx IS NOT NULL").select("h", F.lit(1).alias("salts"), "doc_id", "s0", "ctx", F.lit(0).alias("salt"))
    second = _round(again, kind, length, k, block).where("ctx IS NULL")
    return first.where("ctx IS NULL").select("doc_id", "a", "b").unionByName(second.select("doc_id", "a", "b"))


def _cleaned(docs: DataFrame, ranges_: DataFrame, make, schema: str, carry: list[str]) -> DataFrame:
    """``make(part, data, offsets, keep, spans)`` over every text with its ranges merged."""
    key, first, last = unused(docs, "_key", "_a", "_b")
    per_doc = ranges_.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("a").alias(first), F.collect_list("b").alias(last))
    joined = docs.join(per_doc, row_key(docs) == F.col(key), "left").select(*[F.col(f"`{c}`") for c in carry], first, last)

    def run(batches):
        for part, data, offsets in steps(batches):
            a, b = part.column(first), part.column(last)
            many = np.diff(np.asarray(a.offsets))  # a null list is empty
            base = np.repeat(offsets[:-1], many)
            top = np.repeat(offsets[1:], many)
            lo, hi = np.minimum(base + a.flatten().to_numpy(), top), np.minimum(base + b.flatten().to_numpy(), top)
            level = np.zeros(len(data) + 1, np.int64)
            np.add.at(level, lo, 1)
            np.add.at(level, hi, -1)
            keep = np.cumsum(level)[:-1] == 0
            yield make(part, data, offsets, keep)

    return joined.mapInArrow(run, schema)


def removal_report(docs: DataFrame, *, length: int = 100, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def make(part, data, offsets, keep):
        gone = ~keep
        begin = gone.copy()
        begin[1:] &= keep[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        begin[edge] = gone[edge]  # spans never cross texts
        removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
        spans = np.concatenate([[0], np.cumsum(begin)])[offsets]
        left, at = data[keep].tobytes(), (offsets - removed).tolist()
        sha = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_ranges(given, length=length, **options)
    return _cleaned(given, found, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id", "text"])


def deduplicate(docs: DataFrame, *, length: int = 100, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; bytes of characters that were cut in two go too."""
    names = docs.columns
    found = repeated_ranges(docs, length=length, **options)

    def make(part, data, offsets, keep):
        removed = np.concatenate([[0], np.cumsum(~keep)])[offsets]
        left, at = data[keep].tobytes(), (offsets - removed).tolist()
        given = part.column("text").is_valid().to_pylist()
        text = pa.array([left[a:b].decode("utf-8", "ignore") if ok else None for a, b, ok in zip(at[:-1], at[1:], given, strict=True)], part.column("text").type)
        return pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in names], names)

    return _cleaned(docs, found, make, docs.schema, names)
