"""Exact removal of repeated word windows by suffix automata of reference shards.

A window is ``length`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. A word is removed if a window that covers
it also starts in a document with a smaller id; windows are judged on the input.

1. Every window has an anchor, the smallest hash among its runs of ``k`` words, so equal windows have equal anchors.
   Windows whose anchor only one document holds cannot repeat. The others that follow each other and share an anchor
   form a passage of at most ``2 * length`` words.
2. The reference is every different passage with the first document that holds it, dealt by anchor into shards of a
   bounded number of words.
3. A shard is sent to every task that streams passages against it, and only there: the shards of a corpus together
   have no bound that would let each executor hold them all. It travels as its passages, which take far less space
   than its arrays. Equal passages are one there: the first stands for the others, which go whole. Between different
   passages a suffix automaton decides, made where the shard arrives, each state with the first document of its strings;
   it is made of the stretches of windows whose hash the shard holds twice, as other windows cannot repeat. The stretches
   run through it word by word; the suffix link chain down to a state that an earlier document holds gives the matching
   statistic, the longest match with earlier documents that ends at that word. Ends with ``length`` words or more give
   the spans to remove.

Anchors with over ``wide`` different passages (a frequent line in many surroundings) are followed window by window,
each window with its own place among the shards. Anchors or windows with over ``hot`` occurrences have a shard of
their own, and the passages that stream against it are dealt to several tasks. So copies in any number, and lines in any
number of surroundings, leave shards and tasks bounded.

Defined results: a null text has no words; texts shorter than ``length`` stay whole; rows with a null id stay whole and
are no reference; rows that repeat an id never remove each other's words, each is judged by its own text; windows that
repeat only inside one document stay; very long texts are read whole; an empty table gives an empty result; other
columns, whatever their names, are ignored or carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import partitions, ranges, spans, steps, unused
from dyadspark.operators.checkpoints import release, scratch, stored

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 23) - 1)
#: Bytes of text in one numpy step.
_STEP = 1 << 20


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, word offsets)``: bytes of each word, and the first word of each text."""
    return spans(~_WHITE[data], offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    size = ends - starts
    h = eight[starts] & _LOW[np.minimum(size, 8)]
    h = (h ^ (h >> np.uint64(32))) * _MIX + size.astype(np.uint64)
    at, open_ = 8, np.flatnonzero(size > 8)
    while len(open_):
        part = eight[starts[open_] + at] & _LOW[np.minimum(size[open_] - at, 8)]
        mixed = h[open_] ^ (h[open_] >> np.uint64(29)) ^ part
        h[open_] = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        at += 8
        open_ = open_[size[open_] > at]
    h ^= h >> np.uint64(29)
    h *= _MIX2
    return h ^ (h >> np.uint64(32))


def anchor_runs(hashes: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """``(text, first word, windows, anchor)`` of each maximal run of windows with one anchor; words count from the text's."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    n = len(hashes) - k + 1
    gram = hashes[:n].copy()
    for i in range(1, k):
        gram = gram * _MIX + hashes[i : n + i]
    gram ^= gram >> np.uint64(31)
    gram *= _MIX2
    gram ^= gram >> np.uint64(29)
    packed = (gram & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    best = packed[: len(hashes) - length + 1].copy()
    for i in range(1, length - k + 1):
        np.minimum(best, packed[i : len(best) + i], out=best)
    text, at = np.repeat(np.arange(len(windows)), windows), ranges(offsets[:-1], windows)
    best = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    place = at[first] + (((best[first] & _PLACE).astype(np.int64) - at[first]) & int(_PLACE))
    return text[first], at[first] - offsets[text[first]], np.diff(np.append(first, len(at))), gram[place].view(np.int64)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word followed by one space, and where each word starts there (with the end of all)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[ranges(at[:-1], size)] = data[ranges(starts, size)]
    return out, at


class Automaton:
    """Suffix automaton of several word sequences; ``first`` is the rank of the first sequence that holds a state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, codes: list[int], rank: int) -> None:
        """Sequences come in the order of their ranks, so a state keeps the rank it was made with."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in codes:
            to = nexts[last].get(c)
            if to is not None:
                last = to if length[to] == length[last] + 1 else self._parted(last, c, to)
                continue
            own = len(length)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(rank)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = own
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[own] = q if length[q] == length[p] + 1 else self._parted(p, c, q)
            last = own

    def _parted(self, p: int, c: int, q: int) -> int:
        """The state of the shorter strings of ``q``, those that reach it from ``p``."""
        nexts, link, length = self.next, self.link, self.length
        own = len(length)
        nexts.append(nexts[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link[q] = own
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = own
            p = link[p]
        return own


class Matcher:
    """An automaton as arrays: transitions sorted by ``state * words + word``."""

    def __init__(self, moves: np.ndarray, to: np.ndarray, link: np.ndarray, length: np.ndarray, first: np.ndarray, n_words: int):
        self.moves, self.to, self.link, self.length, self.first, self.n_words = moves, to, link, length, first, n_words

    @classmethod
    def of(cls, a: Automaton, n_words: int) -> Matcher:
        sizes = np.fromiter(map(len, a.next), np.int64, len(a.next))
        total = int(sizes.sum())
        code = np.fromiter((c for d in a.next for c in d), np.int64, total)
        to = np.fromiter((t for d in a.next for t in d.values()), np.int32, total)
        moves = np.repeat(np.arange(len(sizes)), sizes) * n_words + code
        order = np.argsort(moves)
        return cls(moves[order], to[order], np.array(a.link, np.int32), np.array(a.length, np.int32), np.array(a.first, np.int32), n_words)

    def statistics(self, codes: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each word of the sequences the longest match that ends there and that a sequence of smaller rank holds.

        ``codes`` under 0 are words the automaton does not know.
        """
        n, size = len(offsets) - 1, np.diff(offsets)
        out = np.zeros(len(codes), np.int32)
        state, match = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > j)
            code = codes[offsets[rows] + j]
            todo = np.arange(len(rows))
            while len(todo):
                r = rows[todo]
                key = state[r] * self.n_words + code[todo]
                at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
                hit = (code[todo] >= 0) & (self.moves[at] == key) if len(self.moves) else np.zeros(len(todo), bool)
                state[r[hit]] = self.to[at[hit]]
                match[r[hit]] += 1
                lost = r[~hit]
                at_root = state[lost] == 0
                match[lost[at_root]] = 0
                state[lost] = np.where(at_root, 0, self.link[state[lost]])
                match[lost[~at_root]] = self.length[state[lost[~at_root]]]
                todo = todo[~hit][~at_root]
            s, m = state[rows], match[rows]
            late = np.flatnonzero((s > 0) & (self.first[s] >= rank[rows]))
            while len(late):
                s[late] = self.link[s[late]]
                m[late] = self.length[s[late]]
                late = late[(s[late] > 0) & (self.first[s[late]] >= rank[rows[late]])]
            out[offsets[rows] + j] = m
        return out


def _words(text: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of sequences joined by spaces, and the offsets of the sequences."""
    lists = pc.split_pattern(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def _met_again(codes: np.ndarray, offsets: np.ndarray, n_words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, sizes)``: the stretches of ``length`` words or more, in word places, of windows whose hash the sequences hold twice."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = (np.arange(1, n_words + 1, dtype=np.uint64) * _MIX) ^ (np.arange(1, n_words + 1, dtype=np.uint64) * _MIX2 >> np.uint64(17))
    n = len(codes) - length + 1
    gram = np.zeros(n, np.uint64)
    for i in range(length):
        gram = gram * _MIX + name[codes[i : n + i]]
        gram ^= gram >> np.uint64(29)
    at = ranges(offsets[:-1], windows)
    _, place, times = np.unique(gram[at], return_inverse=True, return_counts=True)
    again = times[place] > 1
    text = np.repeat(np.arange(len(windows)), windows)
    begin, end = again.copy(), again.copy()
    begin[1:] &= ~again[:-1] | (text[1:] != text[:-1])
    end[:-1] &= ~again[1:] | (text[1:] != text[:-1])
    starts = at[begin]
    return starts, at[end] - starts + length


def _earlier(reference: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, a, b)``: the words of the passages of ``reference`` (sorted by ``first``) that others, first in earlier
    documents, hold in windows of ``length``. Windows whose hash comes once cannot repeat; the automaton decides the rest."""
    words, offsets = _words(reference.column("text"))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    starts, sizes = _met_again(codes, offsets, len(coded.dictionary), length)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    row = np.searchsorted(offsets, starts, side="right") - 1
    rank = np.unique(reference.column("first").to_numpy(), return_inverse=True)[1][row]
    codes, cuts = codes[ranges(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])
    each, at = codes.tolist(), cuts.tolist()
    made = Automaton()
    for i, r in enumerate(rank.tolist()):
        made.add(each[at[i] : at[i + 1]], r)
    covered = Matcher.of(made, len(coded.dictionary)).statistics(codes, cuts, rank) >= length
    begin, end = covered.copy(), covered.copy()
    begin[1:] &= ~covered[:-1]  # no end is within the first words of a stretch, so runs stay inside stretches
    end[:-1] &= ~covered[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    own = np.searchsorted(cuts, a, side="right") - 1
    shift = starts[own] - offsets[row[own]] - cuts[own]
    return row[own], a - length + 1 + shift, b + 1 + shift


def _streamed(reference: pa.Table, passages: pa.Table, length: int) -> pa.Table:
    """``(doc_id, t, a, b)``: the words of passages that documents before theirs hold in windows of ``length``.

    ``reference`` is a shard ``(first, text)`` with every different text of ``passages``: the first of equal passages
    stands for the others. In later documents they go whole; in its own, as the automaton of the shard says.
    """
    ids = passages.schema.field("doc_id").type
    out = {"doc_id": pa.array([], ids), "t": pa.array([], pa.int64()), "a": [], "b": []}
    if reference.num_rows and passages.num_rows:
        reference, passages = reference.sort_by("first").combine_chunks(), passages.combine_chunks()
        texts = reference.column("text").combine_chunks()
        same = pc.index_in(passages.column("text"), value_set=texts)
        if same.null_count:
            raise ValueError("the reference lacks a passage that streams against it")
        later = pc.less(reference.column("first").take(same), passages.column("doc_id")).to_numpy()
        same, s0 = same.to_numpy().astype(np.int64), passages.column("s0").to_numpy().astype(np.int64)
        size = pc.count_substring(texts, " ").to_numpy().astype(np.int64) + 1
        whole, part = np.flatnonzero(later), np.flatnonzero(~later)
        row, a, b = _earlier(reference, length)  # rows ascend
        many = np.searchsorted(row, same[part], side="right") - np.searchsorted(row, same[part])
        at, own = ranges(np.searchsorted(row, same[part]), many), np.repeat(part, many)
        rows = pa.array(np.concatenate([whole, own]))
        out = {"doc_id": passages.column("doc_id").take(rows), "t": passages.column("t").take(rows), "a": np.concatenate([s0[whole], s0[own] + a[at]]), "b": np.concatenate([s0[whole] + size[same[whole]], s0[own] + b[at]])}
    return pa.table({"doc_id": out["doc_id"], "t": out["t"], "a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64())})


def _by_window(pieces: DataFrame, length: int) -> DataFrame:
    """Every window of the passages as a passage of its own, under a key of its own."""
    at = F.explode(F.sequence(F.lit(0), F.col("w") - length))
    out = pieces.withColumn("_words", F.split("text", " ")).withColumn("_i", at).withColumn("text", F.array_join(F.slice("_words", F.col("_i") + 1, length), " "))
    if "s0" in pieces.columns:
        out = out.withColumn("s0", F.col("s0") + F.col("_i"))
    return out.withColumn("h", F.xxhash64("text")).withColumn("w", F.lit(length)).drop("_words", "_i")


def repeated_spans(docs: DataFrame, *, length: int = 13, k: int = 6, wide: int = 1024, hot: int = 4096, shard_words: int = 1 << 17) -> DataFrame:
    """``(doc_id, t, a, b)``: word ranges to remove, possibly overlapping. ``t`` tells rows that repeat an id apart (see :func:`_row`)."""
    with scratch(docs.sparkSession) as keep:
        return keep(_spans(_passages(_row(docs.select("doc_id", "text")), length, min(k, length)), length, wide, hot, shard_words))


def _row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``t``: a hash of the text where ids repeat, else 0."""
    repeat = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.withColumn("t", F.xxhash64("text") if repeat else F.lit(0).cast("long"))


def _passages(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``(h, doc_id, t, s0, text, w)``: the passages around anchors ``h`` that two documents hold; ``w`` words from word ``s0``."""
    given = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "t", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def runs(data, offsets):
        starts, ends, at = word_spans(data, offsets)
        return anchor_runs(word_hashes(data, starts, ends), at, length, k)

    def holders(batches):
        for part, data, offsets in steps(batches, most=_STEP):
            text, _, _, h = runs(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(pa.array(text))], ["h", "doc_id"])

    def places(batches):
        for part, data, offsets in steps(batches, most=_STEP):
            text, first, n, h = runs(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(h), *[part.column(c).take(pa.array(text)) for c in ("doc_id", "t")], pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "doc_id", "t", "s0", "n"])

    def passages(batches):
        for part, data, offsets in steps(batches, most=_STEP):
            starts, ends, at = word_spans(data, offsets)
            lists = part.column("at")
            many = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            text = np.repeat(np.arange(part.num_rows), many)
            s0, w = flat.field("s0").to_numpy(), flat.field("n").to_numpy() + length - 1
            clean, begin = joined_words(data, starts, ends)
            a = at[text] + s0
            left, right = begin[a], begin[a + w] - 1
            cuts = np.concatenate([[0], np.cumsum(right - left)]).astype(np.int32)
            own = pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(cuts), pa.py_buffer(clean[ranges(left, right - left)])])
            yield pa.RecordBatch.from_arrays([flat.field("h"), *[part.column(c).take(pa.array(text)) for c in ("doc_id", "t")], pa.array(s0), own, pa.array(w)], ["h", "doc_id", "t", "s0", "text", "w"])

    with scratch(docs.sparkSession) as keep:
        often = given.select("doc_id", "text").mapInArrow(holders, f"h long, doc_id {kind}").groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        often = stored(often.where("lo <> hi").select("h"), free=True)
        at = given.mapInArrow(places, f"h long, doc_id {kind}, t long, s0 int, n int").join(often.hint("shuffle_hash"), "h")
        per_text = stored(at.groupBy("doc_id", "t").agg(F.collect_set(F.struct("h", "s0", "n")).alias("at")), free=True)
        found = given.join(per_text, ["doc_id", "t"]).select("doc_id", "t", "text", "at").mapInArrow(passages, f"h long, doc_id {kind}, t long, s0 int, text string, w int")
        return keep(found)


def _spans(pieces: DataFrame, length: int, wide: int, hot: int, shard_words: int) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()
    release(pieces.sparkSession)
    known = stored(pieces.groupBy("h", "text", "w").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), free=True)

    # anchors that need more than their place in a shard: (h, apart) go window by window, the others have several tasks
    odd = known.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n_all")).where((F.col("kinds") > wide) | (F.col("n_all") > hot))
    odd = stored(odd.select("h", (F.col("kinds") > wide).alias("apart"), F.ceil(F.col("n_all") / hot).cast("int").alias("salts")))
    known, pieces = (x.join(odd, "h", "left").withColumns({"apart": F.coalesce("apart", F.lit(False)), "salts": F.coalesce("salts", F.lit(1))}) for x in (known, pieces))
    single = stored(_by_window(known.where("apart"), length).groupBy("h", "text", "w").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    often_single = single.groupBy("h").agg(F.sum("n").alias("n_all")).where(F.col("n_all") > hot).select("h", F.ceil(F.col("n_all") / hot).cast("int").alias("salts"))
    often_single = stored(often_single)
    salted = lambda x: x.join(often_single, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    known = known.where("NOT apart").select("h", "salts", "first", "text", "w").unionByName(salted(single).select("h", "salts", "first", "text", "w"))
    pieces = pieces.where("NOT apart").select("h", "salts", "doc_id", "t", "s0", "text").unionByName(salted(_by_window(pieces.where("apart").drop("salts"), length)).select("h", "salts", "doc_id", "t", "s0", "text"))

    many = max(partitions(pieces), -(-(known.agg(F.sum("w")).first()[0] or 0) // shard_words))
    shard = F.when(F.col("salts") > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(many))).alias("shard")
    sent = known.select(shard, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "first", "text")
    dealt = pieces.select(shard, F.pmod(F.xxhash64("doc_id", "t"), F.col("salts")).cast("int").alias("salt"), "doc_id", "t", "s0", "text")
    by = ("shard", "salt")
    return sent.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda x, y: _streamed(x, y, length), f"doc_id {kind}, t long, a long, b long")


def _cleaned(docs: DataFrame, found: DataFrame, make, schema, carry: list[str]) -> DataFrame:
    """``make(part, data, starts, ends, word offsets, kept words)`` over every text with its spans merged."""
    tell, key, first, last = unused(docs, "_t", "_key", "_a", "_b")
    per_text = found.groupBy(F.col("doc_id").alias(key), F.col("t").alias(tell)).agg(F.collect_list("a").alias(first), F.collect_list("b").alias(last))
    same = (F.col("doc_id") == F.col(key)) & ((F.col(tell) == 0) | (F.col(tell) == F.xxhash64("text")))
    joined = docs.join(per_text, same, "left").select(*[F.col(f"`{c}`") for c in carry], first, last)

    def run(batches):
        for part, data, offsets in steps(batches, most=_STEP):
            starts, ends, at = word_spans(data, offsets)
            a, b = part.column(first), part.column(last)
            base = np.repeat(at[:-1], np.diff(np.asarray(a.offsets)))  # a null list is empty
            level = np.zeros(len(starts) + 1, np.int64)
            np.add.at(level, base + a.flatten().to_numpy(), 1)
            np.add.at(level, base + b.flatten().to_numpy(), -1)
            yield make(part, data, starts, ends, at, np.cumsum(level)[:-1] == 0)

    return joined.mapInArrow(run, schema)


def _kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[bytes, list[int], np.ndarray]:
    """``(bytes, cuts, kept words before each text)``: kept words joined by one space; text ``i`` is ``[cuts[i], cuts[i + 1] - 1)``."""
    before = np.concatenate([[0], np.cumsum(kept)])[at]
    left, begin = joined_words(data, starts[kept], ends[kept])
    return left.tobytes(), begin[before].tolist(), before


def removal_report(docs: DataFrame, *, length: int = 13, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def make(part, data, starts, ends, at, kept):
        left, cuts, before = _kept_text(data, starts, ends, at, kept)
        sha = [hashlib.sha256(left[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = np.diff(at)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(before)), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _cleaned(given, repeated_spans(given, length=length, **options), make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", ["doc_id", "text"])


def deduplicate(docs: DataFrame, *, length: int = 13, **options) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``; texts that lose words have the rest joined by one space."""
    names = docs.columns

    def make(part, data, starts, ends, at, kept):
        left, cuts, before = _kept_text(data, starts, ends, at, kept)
        same = (np.diff(before) == np.diff(at)).tolist()
        given = part.column("text").to_pylist()
        text = [old if whole or old is None else left[a : max(a, b - 1)].decode() for old, whole, a, b in zip(given, same, cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(text, part.column("text").type) if c == "text" else part.column(c) for c in names], names)

    return _cleaned(docs, repeated_spans(docs, length=length, **options), make, docs.schema, names)
