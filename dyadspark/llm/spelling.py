"""Spelling variants: words one edit apart, by a trie over letter counts.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z in lower case. A run whose ``crc32("<doc_id>:<run>")`` is divisible
by ``every`` loses one code point, the one at that number modulo its length: a stated sample of slips of the pen.

1. Runs are found and counted as byte arrays in the tasks; equal words are summed there before any row is shuffled.
2. A word's letters fall into 32 groups (code point modulo 32); its length and the counts of the groups, one after another,
   are its path in a trie. Two words one edit apart differ by a surplus of one in one group at most and a deficit of one
   in one group at most: the longer one has a surplus only, and of two as long one has the surplus first.
3. Length and the first ``depth`` counts are the trie's upper levels and part the words into subtrees. A word visits its own
   subtree and those that its budget leads to, as far as there are any. In a subtree the search goes down depth first
   with all words that visit it, each with what it has spent; words over their budget drop out. Nodes of few words are
   leaves, and what arrives there is verified letter by letter. A subtree with many words or visitors is dealt to
   several tasks, each with a part of the words and a lot of the visitors.
4. Both words of a pair count it, so what a word finds and where it is found are summed up; forms are followed to their last by doubling, which ends because the count grows by
   ``factor`` or more with each step.

Defined results: a null text has no words; a null id is spelled as an empty string in the hash; rows that repeat count
each time; very long texts and runs are read whole; ties between near words of equal count go to the smallest in code
point order; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import ranges, spans, steps
from dyadspark.operators.checkpoints import scratch, stored

_GROUPS = 32
#: Groups are code points modulo 32; those of the commonest letters of European languages are the trie's first levels.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
_LEVEL = np.empty(_GROUPS, np.int64)
_LEVEL[[ord(c) % _GROUPS for c in _COMMON] + sorted(set(range(_GROUPS)) - {ord(c) % _GROUPS for c in _COMMON})] = np.arange(_GROUPS)
_STEP = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: The first byte of U+00C0 to U+00FF in UTF-8, and of no other code point.
_LEAD = 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> 1), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray, short: int = 48) -> np.ndarray:
    """crc32 of ``data[starts[i]:ends[i]]``, each continued from ``begun[i]``; byte by byte for all runs at once."""
    size = ends - starts
    state = begun ^ np.uint32(0xFFFFFFFF)
    rows = np.flatnonzero(size <= short)
    j = 0
    while len(rows):
        s = state[rows]
        state[rows] = _CRC[(s ^ data[starts[rows] + j]) & 0xFF] ^ (s >> np.uint32(8))
        j += 1
        rows = rows[size[rows] > j]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > short).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, ids: list[str], shortest: int, every: int) -> pa.Array:
    """The words of at least ``shortest`` code points in the texts, as often as they occur."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, at = spans(inside, offsets)
    data = _LOWER[data]
    points = (ends - starts) - np.diff(np.concatenate([[0], np.cumsum(lead)])[np.stack([starts, ends])], axis=0)[0] if len(starts) else np.zeros(0, np.int64)
    long = points >= shortest  # a run that loses a code point needs one more, which is asked below
    text = np.repeat(np.arange(len(ids)), np.diff(at))[long]
    starts, ends, points = starts[long], ends[long], points[long]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc32_of(data, starts, ends, begun[text])
    slip = h % every == 0
    slipped = []
    for i in np.flatnonzero(slip & (points > shortest)).tolist():
        run = data[starts[i] : ends[i]].tobytes().decode()
        gone = int(h[i]) % len(run)
        slipped.append(run[:gone] + run[gone + 1 :])
    starts, size = starts[~slip], (ends - starts)[~slip]
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(data[ranges(starts, size)])])
    return pa.concat_arrays([plain, pa.array(slipped, pa.string())])


def counts(docs: DataFrame, *, shortest: int = 6, fewest: int = 5, every: int = 199, most_held: int = 1 << 19) -> DataFrame:
    """``(word, n)`` of the words with ``fewest`` occurrences or more."""

    def run(batches):
        held = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for part, data, offsets in steps(batches, most=_STEP):
            found = words_of(data, offsets, part.column("id").to_pylist(), shortest, every).value_counts()
            new = pa.table({"word": found.field("values"), "n": found.field("counts")})
            held = pa.concat_tables([held, new])
            if held.num_rows > most_held:
                held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > most_held // 2:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    given = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and the offsets of the words; every one is under 256."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy())]).astype(np.int64)


def paths_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each word: its length, and its number of letters of each group."""
    n, size = len(offsets) - 1, np.diff(offsets)
    word = np.repeat(np.arange(n), size)
    counts = np.bincount(word * _GROUPS + _LEVEL[flat % _GROUPS], minlength=n * _GROUPS).reshape(n, _GROUPS)
    return np.concatenate([size[:, None], counts], axis=1).astype(np.int32)


class Trie:
    """Words in the order of their paths; a node is a range of words whose paths agree so far."""

    def __init__(self, words: pa.Array):
        self.flat, self.offsets = code_points(words)
        paths = paths_of(self.flat, self.offsets)
        self.order = np.lexsort(paths.T[::-1])
        self.paths = paths[self.order]
        self.visited = 0  # nodes, for tests

    def search(self, words: pa.Array, few: int = 24, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)``: every pair one edit apart whose word is longer, or as long with its first difference in
        counts a surplus, or with equal counts. So of two near words one finds the other, or with equal counts both do."""
        flat, offsets = code_points(words)
        asked = paths_of(flat, offsets)
        out_q, out_w, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        found_q, found_w = [], []

        def verify():
            if out_q:
                q, w = np.concatenate(out_q), np.concatenate(out_w)
                fine = one_edit(flat, offsets, q, self.flat, self.offsets, w)
                found_q.append(q[fine])
                found_w.append(w[fine])
                out_q.clear()
                out_w.clear()

        # spent: 0 nothing, 1 a surplus, 2 a surplus and after it a deficit; a longer word has its surplus to spend only
        stack = [(1, lo, hi, np.flatnonzero(fit), np.zeros(int(fit.sum()), np.int8), longer) for lo, hi, size in self._children(0, 0, len(self.paths)) for longer in (False, True) for fit in [asked[:, 0] == size - longer] if fit.any()]
        while stack:
            level, lo, hi, who, spent, longer = stack.pop()
            self.visited += 1
            if hi - lo <= few or level == self.paths.shape[1]:
                rows = self.order[lo:hi]
                for a in range(0, len(who), max(1, chunk // (hi - lo))):
                    some = who[a : a + max(1, chunk // (hi - lo))]
                    out_q.append(np.repeat(some, hi - lo))
                    out_w.append(np.tile(rows, len(some)))
                    held += len(out_q[-1])
                    if held >= chunk:
                        verify()
                        held = 0
                continue
            wanted = asked[who, level]
            for a, b, size in self._children(level, lo, hi):
                over = size - wanted
                alive = np.flatnonzero((over == 0) | ((over == 1) & (spent == 0)) | ((over == -1) & (spent == 1) & (not longer)))
                if len(alive):
                    stack.append((level + 1, a, b, who[alive], spent[alive] + (over[alive] != 0), longer))
        verify()
        q, w = np.concatenate(found_q), np.concatenate(found_w)
        # small nodes are verified whole: pairs that the order of the budget leaves to the other side go
        diff = np.zeros(len(q), np.int64)
        at = np.empty(len(self.order), np.int64)
        at[self.order] = np.arange(len(self.order))
        for a in range(0, len(q), chunk):
            d = self.paths[at[w[a : a + chunk]]] - asked[q[a : a + chunk]]
            diff[a : a + chunk] = d[np.arange(len(d)), (d != 0).argmax(axis=1)]
        return q[diff >= 0], w[diff >= 0]

    def _children(self, level: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
        own = self.paths[lo:hi, level]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), hi - lo]
        return [(lo + a, lo + b, int(own[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def one_edit(a_flat: np.ndarray, a_at: np.ndarray, q: np.ndarray, b_flat: np.ndarray, b_at: np.ndarray, w: np.ndarray, cells: int = 1 << 23) -> np.ndarray:
    """Whether one replaced code point parts ``q[i]`` from ``w[i]``, or one more in ``w[i]``; lengths differ by 0 or 1 at most."""
    out = np.zeros(len(q), bool)
    size_a, size_b = np.diff(a_at)[q], np.diff(b_at)[w]
    order = np.argsort(size_b, kind="stable")
    begin = 0
    while begin < len(order):
        width = int(size_b[order[begin]])
        end = begin + int(np.searchsorted(size_b[order[begin:]], width, side="right"))
        end = min(end, begin + max(1, cells // width))
        i = order[begin:end]
        cols = np.arange(width)
        b = b_flat[b_at[w[i]][:, None] + cols]
        for longer in (False, True):
            own = np.flatnonzero(size_a[i] == width - longer)
            if not len(own):
                continue
            a = a_flat[a_at[q[i[own]]][:, None] + cols[: width - longer]]
            if longer:
                ahead = np.logical_and.accumulate(a == b[own, :-1], axis=1)
                behind = np.logical_and.accumulate((a == b[own, 1:])[:, ::-1], axis=1)
                out[i[own]] = ahead.sum(axis=1) + behind.sum(axis=1) >= width - 1
            else:
                out[i[own]] = (a != b[own]).sum(axis=1) == 1
        begin = end
    return out


def near_words(words: DataFrame, *, depth: int = 4, most_words: int = 8192, most_visitors: int = 1 << 16) -> DataFrame:
    """``(word, n_near, best)`` of the words ``(word, n)`` that have near words; ``best`` is ``(n, word)`` of the most frequent."""

    def paths(batches):
        for batch in batches:
            v = paths_of(*code_points(batch.column("word")))[:, : depth + 1]
            at = np.arange(0, v.size + 1, depth + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.ListArray.from_arrays(at, pa.array(v.ravel(), pa.int32()))], ["word", "n", "path"])

    own = stored(words.select("word", "n").mapInArrow(paths, "word string, n long, path array<int>"))
    # a word's own path, and those that its budget leads to: a surplus, then a deficit, or one letter more
    levels = range(1, depth + 1)
    moves = [{}, *({i: 1} for i in levels), *({i: 1, j: -1} for i in levels for j in levels if j > i), {0: 1}, *({0: 1, i: 1} for i in levels)]
    moved = F.array(*[F.array(*[F.col("path")[g] + m.get(g, 0) for g in range(depth + 1)]) for m in moves])
    sizes = own.groupBy("path").agg(F.count("*").alias("n_words"))
    visitors = own.groupBy("path").agg(F.count("*").alias("n")).select(F.explode(moved).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n_visitors"))
    subtrees = stored(sizes.join(visitors, "path").select("path", F.ceil(F.col("n_words") / most_words).cast("int").alias("parts"), F.ceil(F.col("n_visitors") / most_visitors).cast("int").alias("lots")))
    place = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = own.join(subtrees, "path").withColumn("part", place("parts")).withColumn("lot", every("lots"))
    asking = own.select(F.col("word").alias("word"), F.col("n").alias("n"), F.explode(moved).alias("path")).join(subtrees, "path").withColumn("lot", place("lots")).withColumn("part", every("parts"))

    def searched(held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
        if not held.num_rows or not asked.num_rows:
            return empty
        w, q = held.combine_chunks(), asked.combine_chunks()
        trie = Trie(w.column("word").combine_chunks())
        i, j = trie.search(q.column("word").combine_chunks())
        ordered = (paths_of(trie.flat, trie.offsets)[j] != paths_of(*code_points(q.column("word").combine_chunks()))[i]).any(axis=1) if len(i) else np.zeros(0, bool)
        a, b = q.take(pa.array(i)), w.take(pa.array(j))
        back = pa.array(ordered)  # words of equal counts find each other; of others only one finds
        pairs = pa.table({c: pa.concat_arrays([x.combine_chunks(), y.filter(back).combine_chunks()]) for c, x, y in (("word", a.column("word"), b.column("word")), ("n", b.column("n"), a.column("n")), ("near", b.column("word"), a.column("word")))})
        pairs = pairs.sort_by([("word", "ascending"), ("n", "descending"), ("near", "ascending")])
        return pairs.group_by("word", use_threads=False).aggregate([("near", "count"), ("n", "first"), ("near", "first")]).rename_columns(["word", "n_near", "n", "near"]).cast(empty.schema)

    by = ("path", "part", "lot")
    found = dealt.select(*by, "word", "n").groupBy(*by).cogroup(asking.select(*by, "word", "n").groupBy(*by)).applyInArrow(searched, "word string, n_near long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every ``(word, form)``: forms are followed to the last, twice as far in each round."""
    here = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = here.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(here.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        here = after.drop("moved")
        if after.where("moved").isEmpty():
            return here


def variants(docs: DataFrame, *, shortest: int = 6, fewest: int = 5, every: int = 199, factor: int = 5, **options) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    with scratch(docs.sparkSession) as keep:
        words = stored(counts(docs, shortest=shortest, fewest=fewest, every=every))
        found = words.join(near_words(words, **options), "word", "left")
        follows = F.col("best.n") >= factor * F.col("n")
        found = stored(found.select("word", F.when(follows, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.n")).alias("form_n")))
        ends = roots(found.where("form IS NOT NULL"))
        return keep(found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
