"""SimHash near-duplicates with bit-sliced comparison.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and into shingles of three words joined by
a space, repeats included; fewer words make one shingle, none make fingerprint zero. Bit b of the fingerprint
is 1 if it is set in over half of the XXH64 values (seed 42) of the shingles.

Equal fingerprints are one class from the start, so copies cost a partial aggregate and never meet in a task.
Distinct fingerprints within the radius agree on at least ``blocks - radius`` of ``blocks`` bit blocks
(pigeonhole), which makes the keys that bring candidates together. Inside a bucket bit planes are stored
vertically, 64 fingerprints to a machine word; carry-save counters update 64 distances with a few bitwise
operations, and a word is abandoned once all of its distances exceed the radius. A bucket over
``bucket_rows`` is dealt out as pairs of its parts, so none has to fit one task and none is cut short.
Tasks return spanning links, not all pairs; components come from large-star/small-star rounds.

Tables of up to 16 million fingerprints use wider keys than larger ones; the links are the same.

Defined results: null or blank texts have fingerprint zero, linked like any other; a bit that exactly half of the
shingles set is 0; null ids get component null; rows that repeat an id count as the same document; very long texts are
hashed whole, one to a step; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import partitions, ranges, steps, whole_groups
from dyadspark.operators.checkpoints import cut
from dyadspark.operators.graph import connected_components

_SPREAD = np.array([int.from_bytes(bytes(v >> b & 1 for b in range(8)), "little") for v in range(256)], np.uint64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    words = text.lower().split()
    n = len(words)
    if n <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if n else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    return [hashed(line[a:b], seed) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of the texts."""
    raw = data.tobytes()
    hashes: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    at = offsets.tolist()
    for i in range(len(counts)):
        own = _shingle_hashes(raw[at[i] : at[i + 1]], size, seed)
        counts[i] = len(own)
        hashes += own
    return of_hashes(np.array(hashes, np.uint64), counts)


def of_hashes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts with ``counts`` hashes each, one text after another; a text without any has zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # eight 8-bit counters in a word: sums of up to 255 hashes, then sums of those
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    pieces = -(-counts[full] // 255)
    cuts = np.repeat(starts, pieces) + 255 * ranges(np.zeros(len(full), np.int64), pieces)
    lanes = np.zeros((len(cuts), 8), np.uint64)
    for a in range(0, len(cuts), 256):  # spread hashes take 64 bytes each: some 65,000 at a time
        end = cuts[a + 256] if a + 256 < len(cuts) else len(h)
        lanes[a : a + 256] = np.add.reduceat(_SPREAD[h[cuts[a] : end].view(np.uint8).reshape(-1, 8)], cuts[a : a + 256] - cuts[a], axis=0)
    piece_of = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    sums = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).astype(np.int64), piece_of, axis=0)
    bits = (2 * sums > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, *, size: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, data, offsets in steps(batches):
            fps = fingerprint_batch(data, offsets, size, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return given.mapInArrow(run, f"doc_id {kind}, fp long")


class _Links:
    """Smallest linked member of each member, under links that come in blocks."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.low[a], self.low[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.low, np.maximum(x, y), np.minimum(x, y))
            while (self.low[self.low] != self.low).any():
                self.low = self.low[self.low]


def bit_sliced_links(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, chunk: int = 1 << 18) -> np.ndarray:
    """For members sorted by bucket: the index of the first member each is linked to, directly or not."""
    links = _Links(len(fps))
    for x, y in bit_sliced_pairs(fps, bucket, side, radius, chunk):
        links.add(x, y)
    return links.low


def bit_sliced_pairs(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, chunk: int = 1 << 18):
    """Blocks of ``(x, y)``, ``x < y``: members sorted by bucket that share one and are within the radius.

    ``side`` is 0 for members that meet all of their bucket; 1 and 2 for parts that meet only each other.
    """
    n = len(fps)
    if not n:
        return
    new = np.ones(n, bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    words = -(-size // 64)
    word0 = np.concatenate([[0], np.cumsum(words)])
    group = np.cumsum(new) - 1
    place = np.arange(n) - first[group]
    word_of = word0[group] + place // 64
    # bit planes: planes[b][w] has bit b of the 64 members of word w
    planes = np.zeros((64, word0[-1]), np.uint64)
    slot = np.uint64(1) << (place % 64).astype(np.uint64)
    live = np.zeros(word0[-1], np.uint64)
    np.bitwise_or.at(live, word_of, slot)
    for b in range(64):
        on = (fps >> np.uint64(b)) & np.uint64(1) == 1
        np.bitwise_or.at(planes[b], word_of[on], slot[on])
    member_of = np.full((int(word0[-1]), 64), -1, np.int64)
    member_of[word_of, place % 64] = np.arange(n)

    meets = word0[group + 1] - word_of  # a member meets its own word and the later ones of its bucket
    meets[size[group] < 2] = 0
    ends = np.cumsum(meets)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, side="right")))
        q = np.repeat(np.arange(a, b), meets[a:b])
        w = ranges(word_of[a:b], meets[a:b])
        a = b
        for lo in range(0, len(q), 4 * chunk):
            yield _compare(fps, side, planes, live, member_of, q[lo : lo + 4 * chunk], w[lo : lo + 4 * chunk], radius)


def _compare(fps, side, planes, live, member_of, q, w, radius) -> tuple[np.ndarray, np.ndarray]:
    levels = max(1, (radius + 1).bit_length())
    counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
    over = ~live[w]
    for b in range(64):
        carry = planes[b, w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(b)) & np.uint64(1)))
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            over |= _above(counters, radius)
            keep = over != _ONES
            if not keep.all():
                q, w, over, counters = q[keep], w[keep], over[keep], [c[keep] for c in counters]
            if not len(q):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, bits = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    x, y = q[rows], member_of[w[rows], bits]
    ok = (y > x) & ((side[x] == 0) | (side[x] != side[y]))
    return x[ok], y[ok]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the members whose counter is over the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _tables(radius: int, blocks: int) -> list[int]:
    """The bit masks of the keys: every choice of ``blocks - radius`` of the bit blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(pick) for pick in combinations(own, blocks - radius)]


def links(classes: DataFrame, *, radius: int = 2, blocks: int | None = None, bucket_rows: int = 4096) -> DataFrame:
    """Spanning links ``(src, dst)`` between the representatives of distinct fingerprints within the radius.

    ``classes`` has one row ``(fp, rep)`` for each distinct fingerprint. ``blocks`` sets how wide the keys are;
    by default more blocks (more, longer keys) are used from 16 million fingerprints on.
    """
    if blocks is None:
        blocks = radius + 1 if classes.count() <= 1 << 24 else radius + 4
    masks = [m - (1 << 64) if m >> 63 else m for m in _tables(radius, blocks)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    dealt = classes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / bucket_rows).cast("int"))
    met = dealt.join(sizes, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # part i of an over-full bucket goes to the meetings (i, j) for every j; both ways round is one meeting
    met = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("fp", "rep", "t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("int").alias("side"))
    kind = classes.schema["rep"].dataType.simpleString()
    met = met.withColumn("bucket", F.xxhash64("t", "key", "i", "j")).select("fp", "rep", "bucket", "side", "t", "key", "i", "j")

    def run(batches):
        for table in whole_groups(batches, ["t", "key", "i", "j"], 8 * bucket_rows):
            table = table.sort_by([("t", "ascending"), ("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
            col = {c: table.column(c).to_numpy() for c in ("fp", "t", "key", "i", "j", "side")}
            bucket = np.zeros(table.num_rows, np.int64)
            bucket[1:] = np.cumsum(np.any([col[c][1:] != col[c][:-1] for c in ("t", "key", "i", "j")], axis=0))
            low = bit_sliced_links(np.ascontiguousarray(col["fp"]).view(np.uint64), bucket, col["side"], radius)
            at = np.flatnonzero(low != np.arange(len(low)))
            reps = table.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(at)), reps.take(pa.array(low[at]))], ["src", "dst"])

    dealt = met.repartition(partitions(classes), "bucket").sortWithinPartitions("t", "key", "i", "j")
    return dealt.mapInArrow(run, f"src {kind}, dst {kind}")


def near_duplicates(docs: DataFrame, *, radius: int = 2, size: int = 3, seed: int = 42, blocks: int | None = None, bucket_rows: int = 4096) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is the smallest id reachable by links."""
    own = cut(fingerprints(docs, size=size, seed=seed))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    same = connected_components(links(classes.where("rep IS NOT NULL"), radius=radius, blocks=blocks, bucket_rows=bucket_rows))
    named = classes.join(same, classes.rep == same.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; null ids stay."""
    kept = near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
