"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model reads UTF-8 bytes, ``order`` at a time. Texts are packed and dealt out in blocks of bounded size. A block
counts the n-grams of its trusted texts, and asks for every n-gram that it holds, once each. Counts meet by n-gram;
lower orders hold continuation counts (distinct n-grams that end in them), and the discounts for counts one, two, and
three or more follow from the counts of counts. Questions and counts are sharded by the two bytes before the last one,
which every order from three on has in common with its shorter orders and its contexts: a shard holds all that its
questions need but the tables of orders one and two, which the alphabet bounds and every task gets. A shard
interpolates the probabilities of each block's questions, and the answers go back to the blocks, which sum them over
every whole text. Questions and answers travel as packed arrays. So a task holds the n-grams of its own block or shard
and never the model, which grows with the trusted text.

The perplexity of a text is ``exp(-mean log p)`` over its bytes. Trusted documents of fold ``out`` (crc32 of the id,
modulo ``mod``) are not trained on; the quantile of their perplexities, for each language, is the threshold over which
texts are rejected (over all of them where a language has fewer than ``least``; over all trusted texts if none is held
out).

Defined results: a null or empty text has no perplexity and is not kept; without any trusted text nothing has a
perplexity or is kept; null ids and languages are allowed (null languages are judged by the common quantile); rows
that repeat an id are judged each by its own text, and are all trusted if the id is; a text at the threshold is kept;
very long texts are scored whole; one row out for every row in; an empty table gives an empty result; other columns,
whatever their names, are ignored. Up to 2,000 blocks each is a partition of its own; the rows are the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dyadspark.llm._common import fold, partitions, steps
from dyadspark.operators.checkpoints import cut, scratch, stored

#: Stands before the first byte of a text; never part of UTF-8.
_START = 0xFF


#: Bytes of text that one step handles here.
_STEP = 2 << 20


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte the number made of it and the ``order - 1`` bytes before it in its text."""
    before = order - 1
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + before * np.repeat(np.arange(1, len(sizes) + 1), sizes)  # every text with its starts in front
    padded = np.full(len(data) + before * len(sizes), _START, np.uint8)
    padded[at] = data
    n = len(padded) - before
    out = padded[:n].astype(np.int64) if n > 0 else np.zeros(0, np.int64)
    for j in range(1, order):
        out <<= 8
        out |= padded[j : j + n]
    return out[at - before] if before else out


class _Places:
    """Where numbers stand in a sorted array that holds them all: two tables by hashes, then a search."""

    def __init__(self, g: np.ndarray):
        self.g = g
        self.bits = max(4, int(len(g) * 2).bit_length())
        self.tables = []
        left = np.arange(len(g), dtype=np.int32)
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slot = self._slot(g[left], mult)
            table = np.zeros(1 << self.bits, np.int32)
            table[slot] = left
            self.tables.append((mult, table))
            left = left[table[slot] != left]

    def _slot(self, x: np.ndarray, mult: int) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(mult) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        out = self.tables[0][1][self._slot(x, self.tables[0][0])]
        miss = np.flatnonzero(self.g[out] != x)
        out[miss] = self.tables[1][1][self._slot(x[miss], self.tables[1][0])]
        miss = miss[self.g[out[miss]] != x[miss]]
        out[miss] = np.searchsorted(self.g, x[miss])
        return out


def _shard_of(g: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram, from the two bytes before its last one."""
    return ((g >> 8 & 0xFFFF) * 40503 & 0xFFFF) % shards


def _shard(g: Column, shards: int) -> Column:
    two = F.shiftright(g, 8).bitwiseAND(F.lit(0xFFFF))
    return ((two * 40503).bitwiseAND(F.lit(0xFFFF)) % shards).cast("int")


def _pressed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _spread(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Counts:
    """Counts of one order as sorted arrays, with the totals and counts of counts of their contexts."""

    def __init__(self, g: np.ndarray, c: np.ndarray, discounts: tuple[float, float, float]):
        by = np.argsort(g)
        self.g, self.c, self.discounts = g[by], c[by].astype(np.float64), np.array([0.0, *discounts])
        first = np.flatnonzero(np.concatenate([[True], np.diff(self.g >> 8) != 0])) if len(g) else np.zeros(0, np.int64)
        self.head = self.g[first] >> 8
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x
        self.all = sums(self.c)
        self.less = sums(self.discounts[np.minimum(self.c, 3).astype(np.int64)])

    def interpolate(self, low: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """The probability of this order where the context is known, from that of the order below."""
        if not len(self.g):
            return prob
        at = np.minimum(np.searchsorted(self.head, low >> 8), len(self.head) - 1)
        known = self.head[at] == low >> 8
        own = np.minimum(np.searchsorted(self.g, low), len(self.g) - 1)
        c = np.where(self.g[own] == low, self.c[own], 0.0)
        p = (c - self.discounts[np.minimum(c, 3).astype(np.int64)] + self.less[at] * prob) / self.all[at]
        return np.where(known, p, prob)


class KneserNey:
    """Counts of every order as tables, their discounts, and the two lowest orders as arrays."""

    def __init__(self, counted: DataFrame, order: int):
        self.order = order
        self.counts = {order: counted}
        for n in range(order - 1, 0, -1):
            low = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
            self.counts[n] = cut(self.counts[n + 1].groupBy(low.alias("g")).agg(F.count("*").alias("c")))
        seen = reduce(DataFrame.unionByName, [t.where("c <= 4").groupBy("c").count().withColumn("n", F.lit(n)) for n, t in self.counts.items()])
        of = {(r.n, r.c): r["count"] for r in seen.collect()}  # four numbers for each order
        self.discounts = {n: self._discounts([of.get((n, i), 0) for i in (1, 2, 3, 4)]) for n in self.counts}
        self.small = {n: self._arrays(n) for n in (1, 2) if n <= order}  # 256 and 65,536 rows at most

    def _arrays(self, n: int) -> Counts:
        rows = self.counts[n].toPandas()
        return Counts(rows["g"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), self.discounts[n])

    @staticmethod
    def _discounts(n: list[int]) -> tuple[float, float, float]:
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.0 for i in range(3)]
        return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate(found))

    def answers(self, asked: DataFrame, shards: int) -> DataFrame:
        """``(block, shard, p)`` for ``(block, shard, g)``: log probabilities of the last bytes, in the order of the questions."""
        order, discounts = self.order, self.discounts
        small = asked.sparkSession.sparkContext.broadcast(self.small)
        large = [t.select(_shard(F.col("g"), shards).alias("shard"), F.lit(n).alias("n"), "g", "c") for n, t in self.counts.items() if n > 2]
        model = reduce(DataFrame.unionByName, large) if large else asked.limit(0).select("shard", F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("c"))

        def run(key, questions, counts):
            n_, g_, c_ = (counts.column(c).to_numpy() for c in ("n", "g", "c"))
            tables = [small.value[n] if n < 3 else Counts(g_[n_ == n], c_[n_ == n], discounts[n]) for n in range(1, order + 1)]
            out = []
            for data in questions.column("g").to_pylist():
                g = np.cumsum(_spread(data, np.int64))
                prob = np.full(len(g), 1 / 256)
                for n, table in enumerate(tables, 1):
                    prob = table.interpolate(g & np.int64((1 << 8 * n) - 1), prob)
                out.append(_pressed(np.log(np.maximum(prob, 1e-12)).astype(np.float32)))
            return pa.table({"block": questions.column("block"), "shard": questions.column("shard"), "p": pa.array(out, pa.binary())})

        return asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(run, "block int, shard int, p binary")


def _even_keys(spark: SparkSession, blocks: int) -> list[int]:
    """One key for each partition: hash partitioning by them puts every block into a partition of its own."""
    where = F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks)).alias("p")
    rows = spark.range(0, 40 * blocks + 100, numPartitions=1).select("id", where).groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()
    found = [r.id for r in rows]
    return found if len(found) == blocks else list(range(blocks))


def _packed(docs: DataFrame, block: Column) -> DataFrame:
    """``(block, data)``: rows of ``docs``, compressed together, a few for each block and task."""
    given = docs.withColumn("block", block)
    names = docs.columns

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}
        press = zstandard.ZstdCompressor(level=3)

        def pack(b):
            table = pa.Table.from_batches(held.pop(b)).combine_chunks()
            size.pop(b)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "data"])

        for batch in batches:
            where = batch.column("block").to_numpy()
            rows = batch.select(names)
            order = np.argsort(where, kind="stable")
            found, starts = np.unique(where[order], return_index=True)
            for b, own_rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                own = rows.take(pa.array(own_rows))
                held.setdefault(b, []).append(own)
                size[b] = size.get(b, 0) + own.nbytes
                if size[b] > 4 << 20:
                    yield pack(b)
            if sum(size.values()) > 64 << 20:
                yield pack(max(size, key=size.get))
        for b in list(held):
            yield pack(b)

    return given.mapInArrow(run, "block int, data binary")


def _unpacked(column):
    """The batches of packed rows, one packed row at a time."""
    for x in column:
        yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_py()))


def _sorted(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of an array, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an array, ascending, and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _merge(heap: list[np.ndarray], own: np.ndarray) -> None:
    """Add a sorted array; two of like length become one, so each number is sorted again only a few times."""
    heap.append(own)
    while len(heap) > 1 and len(heap[-2]) <= 2 * len(heap[-1]):
        heap.append(_sorted(np.concatenate([heap.pop(), heap.pop()])))


def _distinct(parts) -> np.ndarray:
    """All distinct numbers of sorted arrays."""
    heap: list[np.ndarray] = []
    for own in parts:
        _merge(heap, own)
    return _sorted(np.concatenate([np.zeros(0, np.int64), *heap]))


def perplexity(docs: DataFrame, trusted: DataFrame, *, order: int = 6, block_bytes: int = 48 << 20, most_broadcast: int = 2_000_000) -> DataFrame:
    """``(doc_id, lang, n_bytes, perplexity)`` of every row of ``docs``, under a model of the texts whose ids ``trusted`` holds.

    A block holds about ``block_bytes`` of text, however many partitions the session has: what a block asks for, and
    what a task holds, follows from the texts alone. Trusted ids are broadcast if they are counted to be few.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_perplexity(docs, trusted, order, block_bytes, most_broadcast))


def _perplexity(docs: DataFrame, trusted: DataFrame, order: int, block_bytes: int, most_broadcast: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    keys = _even_keys(docs.sparkSession, blocks) if blocks <= 2000 else []
    ids = cut(trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True)))
    flagged = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "doc_id", "left")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")  # rows that share an id, or have none, part by their texts
    block = F.element_at(F.array(*[F.lit(k) for k in keys]), place + 1) if keys else place
    dealt = _packed(flagged, block).repartition(blocks if keys else max(2000, partitions(docs)), "block")
    shards = max(8, 4 * blocks)

    def count_and_ask(batches):
        """Rows ``(g, c)`` of the trusted texts, and rows ``(block, shard, asked)`` of all."""
        asked: dict[int, list[np.ndarray]] = {}
        trained: list[tuple[np.ndarray, np.ndarray]] = []
        nulls = lambda n, to: pa.nulls(n, to)

        def counted():
            g, c = np.concatenate([x for x, _ in trained]), np.concatenate([c for _, c in trained])
            by = np.argsort(g)
            g, c = g[by], c[by]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            g, c = g[first], np.add.reduceat(c, first).astype(np.int64)
            trained.clear()
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), nulls(len(g), pa.int32()), nulls(len(g), pa.int32()), nulls(len(g), pa.binary())], ["g", "c", "block", "shard", "asked"])

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                for part, text, offsets in steps(_unpacked([data]), most=_STEP):
                    known = part.column("trusted").is_valid().to_numpy(zero_copy_only=False)
                    g = grams(text, offsets, order)
                    _merge(asked.setdefault(b, []), _sorted(g))
                    if known.any():
                        trained.append(_tally(g[np.repeat(known, np.diff(offsets))]))
                    if sum(len(x) for x, _ in trained) > 1 << 23:
                        yield counted()
        if trained:
            yield counted()
        for b, parts in asked.items():
            g = _distinct(parts)
            own = _shard_of(g, shards)
            by = np.argsort(own, kind="stable")
            g, own = g[by], own[by]
            first = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0])) if len(g) else np.zeros(0, np.int64)
            data = [_pressed(np.diff(x, prepend=0)) for x in np.split(g, first[1:])] if len(g) else []
            n = len(first)
            yield pa.RecordBatch.from_arrays([nulls(n, pa.int64()), nulls(n, pa.int64()), pa.array(np.full(n, b, np.int32)), pa.array(own[first].astype(np.int32)), pa.array(data, pa.binary())], ["g", "c", "block", "shard", "asked"])

    found = stored(dealt.mapInArrow(count_and_ask, "g long, c long, block int, shard int, asked binary"), free=True)
    counted = stored(found.where("g IS NOT NULL").groupBy("g").agg(F.sum("c").alias("c")))
    model = KneserNey(counted, order)
    answers = stored(model.answers(found.where("block IS NOT NULL").select("block", "shard", F.col("asked").alias("g")), shards), free=True)

    def score(key, texts, table):
        out = {"doc_id": [], "lang": [], "n_bytes": [], "perplexity": []}
        # the same questions in the same order as they were asked
        g = _distinct(_sorted(grams(data, offsets, order)) for _, data, offsets in steps(_unpacked(texts.column("data")), most=_STEP))
        by = np.argsort(_shard_of(g, shards), kind="stable")
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("p").to_pylist(), strict=True))
        p = np.zeros(len(g))
        p[by] = np.concatenate([np.zeros(0, np.float32), *[_spread(x, np.float32) for _, x in rows]])
        places = _Places(g)
        for part, data, offsets in steps(_unpacked(texts.column("data")), most=_STEP):
            size = np.diff(offsets)
            total = np.concatenate([[0.0], np.cumsum(p[places.find(grams(data, offsets, order))])])[offsets] if len(data) else np.zeros(len(offsets))
            with np.errstate(all="ignore"):
                value = np.exp(-np.diff(total) / size)
            out["doc_id"].append(part.column("doc_id"))
            out["lang"].append(part.column("lang"))
            out["n_bytes"].append(size)
            out["perplexity"].append(np.where(size > 0, value, np.nan))
        if not out["doc_id"]:
            return pa.table({"doc_id": pa.array([], id_type), "lang": pa.array([], pa.string()), "n_bytes": pa.array([], pa.int64()), "perplexity": pa.array([], pa.float64())})
        value = np.concatenate(out["perplexity"])
        return pa.table({"doc_id": pa.chunked_array(out["doc_id"]), "lang": pa.chunked_array(out["lang"]), "n_bytes": np.concatenate(out["n_bytes"]), "perplexity": pa.array(value, mask=np.isnan(value))})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, lang string, n_bytes long, perplexity double")


def judge(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, least: int = 50, order: int = 6, mod: int = 5, out: int = 0) -> DataFrame:
    """``(doc_id, n_bytes, perplexity, threshold, kept)`` of every row; ``trusted`` holds the ids to learn from."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    held = fold("doc_id", mod) == out
    scored = perplexity(docs, ids.where(~held), order=order)
    good = scored.join(ids, "doc_id", "left_semi").where("perplexity IS NOT NULL")
    if good.where(held).isEmpty():
        held = F.lit(True)
    at = F.percentile_approx("perplexity", quantile, 10000)
    cuts = cut(good.where(held & F.col("lang").isNotNull()).groupBy("lang").agg(at.alias("own"), F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "own"))
    common = good.where(held).agg(at.alias("common"))
    out_ = scored.join(F.broadcast(cuts) if cuts.count() <= 100_000 else cuts, "lang", "left").join(F.broadcast(common))  # one row
    out_ = out_.withColumn("perplexity", F.when(F.col("common").isNotNull(), F.col("perplexity")))
    limit = F.coalesce("own", "common")
    return out_.select("doc_id", "n_bytes", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
