"""Exact inner-product top-k with an impact-ordered, score-at-a-time index.

Vectors become integers, ``floor(scale * x)``. A block of candidates is parted into cells of near vectors, and each
cell is indexed by impact: every component that is not zero is a posting ``(candidate, quantised value)`` of its
dimension, and a dimension's postings are stored in segments by descending quantised impact. Queries go through the
cells in the order of a bound on their scores (the product with the cell's centre, and the covering radius); a cell
whose bound is under a query's k-th score so far is not opened for it. In a cell, segments are processed from the
largest impact down, each adding ``weight * quantised value`` to the accumulators of its own candidates only. What a
candidate's accumulator still lacks is a known vector (unread components, and what quantising left), so by its length
every score is known up to a bound. Candidates whose upper bound is below the k-th largest lower bound, or the k-th
score so far, are proven out; processing stops once few possible members are left (or nothing is unread), and these
are scored exactly.

Blocks of queries meet blocks of candidates in tasks of bounded size, and each meeting returns k rows for a
query, so the work is spread evenly however many vectors are equal. Vectors without structure (random directions)
leave no bound much to prove, and most segments are read.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors of different
lengths do not meet; a query never meets rows of its own id; ties go to the smaller id, rows that repeat an
id and score are listed once each; a vector so long that scores could pass 64 bits is an error; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.llm._common import bounded, partitions
from dyadspark.operators.checkpoints import cut

_LEVELS = 32
#: Impact levels after which bounds are checked, from the largest down.
_STOPS = (4, 1, 0)


class ImpactIndex:
    """Postings of one cell of integer vectors, dimension by dimension in segments of descending quantised impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        impact = np.abs(vectors)
        top = int(impact.max(initial=0))
        shift = max(0, top.bit_length() - (_LEVELS.bit_length() - 1))
        level = impact >> shift
        half = (1 << shift) // 2
        quantised = np.where(vectors != 0, np.sign(vectors) * ((level << shift) + half), 0)
        self.largest = int(np.abs(quantised).max(initial=0))
        order = np.argsort(-level, axis=0, kind="stable")
        self.postings = []
        for d in range(dims):
            own = order[:, d]
            own = own[vectors[own, d] != 0]
            edges = np.searchsorted(-level[own, d], [-stop for stop in _STOPS], side="right")
            edges[-1] = len(own)
            self.postings.append((own, quantised[own, d], edges))
        # the length of what accumulators lack after each stop
        self.lack = []
        for stop in _STOPS:
            read = (level >= stop) & (vectors != 0)
            self.lack.append(np.sqrt((np.where(read, vectors - quantised, vectors).astype(np.float64) ** 2).sum(axis=1)))
        self.centre = vectors.mean(axis=0) if n else np.zeros(dims)
        self.radius = float(np.sqrt(((vectors - self.centre) ** 2).sum(axis=1)).max(initial=0.0))
        self.touched = 0  # postings added to accumulators, over all queries

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score in the cell is over this."""
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        return (queries @ self.centre + length * self.radius) * (1 + 1e-9) + 1e-3

    def possible(self, queries: np.ndarray, banned: np.ndarray, k: int, bar: np.ndarray, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """``(query, candidate)``: all that may be among the best ``k`` of a query and reach ``bar``; ``banned`` may not meet."""
        n_q, n = banned.shape
        most = self.largest * int(np.abs(queries).max(initial=0)) * queries.shape[1]
        kind = np.int32 if most < 1 << 30 else np.int64
        rows, acc = np.arange(n_q), np.zeros((n, n_q), kind)
        weights = np.ascontiguousarray(queries.T.astype(kind))
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        out_q, out_c = [], []
        for i in range(len(_STOPS)):
            for d, (own, value, edges) in enumerate(self.postings):
                a, b = edges[i - 1] if i else 0, edges[i]
                if b > a:
                    part = acc.take(own[a:b], axis=0)
                    part += value[a:b, None].astype(kind) * weights[d]
                    acc[own[a:b]] = part
                    self.touched += int(b - a) * len(rows)
            slack = np.multiply.outer(self.lack[i], length[rows]) * (1 + 1e-9) + 1e-3
            low = np.where(banned[rows].T, -np.inf, acc - slack)
            own_bar = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(rows), -np.inf)
            maybe = (acc + slack >= np.maximum(own_bar, bar[rows])) & ~banned[rows].T
            done = (maybe.sum(axis=0) <= max(few, 4 * k)) | (i == len(_STOPS) - 1)
            c, q = np.nonzero(maybe[:, done])
            out_q.append(rows[done][q])
            out_c.append(c)
            if done.any():
                rows, acc, weights = rows[~done], np.ascontiguousarray(acc[:, ~done]), np.ascontiguousarray(weights[:, ~done])
            if not len(rows):
                break
        return np.concatenate(out_q), np.concatenate(out_c)


    def search(self, queries: np.ndarray, banned: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, candidate, score)`` of the best ``k`` of this cell for each query."""
        q, c = self.possible(queries, banned, k, np.full(len(queries), -np.inf))
        return _best(q, c, _scores(queries, self.vectors, q, c), ids, k)


def _scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", queries[q[x : x + 65536]], vectors[c[x : x + 65536]]) for x in range(0, len(q), 65536)]])


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with the ``k`` highest scores of each query, in order; ties go to the smaller id."""
    order = np.lexsort((ids[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], c[first], s[first]


class Block:
    """Candidates in cells of about ``cell_rows`` near vectors, at least four cells unless there are few."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, cell_rows: int = 4096):
        n = len(vectors)
        many = max(1, -(-n // cell_rows), min(4, n // 256))
        # heads far from each other, the next one always where the others are farthest
        away, home = np.full(n, np.inf), np.zeros(n, np.int64)
        for c in range(many if n else 0):
            head = vectors[int(away.argmax()) if c else 0]
            d = ((vectors - head) ** 2).sum(axis=1).astype(np.float64)
            home[d < away] = c
            away = np.minimum(away, d)
        self.rows = [np.flatnonzero(home == c) for c in range(many)]
        self.rows = [r for r in self.rows if len(r)]
        self.cells = [ImpactIndex(vectors[r]) for r in self.rows]
        self.vectors, self.ids = vectors, ids

    @property
    def touched(self) -> int:
        return sum(c.touched for c in self.cells)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, batch: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, candidate, score)`` of the best ``k`` for each query, but for rows of its own id."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(queries) or not self.cells:
            return out[0]
        bounds = np.stack([c.bounds(queries) for c in self.cells], axis=1)
        by_home = np.argsort(bounds.argmax(axis=1), kind="stable")  # queries of one neighbourhood go together
        for a in range(0, len(queries), batch):
            own = by_home[a : a + batch]
            q, c, s = out[0]
            bar = np.full(len(own), -np.inf)
            for cell in np.argsort(-bounds[own].mean(axis=0)).tolist():
                some = np.flatnonzero(bounds[own, cell] >= bar)
                if not len(some):
                    continue
                rows = self.rows[cell]
                banned = query_ids[own[some]][:, None] == self.ids[rows][None, :]
                i, j = self.cells[cell].possible(queries[own[some]], banned, k, bar[some])
                i, j = some[i], rows[j]
                score = _scores(queries[own], self.vectors, i, j)
                q, c, s = _best(np.concatenate([q, i]), np.concatenate([c, j]), np.concatenate([s, score]), self.ids, k)
                full = np.flatnonzero(np.bincount(q, minlength=len(own)) == k)
                bar[full] = s[np.searchsorted(q, full, side="right") - 1]
            out.append((own[q], c, s))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every query against all rows."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fine = _usable(vectors).withColumn("embedding", bounded("embedding", scale, vectors.schema["embedding"].dataType))
    own = cut(fine.select("vec_id", whole.alias("v")).withColumn("n", F.size("v")))
    kind = own.schema["vec_id"].dataType.simpleString()
    asked = own.where(is_query)
    parts = own.groupBy("n").agg(F.ceil(F.count("*") / block).cast("int").alias("n_c"), F.ceil(F.sum(is_query.cast("int")) / query_block).cast("int").alias("n_q")).where("n_q > 0")
    place = lambda n, name: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(n)).cast("int")
    meet = lambda df, mine, other, side: df.join(parts, "n").withColumn(mine, place(f"n_{mine}", mine)).withColumn(other, F.explode(F.expr(f"sequence(0, n_{other} - 1)"))).select("n", "c", "q", "vec_id", "v", F.lit(side).alias("side"))
    dealt = meet(own, "c", "q", 0).unionByName(meet(asked, "q", "c", 1))

    def best(key, table):
        side = table.column("side").to_numpy()
        c, q = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out = {"query_id": [], "vec_id": [], "score": []}
        if c.num_rows and q.num_rows:
            c_ids, q_ids = c.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
            i, j, s = Block(_matrix(c.column("v")), c_ids).search(_matrix(q.column("v")), q_ids, k)
            out["query_id"].append(q_ids[i])
            out["vec_id"].append(c_ids[j])
            out["score"].append(s)
        make = lambda name, to: pa.array(np.concatenate(out[name]) if out[name] else [], to)
        to = table.schema.field("vec_id").type
        return pa.table({"query_id": make("query_id", to), "vec_id": make("vec_id", to), "score": make("score", pa.int64())})

    found = dealt.repartition(partitions(own), "n", "c", "q").groupBy("n", "c", "q").applyInArrow(best, f"query_id {kind}, vec_id {kind}, score long")
    rank = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
