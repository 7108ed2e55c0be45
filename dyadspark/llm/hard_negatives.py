"""Hard negatives by coordinate pruning in length buckets.

Vectors become integers, ``floor(scale * x)``, and scores are their inner products. An anchor's positives are its best rows
of the same label; for each of them, the best rows of other labels with a score between ``low`` and ``high`` percent of
the positive's are its hard negatives.

1. Rows of one width and label lie in buckets of about equal length, and a bucket in blocks of bounded size. A block
   keeps for every coordinate its rows in the order of that coordinate of their unit vectors.
2. A score of ``bar`` or more needs a cosine of ``bar / (length * longest)``. By the angles between the vectors that
   leaves a range of feasible values for each coordinate. The ranges of the anchor's focus coordinates, those where its
   unit vector is largest, are looked up in the sorted lists; the rows in all of them are verified exactly.
3. The longest block of every label is searched first and gives each anchor the bars that its best rows there
   set: its fifth positive so far, and for every positive the fifth score inside the band or the band's lower end. Other blocks
   are met only by anchors whose bar their longest row can reach.

Anchors meet blocks in lots of bounded size, so however many rows share a label, no task holds more than a block and a
lot.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of
different widths do not meet; rows of the anchor's own id are no candidates; rows that repeat an id and score are
listed once each; ties go to the smaller id; a negative positive score has no band and so no negatives; zero vectors
score 0; a vector so long that scores could pass 64 bits is an error; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.llm._common import bounded
from dyadspark.operators.checkpoints import scratch, stored

_BLOCK = ("n", "label", "bucket", "part")


class Block:
    """Rows of about equal length with their sorted coordinate lists."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.shortest, self.longest = (float(lengths.min()), float(lengths.max())) if len(ids) else (0.0, 0.0)
        self.units = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.units, self.order, axis=0)
        self.verified = 0  # rows, over all anchors

    def reaching(self, anchor: np.ndarray, bar: float, focus: int) -> np.ndarray:
        """Rows that may score ``bar`` or more; all that do are among them."""
        every = np.arange(len(self.ids))
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        reach = length * (self.longest if bar > 0 else self.shortest)
        if bar == -np.inf or not len(every) or (reach == 0 and bar <= 0):
            return every
        if reach == 0 or bar / reach > 1 + 1e-9:
            return every[:0]
        angle = np.arccos(np.clip(bar / reach, -1.0, 1.0))
        unit = anchor / length
        at = np.argsort(-np.abs(unit))[:focus]
        own = np.arccos(np.clip(unit[at], -1.0, 1.0))
        least, most = np.cos(np.minimum(own + angle, np.pi)) - 1e-7, np.cos(np.maximum(own - angle, 0.0)) + 1e-7
        first = np.array([np.searchsorted(self.sorted[:, d], x, side="left") for d, x in zip(at, least, strict=True)])
        last = np.array([np.searchsorted(self.sorted[:, d], x, side="right") for d, x in zip(at, most, strict=True)])
        if not len(at):
            return every
        tightest = int((last - first).argmin())  # the shortest list is met with the other ranges
        rows = self.order[first[tightest] : last[tightest], at[tightest]]
        own = self.units[rows][:, at]
        return rows[((own >= least) & (own <= most)).all(axis=1)]

    def scores(self, anchor: np.ndarray, anchor_id, bar: float, focus: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of all rows but the anchor's own with ``bar`` or more."""
        rows = self.reaching(anchor, bar, focus)
        self.verified += len(rows)
        s = self.vectors[rows] @ anchor
        fine = (s >= bar) & (self.ids[rows] != anchor_id)
        return self.ids[rows[fine]], s[fine]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _rows(vectors: DataFrame, is_anchor: Column, scale: int, block: int) -> DataFrame:
    """Usable rows with the block they belong to: ``(row, vec_id, v, length, anchor, n, label, bucket, part)``."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select("vec_id", "label", "embedding", F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    own = given.withColumn("embedding", bounded("embedding", scale, vectors.schema["embedding"].dataType)).select("vec_id", "label", whole.alias("v"), "anchor").withColumn("n", F.size("v"))
    own = own.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    own = stored(own.withColumns({"bucket": F.floor(F.log2(F.greatest("length", F.lit(1.0))) * 8).cast("int"), "row": F.monotonically_increasing_id()}))
    parts = own.groupBy("n", "label", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return stored(own.join(parts, ["n", "label", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts"))


def _met(own: DataFrame, asks: DataFrame, search, schema: str) -> DataFrame:
    """``search(block, anchors)`` over every block and lot of anchors that ``asks`` brings together."""
    by = (*_BLOCK, "lot")
    asks = stored(asks)
    held = own.select(*_BLOCK, "vec_id", "v").join(asks.select(*by).distinct(), list(_BLOCK))
    held = held.select(*[F.col(c).alias(c) for c in (*by, "vec_id", "v")])

    def run(block: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if block.num_rows and anchors.num_rows:
            own_block = Block(_matrix(block.column("v")), block.column("vec_id").to_numpy())
            facts = anchors.drop_columns(["v"]).to_pylist()
            for fact, v in zip(facts, _matrix(anchors.column("v")), strict=True):
                found += search(own_block, fact, v)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"vec_id": block.schema.field("vec_id").type}
        return pa.table({c: pa.array([f[i] for f in found], kinds.get(c, pa.int64())) for i, c in enumerate(names)})

    return held.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = 4096, lot: int = 1024, focus: int = 4) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    with scratch(vectors.sparkSession) as keep:
        return keep(_mined(vectors, is_anchor, positives, negatives, low, high, scale, block, lot, focus))


def _mined(vectors: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int, scale: int, block: int, lot: int, focus: int) -> DataFrame:
    own = _rows(vectors, is_anchor, scale, block)
    kind = own.schema["vec_id"].dataType.simpleString()
    # one row for each block; the longest of each label is searched first
    blocks = own.groupBy(*_BLOCK).agg(F.max("length").alias("longest"))
    blocks = stored(blocks.withColumn("head", F.row_number().over(W.partitionBy("n", "label").orderBy(F.col("bucket").desc(), "part")) == 1))
    asked = own.where("anchor")
    lots = max(1, -(-asked.count() // lot))
    anchors = stored(asked.select("row", F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("n").alias("width"), "v", "length", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int").alias("lot")))

    # positives
    def best_same(found: Block, fact: dict, v: np.ndarray) -> list[tuple]:
        ids, s = found.scores(v, fact["anchor_id"], -np.inf if fact["bar"] is None else fact["bar"], focus)
        return [(fact["row"], ids[i], s[i]) for i in _best(ids, s, positives).tolist()]

    same = (F.col("n") == F.col("width")) & (F.col("label") == F.col("own"))
    schema = f"row long, vec_id {kind}, score long"
    first = stored(_met(own, anchors.join(blocks.where("head"), same).select(*_BLOCK, "lot", "row", "anchor_id", "v", F.lit(None).cast("long").alias("bar")), best_same, schema))
    bars = first.groupBy("row").agg(F.when(F.count("*") >= positives, F.min("score")).alias("bar"))
    reach = F.col("bar").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("bar"))
    rest = anchors.join(bars, "row", "left").join(blocks.where("NOT head"), same & reach).select(*_BLOCK, "lot", "row", "anchor_id", "v", "bar")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    good = first.unionByName(stored(_met(own, rest, best_same, schema))).withColumn("place", rank).where(F.col("place") <= positives)

    # their bands, and what the other labels have inside
    hundredth = lambda p, c: F.expr(f"cast(floor({c} * decimal({p}) / 100) as bigint)")
    pairs = good.where("score >= 0").select("row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (-hundredth(-low, "score")).alias("least"), hundredth(high, "score").alias("most"))
    pairs = stored(pairs.where("least <= most"))

    def best_other(found: Block, fact: dict, v: np.ndarray) -> list[tuple]:
        bands = fact["bands"]
        ids, s = found.scores(v, fact["anchor_id"], min(b["bar"] for b in bands), focus)
        out = []
        for b in bands:
            inside = np.flatnonzero((s >= b["bar"]) & (s <= b["most"]))
            out += [(fact["row"], b["place"], ids[i], s[i]) for i in inside[_best(ids[inside], s[inside], negatives)].tolist()]
        return out

    def asks(with_bars: DataFrame, some: DataFrame) -> DataFrame:
        bands = with_bars.groupBy("row").agg(F.collect_list(F.struct("place", "bar", "most")).alias("bands"), F.min("bar").alias("bar"))
        # widths alone may be one key: anchors go to every slice of the blocks
        slices = max(1, -(-blocks.count() // 256))
        cut = some.withColumn("slice", F.pmod(F.xxhash64(*_BLOCK), F.lit(slices)).cast("int"))
        out = anchors.join(bands, "row").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        near = (F.col("n") == F.col("width")) & (F.col("slice") == F.col("_slice")) & (F.col("label") != F.col("own")) & (F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("bar"))
        return out.join(cut, near).select(*_BLOCK, "lot", "row", "anchor_id", "v", "bands")

    schema = f"row long, place long, vec_id {kind}, score long"
    first = stored(_met(own, asks(pairs.withColumn("bar", F.col("least")), blocks.where("head")), best_other, schema))
    rank = F.row_number().over(W.partitionBy("row", "place").orderBy(F.col("score").desc(), "vec_id"))
    fifth = first.withColumn("rank", rank).where(F.col("rank") == negatives).select("row", F.col("place").alias("_place"), F.col("score").alias("fifth")).withColumnRenamed("row", "_row")
    with_bars = pairs.join(fifth, (F.col("row") == F.col("_row")) & (F.col("place") == F.col("_place")), "left").withColumn("bar", F.greatest("least", "fifth"))
    bad = first.unionByName(stored(_met(own, asks(with_bars, blocks.where("NOT head")), best_other, schema)))
    bad = bad.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    out = bad.join(pairs, ["row", "place"]).join(anchors.select("row", "anchor_id"), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
