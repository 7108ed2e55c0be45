"""Exact near-duplicate pairs of embeddings by cover-tree dual traversal.

Only rows with equal labels meet. Equal vectors of a label are one class, so a vector that many rows repeat is
compared once. Unit vectors at cosine c are ``sqrt(2 - 2c)`` apart. Classes go to the cell of the nearest of the
pivots, the top net that all tasks share: there are as many as the largest label has ``cell_rows`` classes (up to
``most_pivots``, a bounded sample), so cells keep their size while the table grows. Two cells meet only if their
pivots are no farther apart than both covering radii and the threshold. Cells over ``cell_rows`` are dealt out
in parts. In a meeting each side is a cover tree, nested levels of balls with halving radii; both trees are
walked together, a pair of nodes is dropped when the distance of the centres is over the sum of the covering
radii and the threshold, and what is left at the leaves is tested with the exact cosine in double precision.
Distances are taken only between the nodes that the walk visits (as one product where it visits most pairs of what
it holds). Tasks return the number of links of each class and spanning links, not the pairs. Vectors without
structure (random directions in many dimensions) let no bound prune much, and most pairs are then compared.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different lengths do not link; equal rows are vectors of their own and link with
each other; different vectors under one id share the links of that id; a null id has component null; a cosine of just
the threshold links; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import partitions, ranges
from dyadspark.llm.simhash import _Links
from dyadspark.operators.checkpoints import cut
from dyadspark.operators.graph import connected_components

_LEAF = 12
#: Room for rounding when bounds are compared; the cosine decides in the end.
_ROUND = 1e-6


def _apart(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their inner products."""
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class CoverTree:
    """Nested balls over unit vectors: ``members[first[i]:last[i]]`` lie within ``radius[i]`` of ``centre[i]``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.members = np.arange(len(points))
        centre, radius, first, last, kids = [], [], [], [], []
        open_ = [(0, len(points), 2.0, -1)]
        while open_:
            a, b, scale, parent = open_.pop()
            own = self.members[a:b]
            node = len(centre)
            block = points[own]
            away = _apart(block @ block[0])
            away[0] = 0.0
            centre.append(own[0])
            radius.append(float(away.max()))
            first.append(a)
            last.append(b)
            kids.append([])
            if parent >= 0:
                kids[parent].append(node)
            if b - a <= _LEAF or radius[-1] == 0:
                continue
            while scale / 2 >= radius[-1]:
                scale /= 2
            # centres at least half the scale apart; the node's own centre stays one of them
            near, home, heads = away.copy(), np.zeros(len(own), np.int64), [0]
            while near.max() > scale / 2:
                far = int(near.argmax())
                d = _apart(block @ block[far])
                d[far] = 0.0
                closer = d < near
                home[closer] = len(heads)
                near = np.minimum(near, d)
                heads.append(far)
            order = np.lexsort((near, home))  # a child's centre comes first in it
            self.members[a:b] = own[order]
            cuts = np.append(np.searchsorted(home[order], np.arange(len(heads))), len(own))
            for i in range(len(heads)):
                open_.append((a + int(cuts[i]), a + int(cuts[i + 1]), scale / 2, node))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last = np.array(first), np.array(last)
        self.n_kids = np.array([len(x) for x in kids])
        self.kids = np.array([y for x in kids for y in x], np.int64)
        self.kid_at = np.concatenate([[0], np.cumsum(self.n_kids)[:-1]])


def _between(a: CoverTree, b: CoverTree, x: np.ndarray, y: np.ndarray, seen: list[int] | None, chunk: int = 1 << 16) -> np.ndarray:
    """Distances of the centres of the node pairs ``(x, y)``; ``seen`` gets how many were taken."""
    own_x, at_x = np.unique(x, return_inverse=True)
    own_y, at_y = np.unique(y, return_inverse=True)
    if 3 * len(x) >= len(own_x) * len(own_y):
        if seen is not None:
            seen.append(len(own_x) * len(own_y))
        return _apart((a.points[a.centre[own_x]] @ b.points[b.centre[own_y]].T)[at_x, at_y])
    if seen is not None:
        seen.append(len(x))
    parts = [np.einsum("ij,ij->i", a.points[a.centre[x[i : i + chunk]]], b.points[b.centre[y[i : i + chunk]]]) for i in range(0, len(x), chunk)]
    return _apart(np.concatenate(parts))


def close_pairs(a: CoverTree, b: CoverTree, reach: float, chunk: int = 1 << 15, seen: list[int] | None = None):
    """Blocks of ``(i, j)`` that hold every pair of points within ``reach``; for one tree ``i < j``."""
    one = a is b
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(x):
        d = _between(a, b, x, y, seen)
        ok = d <= a.radius[x] + b.radius[y] + reach + _ROUND
        x, y = x[ok], y[ok]
        leaf = (a.n_kids[x] == 0) & (b.n_kids[y] == 0)
        p, q = x[leaf], y[leaf]
        np_, nq = a.last[p] - a.first[p], b.last[q] - b.first[q]
        sizes = np_ * nq
        total = np.cumsum(sizes)
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * chunk)))
            part = slice(at, to)
            k = ranges(np.zeros(len(sizes[part]), np.int64), sizes[part])
            which = np.repeat(np.arange(at, to), sizes[part])
            i, j = a.members[a.first[p[which]] + k // nq[which]], b.members[b.first[q[which]] + k % nq[which]]
            if one:
                i, j = i[i < j], j[i < j]
            yield i, j
            at = to
        x, y = x[~leaf], y[~leaf]
        # the larger ball is opened, in both trees when they are one so that a pair is met once each way
        open_a = (a.n_kids[x] > 0) & ((b.n_kids[y] == 0) | (a.radius[x] >= b.radius[y]))
        na, nb = a.n_kids[x[open_a]], b.n_kids[y[~open_a]]
        x, y = (
            np.concatenate([a.kids[ranges(a.kid_at[x[open_a]], na)], np.repeat(x[~open_a], nb)]),
            np.concatenate([np.repeat(y[open_a], na), b.kids[ranges(b.kid_at[y[~open_a]], nb)]]),
        )


def _unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _usable() -> Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.93, cell_rows: int = 2048, pivots: int | None = None, most_pivots: int = 4096) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    given = vectors.select("vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = given.schema["vec_id"].dataType.simpleString()
    label = given.schema["label"].dataType.simpleString()
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    usable = given.where(_usable())
    classes = cut(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumn("dim", F.size("embedding")))

    # pivots: vectors in hash order, as many as the cells that the largest label needs
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    if pivots is None:
        pivots = min(most_pivots, max(1, -(-(sizes.agg(F.max("n")).first()[0] or 0) // cell_rows)))
    sample = classes.select("rep", "dim", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(pivots).collect()
    heads = {dim: _unit(np.array([r.embedding for r in sample if r.dim == dim], np.float64)) for dim in {r.dim for r in sample}}
    shared = vectors.sparkSession.sparkContext.broadcast(heads)
    counts = sizes.select("label", "dim", F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / cell_rows), F.lit(pivots))).cast("int").alias("cells"))

    def assign(batches):
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cells").to_numpy()
            cell, away = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                heads_ = shared.value.get(int(dim))
                if heads_ is None:
                    continue
                x = _unit(_matrix(batch.column("embedding").take(pa.array(rows))))
                d = np.sqrt(np.maximum(2 - 2 * (x @ heads_.T), 0))
                d[np.arange(len(heads_))[None, :] >= cells[rows][:, None]] = np.inf
                cell[rows] = d.argmin(axis=1)
                away[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim"), batch.column("rep"), batch.column("many"), batch.column("embedding"), pa.array(cell), pa.array(away)], ["label", "dim", "rep", "many", "embedding", "cell", "away"])

    placed = cut(classes.join(counts, ["label", "dim"]).select("label", "dim", "rep", "many", "embedding", "cells").mapInArrow(assign, f"label {label}, dim int, rep {kind}, many long, embedding array<double>, cell int, away double"))
    cells = placed.groupBy("label", "dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
    other = cells.select("label", "dim", F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("parts").alias("parts2"))

    def meeting_cells(batches):
        for batch in batches:
            col = {c: batch.column(c).to_numpy() for c in ("dim", "cell", "cell2", "radius", "radius2")}
            ok = col["cell"] == col["cell2"]
            for dim, heads_ in shared.value.items():
                rows = np.flatnonzero((col["dim"] == dim) & ~ok)
                d = np.sqrt(((heads_[col["cell"][rows]] - heads_[col["cell2"][rows]]) ** 2).sum(axis=1))
                ok[rows] = d <= col["radius"][rows] + col["radius2"][rows] + reach + _ROUND
            yield batch.filter(pa.array(ok))

    pairs = cells.join(other, ["label", "dim"]).where("cell <= cell2")
    pairs = pairs.mapInArrow(meeting_cells, pairs.schema)
    parts = pairs.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, parts2 - 1)"))).where("cell < cell2 OR i <= j").select("label", "dim", "cell", "i", "cell2", "j", F.xxhash64("label", "dim", "cell", "i", "cell2", "j").alias("meeting"))
    # cached by the checkpoint: both sides of every meeting read it
    parts = cut(parts)
    sides = parts.select("label", "dim", "cell", F.col("i").alias("part"), "meeting", F.lit(0).alias("side")).unionByName(parts.where("cell < cell2 OR i < j").select("label", "dim", F.col("cell2").alias("cell"), F.col("j").alias("part"), "meeting", F.lit(1).alias("side")))
    size = cells.select("label", "dim", "cell", "parts")
    members = placed.join(size, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("label", "dim", "cell", "part", "rep", "many", "embedding")
    dealt = members.join(sides, ["label", "dim", "cell", "part"]).select("meeting", "side", "rep", "many", "embedding")

    def meet(key, table):
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        side, many, reps = table.column("side").to_numpy(), table.column("many").to_numpy(), table.column("rep").combine_chunks()
        raw = _matrix(table.column("embedding"))
        x = _unit(raw)
        norm = np.sqrt((raw * raw).sum(axis=1))
        split = int((side == 0).sum())
        links, found = _Links(len(x)), np.zeros(len(x), np.int64)
        if split == len(x):
            trees = (tree := CoverTree(x), tree)
        elif 0 < split < len(x):
            trees = (CoverTree(x[:split]), CoverTree(x[split:]))
        else:
            trees = None
        if trees:
            shift = 0 if trees[0] is trees[1] else split
            for i, j in close_pairs(*trees, reach):
                j = j + shift
                ok = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= cosine
                i, j = i[ok], j[ok]
                np.add.at(found, i, many[j])
                np.add.at(found, j, many[i])
                links.add(i, j)
        some = np.flatnonzero(found)
        take = pa.array(some)
        return pa.table({"rep": reps.take(take), "links": pa.array(found[some]), "head": reps.take(pa.array(links.low[some]))})

    met = cut(dealt.repartition(partitions(placed), "meeting").groupBy("meeting").applyInArrow(meet, f"rep {kind}, links long, head {kind}"))
    groups = connected_components(met.where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst")))
    n_links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(n_links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
