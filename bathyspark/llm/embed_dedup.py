"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, each with a codebook of its own (k-means over
a bounded sample); a vector's cell is its pair of nearest centroids, so the
codebooks' product is a grid.  A query walks the grid's occupied cells in order of
its distance to their pair of centroids (the multi-sequence algorithm) and
visits as many as a sample of queries needs to meet vectors made at the threshold
cosine to them at the target recall.  Members of a visited cell are then verified by
cosine in double precision, in blocks of bounded size however full a cell is;
blocks return counts of links and the links that join trees, never all pairs.

Vectors of another length than the most frequent one are placed in the same
grid, cut or filled up with zeros; only vectors of one length are compared.

Equal vectors are one member with a count.  Cases: null, empty, zero, and
non-finite vectors and such with null components link with nothing; rows without vec_id link only with equal
ones among themselves; equal rows are one vector; rows of one vec_id with
different vectors are one vector, of one class; an empty table gives no row;
other columns (labels) are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, group_bounds, grouped_map, span_links, staged

#: Vectors that the codebooks are fitted to, queries that the recall is measured with, at most.
SAMPLE, QUERIES = 20_000, 256
#: Vectors made from each of these queries.
COPIES = 8
#: Mean members of a cell that the grid is sized for, and the largest codebook.
CELL, CODEBOOK = 48, 1024
#: Rows of a block's side; fewest cells that a query visits.
BLOCK, LEAST = 1024, 8


def _units(df: DataFrame) -> DataFrame:
    """vec_id, unit (doubles as bytes; null where the vector links with nothing)."""
    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                u = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    if top > 0:
                        x = x / top
                        u = (x / np.sqrt((x * x).sum())).tobytes()
                out.append(u)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, unit binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows (of a sample in hash order)."""
    centre = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    for _ in range(rounds):
        own = np.argmin((centre * centre).sum(1)[None, :] - 2 * x @ centre.T, 1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centre))
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


class Grid:
    """Two codebooks and the occupied cells (number = first * size of the second + second)."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.width = books, len(books[1])
        self.occupied: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        parts = x[:, :half], x[:, half:]
        return tuple((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * p @ c.T for p, c in zip(parts, self.books))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, count: int) -> list[int]:
        """The first ``count`` occupied cells by a[i] + b[j], from sorted distances to either codebook."""
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        front, seen, out = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}, []
        while front and len(out) < count:
            _, i, j = heapq.heappop(front)
            cell = int(ia[i]) * self.width + int(ib[j])
            if self.occupied[cell]:
                out.append(cell)
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(ia) and p[1] < len(ib) and p not in seen:
                    seen.add(p)
                    heapq.heappush(front, (a[ia[p[0]]] + b[ib[p[1]]], *p))
        return out


def _matrix(units, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; vectors of another length are cut or filled up with zeros, which is enough to place them in the grid."""
    wide = [u if len(u) == 8 * dim else u[:8 * dim].ljust(8 * dim, b"\0") for u in units]
    return np.frombuffer(b"".join(wide), np.float64).reshape(-1, dim)


def _links(left: list[bytes], right: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of unit vectors of one length have at least that cosine."""
    out = np.zeros((len(left), len(right)), bool)
    sizes = [np.array([len(u) for u in side]) for side in (left, right)]
    for size in np.intersect1d(*sizes):
        i, j = (np.flatnonzero(s == size) for s in sizes)
        x, y = (np.frombuffer(b"".join([side[k] for k in at]), np.float64).reshape(len(at), -1) for side, at in ((left, i), (right, j)))
        out[np.ix_(i, j)] = x @ y.T >= threshold
    return out


def _calibrate(reps: DataFrame, grid: Grid, dim: int, threshold: float, recall: float) -> int:
    """Fewest cells to visit so that vectors at the threshold cosine, made from a sample, are met from either side at ``recall``.

    The made vectors count alike, so neither a sample without links nor one big group sets the walk.
    """
    sample = reps.orderBy(F.xxhash64("id", F.lit("query")), "id").select("id", "unit").limit(QUERIES).collect()
    q = np.repeat(_matrix([bytes(r["unit"]) for r in sample], dim), COPIES, 0)
    off = np.random.default_rng(7).normal(size=q.shape)
    off -= (off * q).sum(1, keepdims=True) * q
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    made = threshold * q + math.sqrt(max(0.0, 1 - threshold * threshold)) * off
    occupied = np.flatnonzero(grid.occupied)
    first, second = occupied // grid.width, occupied % grid.width

    def ranks(x, y):
        a, b = grid.distances(x)
        cell = grid.cells(y)
        return np.array([(a[i][first] + b[i][second] < a[i][c // grid.width] + b[i][c % grid.width]).sum() for i, c in enumerate(cell)])

    rank = np.sort(np.minimum(ranks(q, made), ranks(made, q)))
    return max(LEAST, int(rank[math.ceil(recall * len(rank)) - 1]) + 1)


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    keys = ["cell", "blk_m", "blk_q"]
    pdf = pdf.drop_duplicates([*keys, "id", "member"]).reset_index(drop=True)
    bounds, out = group_bounds(pdf, keys), []
    ids, copies, member, own = (pdf[c].to_numpy() for c in ("id", "copies", "member", "own"))
    for s, e in zip(bounds[:-1], bounds[1:]):
        m, q = s + np.flatnonzero(member[s:e]), s + np.flatnonzero(~member[s:e])
        if not len(m) or not len(q):
            continue
        linked = _links(pdf["unit"].iloc[q].tolist(), pdf["unit"].iloc[m].tolist(), threshold) & (ids[q][:, None] != ids[m][None, :])
        if not linked.any():
            continue
        count_q = (linked * copies[m][None, :]).sum(1)
        # the other way round the pair is met only if the member's walk has the query's cell
        visits = [np.asarray(v) for v in pdf["visits"].iloc[m]]
        back = np.zeros(len(m), np.int64)
        for cell in np.unique(own[q][linked.any(1)]):
            rows = own[q] == cell
            unmet = np.array([cell not in v for v in visits])
            back += (linked[rows] * copies[q][rows][:, None]).sum(0) * unmet
        out += [(i, None, n) for i, n in zip(ids[q], count_q.tolist()) if n] + [(i, None, n) for i, n in zip(ids[m], back.tolist()) if n]
        where: dict[int, int] = {}
        place = np.array([where.setdefault(int(i), len(where)) for i in np.concatenate([ids[q], ids[m]])])
        forest, name = Forest(len(where)), list(where)
        span_links(linked, place[:len(q)], place[len(q):], forest)
        out += [(name[i], name[j], 0) for i, j in forest.kept]
    return pd.DataFrame(out, columns=["id", "other", "links"]).astype({"id": "int64", "other": "Int64", "links": "int64"})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    # the grid is made for the most frequent length
    top = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top["n"] if top and top["n"] else 1
    units = staged(_units(vectors).withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(1), "unit")), "vectors-units")
    alone = units.where("unit is null").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    groups = (units.where("unit is not null").groupBy("h1", "h2")
              .agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies"), F.count(F.lit(1)).alias("n_rows")))
    member = staged(units.where("unit is not null").join(groups, ["h1", "h2"]).select(
        "vec_id", "node", F.when(F.col("node").isNull(), F.col("n_rows")).otherwise(F.col("copies")).alias("copies"),
        F.when(F.col("vec_id") == F.col("node"), F.col("unit")).alias("unit")), "vectors-members")
    reps = member.where("vec_id = node").select(F.col("node").alias("id"), "copies", "unit").dropDuplicates(["id", "unit"])
    n = reps.count()
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    if n < 2:
        same = member.select("vec_id", F.col("node").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
        return same.unionByName(alone).withColumn("kept", kept)
    sample = reps.orderBy(F.xxhash64("id", F.lit("book")), "id").select("unit").limit(SAMPLE).collect()
    x, half = _matrix([bytes(r["unit"]) for r in sample], dim), dim // 2
    k = min(CODEBOOK, max(2, math.ceil(math.sqrt(n / CELL))))
    grid = Grid((kmeans(x[:, :half], k), kmeans(x[:, half:], k)))

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(grid.cells(_matrix(b.column(0).to_pylist(), dim)))], names=["cell"])

    # one row per cell of the grid, at most CODEBOOK ** 2
    full = reps.select("unit").mapInArrow(place, "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n_m"))
    grid.occupied = np.zeros(len(grid.books[0]) * grid.width, bool)
    grid.occupied[[r["cell"] for r in full.select("cell").collect()]] = True
    cells = _calibrate(reps, grid, dim, threshold, recall)

    def walks(batches):
        for b in batches:
            x = _matrix(b.column(2).to_pylist(), dim)
            a, c = grid.distances(x)
            own = a.argmin(1) * grid.width + c.argmin(1)
            visits = [grid.walk(a[i], c[i], cells) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(visits, pa.list_(pa.int64()))], names=["id", "copies", "unit", "own", "visits"])

    placed = staged(reps.select("id", "copies", "unit").mapInArrow(walks, "id long, copies long, unit binary, own long, visits array<long>"), "vectors-walks")
    queries = placed.withColumn("cell", F.explode("visits")).withColumn("visits", F.array().cast("array<bigint>")).withColumn("member", F.lit(False))
    sizes = staged(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n_q")).join(placed.groupBy(F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("n_m")), "cell")
                   .select("cell", F.ceil(F.col("n_m") / BLOCK).cast("int").alias("b_m"), F.ceil(F.col("n_q") / BLOCK).cast("int").alias("b_q")), "vectors-cells")
    number = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = (queries.join(sizes, "cell").withColumn("blk_q", number("b_q")).withColumn("blk_m", every("b_m"))
            .unionByName(placed.withColumn("cell", F.col("own")).withColumn("member", F.lit(True)).join(sizes, "cell")
                         .withColumn("blk_m", number("b_m")).withColumn("blk_q", every("b_q"))))
    links = staged(grouped_map(rows.select("cell", "blk_m", "blk_q", "id", "copies", "member", "own", "visits", "unit"), ["cell", "blk_m", "blk_q"],
                               lambda pdf: _verify(pdf, threshold), "id long, other long, links long"), "vectors-links")
    classes = components(links.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), "vectors-classes")
    counts = links.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    per_node = classes.join(counts, "id", "left").select(F.col("id").alias("node"), "component", F.coalesce("links", F.lit(0)).alias("links"))
    linked = member.join(per_node, "node", "left").select(
        "vec_id", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return linked.unionByName(alone).withColumn("kept", kept)
