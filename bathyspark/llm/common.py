"""Shared helpers: table access, staged tables, token hashes, block pairs, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch one only in local mode without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``staged``, as a table bucketed by ``key``: what joins it on ``key`` comes to it."""
    spark, table = df.sparkSession, f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    (df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").format("parquet")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table))
    return spark.table(table)


def fresh(base: str, taken) -> str:
    """A column name like ``base`` that none of ``taken`` equals (case-insensitively)."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base = "_" + base
    return base


# ---------------------------------------------------------------- token hashes
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 random 64-bit values, fixed by ``seed``."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def words_of(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``space`` (256 booleans) does not hold for."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(space[data], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordHasher:
    """Hashes of the words of a text; words are runs of bytes that ``space`` doesn't hold for.

    A word's hash is the difference of two prefix sums of its bytes' random
    values times powers of an odd base, divided by the power of its start.
    """

    def __init__(self, seed: int = 7, space: np.ndarray = SPACE, step: int = 1 << 20):
        self.values, self.space, self.step = byte_table(seed), space, step
        self.base = 0x100000001B3 + 2 * seed
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.power, self.inverse = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)

    def _slice(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.power):
            self._grow(max(len(data), min(2 * len(self.power), 2 * self.step)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _MUL)

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words_of(data, self.space)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends (bytes) of all words; long texts go slice by slice."""
        starts, ends = words_of(data, self.space)
        if len(data) <= self.step or len(starts) < 2:
            return self._slice(data, starts, ends), starts, ends
        parts = np.split(np.arange(len(starts)), np.unique(np.searchsorted(starts, np.arange(self.step, len(data), self.step))))
        return np.concatenate([self._slice(data[starts[p[0]]:ends[p[-1]]], starts[p] - starts[p[0]], ends[p] - starts[p[0]])
                               for p in parts if len(p)]), starts, ends


def gram_hashes(words: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(base)
        out += words[i:i + n]
    return mix(out)


# ---------------------------------------------------------------- block pairs
def block_pairs(members: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """Deal the members of each group into blocks and pair the blocks.

    A group of ``n`` members has ``ceil(n / size)`` blocks, by a hash of
    ``member``.  Each member goes once to every pair of blocks that holds its
    own, as column ``blk`` (own block) with ``blk_a <= blk_b``; so all pairs of
    a group meet in exactly one block pair, in tasks of bounded size, however
    large the group is.  Groups of one member are dropped: they hold no pair.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("blk_n")).where("blk_n > 1")
    n = F.ceil(F.col("blk_n") / size).cast("int")
    return (members.join(sizes, group)
            .withColumn("blk", F.pmod(F.xxhash64(F.col(member), F.lit("block")), n).cast("int"))
            .withColumn("blk_o", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("blk_a", F.least("blk", "blk_o")).withColumn("blk_b", F.greatest("blk", "blk_o"))
            .drop("blk_o", "blk_n"))


def pair_spans(blk: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a block pair (the same rows twice when ``a == b``)."""
    return np.flatnonzero(blk == a), np.flatnonzero(blk == b)


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((i, j))


def span_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Add the true cells of ``linked`` (rows ``left`` x columns ``right``) to ``forest``.

    Each row joins the trees of its columns; a column whose tree the row has
    already is skipped in bulk, so dense blocks cost their cells once.
    """
    tree = np.array([forest.root(int(j)) for j in right])
    for r, i in enumerate(left):
        cols = np.flatnonzero(linked[r])
        if not len(cols):
            continue
        for t in np.unique(tree[cols]):
            j = int(right[cols[np.argmax(tree[cols] == t)]])
            forest.link(int(i), j)
        tree[np.isin(tree, tree[cols])] = forest.root(int(i))


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (id, component = smallest id).

    Alternates large-star and small-star steps: each keeps at most the edges it
    was given, so a node with very many links adds no rows; the joins on such
    nodes are ordinary equi-joins that Spark splits.  Each round is a written
    table in the shared folder.  Ids without an edge aren't returned.
    """
    def once(df, tag):
        return staged(df, f"{name}-{tag}")

    def mark(df):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    e = once(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    seen = mark(e)
    for k in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v")))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        e = once(small, k)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def long_field(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def grouped_map(df: DataFrame, keys: list[str], run, schema: str | T.StructType, rows: int = 4096) -> DataFrame:
    """Like ``groupBy(keys).applyInPandas(run)``, but ``run`` gets many whole groups at once, sorted by ``keys``.

    For very many small groups.  A call holds about ``rows`` rows, or one group
    if that is larger, so groups must be bounded (as block pairs are).
    """
    import pandas as pd

    def stream(batches):
        held = []

        def size():
            return sum(map(len, held))

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            if size() < rows:
                continue
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            last = np.ones(len(pdf), bool)
            for k in keys:
                last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
            if not last.all():
                yield run(pdf[~last].reset_index(drop=True))
                pdf = pdf[last].reset_index(drop=True)
            held = [pdf]
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def group_bounds(pdf, keys: list[str]) -> np.ndarray:
    """Row numbers at which the groups of a frame sorted by ``keys`` begin, and its length."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new), [len(pdf)]])
