"""Hard negatives by Four-Russians scoring: exact integer inner products from table look-ups.

Components become integers ``floor(scale * x)``.  A candidate's integers are
cut into bit planes (two's complement); the bits of eight consecutive
dimensions in one plane are one byte.  For every group of eight dimensions an anchor
has a table of its 256 subset sums.  A candidate's score is the sum, over
planes, of ``2 ** plane`` times the table entries that its bytes name (the sign
plane counts negatively): look-ups, shifts and additions, exact in integers.

Both sides are dealt into blocks of bounded size by a hash of their ids, one
row a block; a row of two blocks is one task's work, whatever the labels are.
A first pass keeps each anchor's best positives of a candidate block, a second one,
which knows the positives' scores, the best negatives of every score band; the
blocks' few best are merged by windows.

Cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component take no part, nor do rows with an integer component so
large (beyond 2**24 at 64 dimensions) that a score might not fit a long; only
vectors of one length are compared; rows that share a vec_id are one row (the
smallest label, then the smallest vector); score ties go by smaller vec_id; an
anchor without positives, or a band without rows, gives no row; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of a candidate block and of an anchor block; anchors that are scored at a time.
BLOCK, ANCHORS, AT_ONCE = 2048, 2048, 64
_LOW = np.iinfo(np.int64).min


def integers(vector, scale: int) -> np.ndarray | None:
    """``floor(scale * x)`` of a list, or None where the vector takes no part."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    return x.astype(np.int64) if np.abs(x).max() <= math.isqrt(2**55 // len(x)) else None


def planes(values: np.ndarray) -> np.ndarray:
    """Packed bit planes of rows of integers: (plane, group of eight dimensions, row) bytes, the sign plane last."""
    top = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    return np.stack([np.packbits((values >> p & 1).astype(bool), axis=1, bitorder="little").T for p in range(top.bit_length() + 1)])


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(group, byte, anchor): the sums of an anchor's components in the dimensions whose bits the byte has."""
    n, dim = anchors.shape
    parts = np.zeros((n, -(-dim // 8) * 8), dtype)
    parts[:, :dim] = anchors
    parts = parts.reshape(n, -1, 8).transpose(1, 2, 0)
    table = np.zeros((parts.shape[0], 256, n), dtype)
    for bit in range(8):
        table[:, 1 << bit:2 << bit] = table[:, :1 << bit] + parts[:, bit:bit + 1]
    return table


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor) of integer anchors with candidates given as packed planes."""
    most = int(np.abs(anchors).sum(1).max(initial=0)) << len(packed)
    table = subset_sums(anchors, np.int32 if most < 2**31 else np.int64)
    total = np.zeros((packed.shape[2], len(anchors)), table.dtype)
    for p in range(len(packed) - 1, -1, -1):
        total += total
        plane = table[0][packed[p, 0]]
        for g in range(1, len(table)):
            plane += table[g][packed[p, g]]
        if p == len(packed) - 1:
            total -= plane
        else:
            total += plane
    return total


def _best(value: np.ndarray, allowed: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The first rows of every column by value, ties by row number: (row, value, is there one), rank after rank."""
    held, out, cols = np.where(allowed, value, _LOW), [], np.arange(value.shape[1])
    for _ in range(min(count, len(value))):
        row = held.argmax(0)
        top = held[row, cols]
        out.append((row, top, top > _LOW))
        held[row, cols] = _LOW
    return out


def _rows(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """(vec_id, label, dim, ints): the rows that take part, one for each vec_id."""
    def run(batches):
        for b in batches:
            x = [integers(v, scale) for v in b.column(2).to_pylist()]
            ok = pa.array([v is not None for v in x], pa.bool_())
            got = [v for v in x if v is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array([len(v) for v in got], pa.int32()),
                                              pa.array([v.tobytes() for v in got], pa.binary())], names=["vec_id", "label", "dim", "ints"])

    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where(
        "vec_id is not null and label is not null and embedding is not null")
    kept = whole.mapInArrow(run, "vec_id long, label long, dim int, ints binary")
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "ints")).alias("r")).select("vec_id", "r.*")


def _blocks(rows: DataFrame, size: int, name: str, lists: tuple[str, ...] = (), width: int = 0) -> tuple[DataFrame, int]:
    """Rows dealt into blocks of about ``size``, one row for the rows of one length, and the number of blocks.

    Columns: dim, block, ids, labels, ints and ``lists`` (padded to ``width``), as packed longs in the order of the ids.
    """
    count = max(1, math.ceil(rows.count() / size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        out = {"dim": pdf["dim"].iloc[:1].tolist(), "block": pdf["block"].iloc[:1].tolist(), "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
               "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "ints": [b"".join(pdf["ints"])]}
        for name in lists:
            padded = np.full((len(pdf), width), _LOW)
            for k, x in enumerate(pdf[name]):
                padded[k, :len(x)] = x
            out[name] = [padded.tobytes()]
        return pd.DataFrame(out)

    schema = ", ".join(["dim int, block int, ids binary, labels binary, ints binary", *(f"{c} binary" for c in lists)])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(count)).cast("int"))
    return staged(dealt.select("dim", "block", "vec_id", "label", "ints", *lists).groupBy("dim", "block").applyInPandas(pack, schema), f"negatives-{name}"), count


def _pairs(anchors: tuple[DataFrame, int], candidates: tuple[DataFrame, int]) -> DataFrame:
    """Each candidate block beside each anchor block of its length, one row a pair, dealt over the tasks."""
    each = candidates[0].withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(anchors[1] - 1))))
    left = anchors[0].select([F.col(c).alias(c if c == "dim" else f"a_{c}") for c in anchors[0].columns])
    return each.join(left, ["dim", "a_block"]).repartition("dim", "a_block", "block")


def _numbers(data: bytes, width: int = 0) -> np.ndarray:
    x = np.frombuffer(data, np.int64)
    return x.reshape(-1, width) if width else x


class Pair:
    """A row of two blocks: ids and labels of candidates and anchors, and slices of scores."""

    def __init__(self, row: dict):
        self.row, dim = row, row["dim"]
        self.ids, self.labels, self.a_ids, self.a_labels = (_numbers(row[c]) for c in ("ids", "labels", "a_ids", "a_labels"))
        self.packed, self.anchors = planes(_numbers(row["ints"], dim)), _numbers(row["a_ints"], dim)

    def slices(self):
        for at in range(0, len(self.anchors), AT_ONCE):
            yield slice(at, at + AT_ONCE), scores(self.anchors[at:at + AT_ONCE], self.packed).astype(np.int64)

    def positives(self, count: int) -> list[np.ndarray]:
        """anchor, id, score of the best rows with the anchor's label."""
        got = []
        for s, value in self.slices():
            same = (self.labels[:, None] == self.a_labels[None, s]) & (self.ids[:, None] != self.a_ids[None, s])
            got += [(self.a_ids[s][ok], self.ids[row[ok]], top[ok]) for row, top, ok in _best(value, same, count)]
        return [np.concatenate(x) for x in zip(*got)]

    def negatives(self, width: int, count: int, low: int, high: int) -> list[np.ndarray]:
        """anchor, positive, its score, id, score of the best rows with another label in each positive's band."""
        pos, known = _numbers(self.row["a_pos"], width), _numbers(self.row["a_known"], width)
        got = [[np.empty(0, np.int64)] * 5]
        for s, value in self.slices():
            other = self.labels[:, None] != self.a_labels[None, s]
            for k in range(width):
                there = known[s, k] > _LOW
                if not there.any():
                    break
                score = np.where(there, known[s, k], 0)
                fits = other & there[None, :] & (value >= -(-low * score // 100)[None, :]) & (value <= (high * score // 100)[None, :])
                got += [(self.a_ids[s][ok], pos[s, k][ok], score[ok], self.ids[row[ok]], best[ok]) for row, best, ok in _best(value, fits, count)]
        return [np.concatenate(x) for x in zip(*got)]


def _found(pairs: DataFrame, work, names: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                columns = work(Pair({c: b.column(c)[r].as_py() for c in b.schema.names}))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return pairs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _first(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first rows of each group by score, then id, with their rank."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors`` (vec_id, embedding, label).

    ``anchor`` says over vec_id which rows are anchors, ``label`` which label a
    row has (by default its own).  An anchor's positives are its best
    ``positives`` other rows of the same label; for each, the best ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive's are returned.
    """
    rows = staged(_rows(vectors, scale, F.col("label") if label is None else label), "negatives-rows")
    candidates = _blocks(rows, BLOCK, "candidates")
    near = _found(_pairs(_blocks(rows.where(anchor), ANCHORS, "anchors"), candidates), lambda p: p.positives(positives), ["anchor", "id", "score"])
    known = _first(near, ["anchor"], positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    chosen = (rows.where(anchor).join(known, F.col("vec_id") == F.col("anchor"))
              .select("vec_id", "label", "dim", "ints", F.col("best.id").alias("pos"), F.col("best.score").alias("known")))
    bands = _blocks(staged(chosen, "negatives-positives"), ANCHORS, "bands", ("pos", "known"), positives)
    found = _found(_pairs(bands, candidates), lambda p: p.negatives(positives, negatives, low, high),
                   ["anchor_id", "positive_id", "positive_score", "id", "score"])
    return _first(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
