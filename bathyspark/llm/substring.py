"""Substring deduplication by seed and extend.

Words are runs of anything but ASCII white space.  Winnowing picks, for every
window of ``length`` words, its smallest ``SEED``-word hash; picked seeds are
anchors, so two documents that share a window share its anchor.  An anchor's
context is all windows that picked it: the seed extended both ways as far as
its windows reach.

Occurrences are sorted over the cluster by (anchor, context, doc_id, place),
which joins documents on their anchors and splits a common anchor over many tasks.
Occurrences with equal contexts repeat the first of them as a whole.  Anchors
whose occurrences extend differently (the ends of a repeat), and the few that
lie across two tasks, are compared window by window: the words around the
anchor are read again and the first place of each window is aggregated.
Overlapping repeats join to maximal ones, and their words are removed.

A window repeats if its word sequence also starts earlier (at a smaller
doc_id, or earlier in the same document).  Cases: null and empty texts have no
words; rows without doc_id are in no order with others: they are returned
whole and nothing repeats them; equal rows are one document and each gets its
result; rows of one doc_id with different texts are at the same place, so
neither repeats the other; an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, gram_hashes, mix, powers, staged

#: Words of a seed; a window of n words has n - SEED + 1 seeds to pick from (16 at most: places are packed in 4 bits).
SEED = 8
CHUNK = 1 << 15
TAG = (1 << 24) - 1


class Windows:
    """Hashes of runs of words, from prefix sums over the word hashes."""

    def __init__(self, base: int):
        self.base, self.size = base, 0
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.size = n
        self.power, self.inverse = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)

    def prepare(self, words: np.ndarray) -> None:
        if len(words) > self.size:
            self._grow(max(len(words), 2 * self.size))
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[:len(words)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])


def winnow(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text: place of the seed, first and last window that pick it (the leftmost smallest of ``width``)."""
    n = len(grams) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    picked = np.empty(n, np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        low = (grams[lo:hi + width - 1] & ~np.uint64(0xFFFF)) | np.arange(hi - lo + width - 1, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = width - span
        low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
        picked[lo:hi] = lo + (low & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
    return picked[first], first, np.append(first[1:], n) - 1


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Rows (anchor, ctx, doc, loc); ``loc``: first window, the seed's place in the first and last window, the text's tag."""
    width = length - SEED + 1

    def run(batches):
        hasher, windows = WordHasher(), Windows(0x2545F4914F6CDD1D)
        for b in batches:
            cols = [[], [], [], []]
            for doc, text, tag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = hasher(np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8))[0]
                grams = gram_hashes(w, SEED)
                at, first, last = winnow(grams, width)
                if not len(at):
                    continue
                windows.prepare(w)
                left, right = (at - first).astype(np.uint64), (at - last).astype(np.uint64)
                ctx = mix(windows(first, last + length) + left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F))
                loc = (first.astype(np.uint64) << np.uint64(32)) | (left << np.uint64(28)) | (right << np.uint64(24)) | np.uint64(tag)
                for c, v in zip(cols, (grams[at].view(np.int64), ctx.view(np.int64), np.full(len(at), doc, np.int64), loc.view(np.int64))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "ctx", "doc", "loc"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "anchor long, ctx long, doc long, loc long")


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, tag."""
    loc = loc.view(np.uint64)
    first = (loc >> np.uint64(32)).astype(np.int64)
    left, right = ((loc >> np.uint64(s) & np.uint64(15)).astype(np.int64) for s in (28, 24))
    return first, first + left - right, (loc & np.uint64(TAG)).astype(np.int64)


def _compare(batches):
    """Sorted occurrences of a task to rows (doc, tag, first, last, sure): repeats, and (not sure) contexts to compare by window."""
    prev, place, pending, multi, head = None, None, None, None, True

    def rows(doc, loc, sure):
        first, last, tag = _unpack(loc)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(first), pa.array(last), pa.array(np.full(len(doc), sure))],
                                          names=["doc", "tag", "first", "last", "sure"])

    for b in batches:
        anchor, ctx, doc, loc = (b.column(i).to_numpy() for i in range(4))
        if not len(anchor):
            continue
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (ctx[1:] == ctx[:-1])
        # the first place of each row's context; rows at that very place (of equal doc_ids) don't repeat it
        at, start = loc.view(np.uint64) >> np.uint64(32), np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
        doc1, at1 = doc[start], at[start]
        if prev == (anchor[0], ctx[0]):
            doc1[start == 0], at1[start == 0] = place
        prev, place = (anchor[-1], ctx[-1]), (doc1[-1], at1[-1])
        same = (doc != doc1) | (at != at1)
        if same.any():
            yield rows(doc[same], loc[same], True)
        a, d, w = anchor[~same], doc[~same], loc[~same]
        if pending is not None:
            a, d, w = (np.concatenate([p, x]) for p, x in zip(pending, (a, d, w)))
            pending = None
        if not len(a):
            continue
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        count = np.diff(np.append(begin, len(a)))
        open_ = count > 1
        if multi == a[0]:
            open_[0] = True
        if head:  # the first anchor of the task may have begun in another
            open_[0], multi, head = True, a[0], False
        if open_[-1]:
            multi = a[-1]
        else:
            pending = (a[-1:], d[-1:], w[-1:])
        take = np.repeat(open_, count)
        if take.any():
            yield rows(d[take], w[take], False)
    if pending is not None:
        yield rows(pending[1], pending[2], False)


def repeats(base: DataFrame, length: int) -> DataFrame:
    """Rows (doc, tag, start, stop): stretches of words of ``base`` (doc_id, tag, text) that repeat earlier windows."""
    order = ["anchor", "ctx", "doc", "loc"]
    found = staged(anchors(base, length).repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_compare, "doc long, tag long, first long, last long, sure boolean"), "substring-found")
    open_ = (found.where("not sure").groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans")))

    def windows(batches):
        hasher, one, two = WordHasher(), Windows(0x2545F4914F6CDD1D), Windows(0x5851F42D4C957F2D)
        for b in batches:
            out = [[], [], [], [], []]
            for doc, tag, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                w = hasher(np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8))[0]
                flat = spans.values.flatten()
                first, last = flat[0].to_numpy(), flat[1].to_numpy()
                n = last - first + 1
                at = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                one.prepare(w)
                two.prepare(w)
                for c, v in zip(out, (one(at, at + length).view(np.int64), two(at, at + length).view(np.int64), np.full(len(at), doc, np.int64),
                                      np.full(len(at), tag, np.int64), at)):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "doc", "tag", "at"])

    rows = (base.join(open_, (base["doc_id"] == open_["doc"]) & (base["tag"] == open_["tag"])).select("doc_id", base["tag"], "text", "spans")
            .mapInArrow(windows, "w1 long, w2 long, doc long, tag long, at long"))
    firsts = rows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = rows.join(firsts, ["w1", "w2"]).where((F.col("doc") > F.col("f.doc")) | (F.col("at") > F.col("f.at")) & (F.col("doc") == F.col("f.doc")))
    return (found.where("sure").select("doc", "tag", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
            .unionByName(later.select("doc", "tag", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))))


def _remove(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The words that aren't gone, joined by one space."""
    starts, ends = starts[~gone], ends[~gone]
    if not len(starts):
        return b""
    out, edge = data.copy(), np.zeros(len(data) + 1, np.int8)
    out[starts[1:] - 1] = 0x20  # the white space before a word
    np.add.at(edge, np.append(starts[0], starts[1:] - 1), 1)
    np.add.at(edge, ends, -1)
    return out[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_words, n_removed, text (kept words joined by one space)."""
    if not 0 <= length - SEED < 16:
        raise ValueError(f"length must be {SEED} to {SEED + 15} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tag", F.xxhash64("text").bitwiseAND(F.lit(TAG)))
    base = rows.where("doc_id is not null")
    spans = repeats(base, length).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = base.join(spans, (base["doc_id"] == spans["doc"]) & (base["tag"] == spans["tag"]), "left").select("doc_id", "text", "spans")
    kind = "array<struct<start:bigint,stop:bigint>>"

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            counts, gone_n, kept = [], [], []
            for text, spans in zip(b.column(1), b.column(2)):
                data = np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8)
                starts, ends = hasher.bounds(data)
                edge = np.zeros(len(starts) + 1, np.int64)
                if spans.is_valid:
                    flat = spans.values.flatten()
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts.append(len(starts))
                gone_n.append(int(gone.sum()))
                kept.append(_remove(data, starts, ends, gone).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "text"])

    whole = joined.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(kind).alias("spans")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("text", T.StringType())])
    return whole.mapInArrow(run, schema)
