"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits.  A seed is the hash of the
words at the ``1`` positions of a fixed mask, so it still matches where a word
at a ``0`` position was replaced.  Seeds of the benchmark are a table; seeds of
the documents are made in one narrow pass, which keeps only those that a
fixed-size bit filter of the benchmark's seeds lets through (no true match is
lost) together with the hashed words around them.  The join on seed hashes
gives (region, item, diagonal) candidates, and each is verified on the words
themselves: the best aligned stretch, at +1 a match and -4 a replaced word, must
have ``min_overlap`` words (or the whole of a shorter item), so at least four
words in five agree.

Cases: null or empty texts match nothing; items of under ``min_item`` words
are no evidence and match nothing; items of fewer words than a mask's span
are looked for as they stand; items with equal words are one, under the smallest
item_id (rows without an item_id only where none has one); repeated documents
each match, and rows without doc_id under null; empty tables give no match;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, mix, staged

#: Fixed masks; 1: the word counts, 0: it may be replaced.
MASKS = ("110100110111", "101110010111", "111001011011", "1110110101")
#: Words of context kept on each side of a seed hit.
CONTEXT = 64
#: Bits of the seed filter: 64 a seed, as a power of two, and no more than 32 MB.
BITS_PER_SEED, MAX_FILTER_BITS, PROBES = 64, 1 << 28, 4

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _tokens(text: str | None, hasher: WordHasher) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    return hasher(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))[0]


def _at_seed(ok: np.ndarray, mask: str) -> np.ndarray:
    """Starts at which ``ok`` holds for every word that ``mask`` looks at."""
    n = len(ok) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    held = np.ones(n, bool)
    for i, m in enumerate(mask):
        if m == "1":
            held &= ok[i:i + n]
    return np.flatnonzero(held)


def _seeds(words: np.ndarray, starts: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seeds of ``mask`` at these starts."""
    out = np.full(len(starts), number + 1, np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out *= np.uint64(0x5851F42D4C957F2D)
            out += words[starts + i]
    return mix(out)


def _masks(short: list[int]) -> list[tuple[int, str]]:
    return [*enumerate(MASKS), *((100 + n, "1" * n) for n in short)]


class BitFilter:
    """Bit table of hashes, of at most 32 MB."""

    def __init__(self, bits: int, probes: int, table: np.ndarray):
        self.bits, self.probes, self.table = bits, probes, table

    @classmethod
    def of(cls, hashes: DataFrame, count: int, probes: int) -> BitFilter:
        """The filter of a column of hashes, OR-ed together by Spark; at most 4 million words reach the driver."""
        out = cls(max(10, min(MAX_FILTER_BITS, BITS_PER_SEED * max(1, count)).bit_length() - 1), probes, np.empty(0, np.uint64))
        place = out.place

        def words(batches):
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                at = np.concatenate([place(h, k) for k in range(probes)])
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                                  pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

        rows = hashes.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
        out.table = np.zeros(1 << (out.bits - 6), np.uint64)
        for r in rows:
            out.table[r["word"]] = np.uint64(r["mask"] & (2**64 - 1))
        return out

    def plain(self) -> tuple:
        """The arguments that make it: a broadcast of them needs no class on the workers."""
        return self.bits, self.probes, self.table

    def place(self, h: np.ndarray, k: int) -> np.ndarray:
        return (h * np.uint64(2 * k + 1) + (h >> np.uint64(29)) * np.uint64(k)) >> np.uint64(64 - self.bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be in the table (all that are, are)."""
        ok = np.arange(len(h))
        for k in range(self.probes):
            p = self.place(h[ok], k)
            ok = ok[(self.table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0]
        out = np.zeros(len(h), bool)
        out[ok] = True
        return out


def _items(benchmark: DataFrame, min_item: int) -> DataFrame:
    """Distinct items: item_key, item_id, n_words, words (hashes), ids (number of rows)."""
    def run(batches):
        hasher = WordHasher(space=NOT_WORD)
        for b in batches:
            w = [_tokens(t.as_py(), hasher) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in w], pa.int32()), pa.array([x.tobytes() for x in w], pa.binary())],
                                             names=["item_id", "n_words", "words"])

    schema = T.StructType([benchmark.schema["item_id"], T.StructField("n_words", T.IntegerType()), T.StructField("words", T.BinaryType())])
    rows = benchmark.select("item_id", "text").mapInArrow(run, schema).where(F.col("n_words") >= min_item)
    return (rows.withColumn("item_key", F.xxhash64("words")).groupBy("item_key")
            .agg(F.min("item_id").alias("item_id"), F.first("n_words").alias("n_words"), F.first("words").alias("words")))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, min_item: int = 5) -> DataFrame:
    """Verified overlaps, the longest of each document and item.

    Columns: doc_id, text_hash, item_id, start_word, overlap_words, matched_words,
    item_words.  ``text_hash`` (xxhash64 of the text) tells apart rows of one doc_id.
    """
    items = staged(_items(benchmark, min_item), "decontam-items")
    short = sorted(r[0] for r in items.where(F.col("n_words") < max(map(len, MASKS))).select("n_words").distinct().collect())
    masks = _masks(short)

    def seeds_of(w):
        """Seeds of an item and where they begin."""
        h, at = [], []
        for number, mask in masks:
            if number < 100 or len(w) == len(mask):
                at.append(np.arange(max(0, len(w) - len(mask) + 1)))
                h.append(_seeds(w, at[-1], mask, number))
        return np.concatenate(h), np.concatenate(at)

    def item_seeds(batches):
        for b in batches:
            for key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.unique(seeds_of(np.frombuffer(words, np.uint64))[0])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), key, np.int64))], names=["h", "item_key"])

    seeds = staged(items.select("item_key", "words").mapInArrow(item_seeds, "h long, item_key long"), "decontam-seeds")
    seed_filter = BitFilter.of(seeds.select("h"), seeds.count(), PROBES)

    def item_words(batches):
        for b in batches:
            for words in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(words, np.uint64)).view(np.int64))], names=["h"])

    vocabulary = items.select("words").mapInArrow(item_words, "h long").distinct()
    sent = docs.sparkSession.sparkContext.broadcast((seed_filter.plain(), BitFilter.of(vocabulary, vocabulary.count(), 1).plain()))

    def regions(batches):
        hasher, (seed_filter, word_filter) = WordHasher(space=NOT_WORD), (BitFilter(*x) for x in sent.value)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc, text, text_hash in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = _tokens(text.as_py(), hasher)
                known = word_filter.holds(w)
                hits_at, hits_h = [], []
                for number, mask in masks:
                    at = _at_seed(known, mask)
                    h = _seeds(w, at, mask, number)
                    ok = seed_filter.holds(h)
                    hits_at.append(at[ok])
                    hits_h.append(h[ok])
                at, h = np.concatenate(hits_at), np.concatenate(hits_h)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * CONTEXT) + 1):
                    lo = max(0, int(at[part[0]]) - CONTEXT)
                    hi = min(len(w), int(at[part[-1]]) + 16 + CONTEXT)
                    row += 1
                    out.append((row, doc, text_hash, lo, w[lo:hi].tobytes(), h[part].view(np.int64), (at[part] - lo).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], b.schema.field(0).type), pa.array([o[2] for o in out], pa.int64()),
                    pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.binary()),
                    pa.array([o[5] for o in out], pa.list_(pa.int64())), pa.array([o[6] for o in out], pa.list_(pa.int32()))],
                    names=["region", "doc_id", "text_hash", "lo", "words", "hs", "ats"])

    long = T.LongType()
    schema = T.StructType([T.StructField("region", long), docs.schema["doc_id"], T.StructField("text_hash", long), T.StructField("lo", long),
                           T.StructField("words", T.BinaryType()), T.StructField("hs", T.ArrayType(long)), T.StructField("ats", T.ArrayType(T.IntegerType()))])
    near = staged(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(regions, schema), "decontam-regions")
    # region and item meet once, however many seeds they share; the region's words and hits are beside an item once
    found = near.select("region", F.explode(F.array_distinct("hs")).alias("h")).join(seeds, "h").select("region", "item_key").distinct()
    both = (found.join(near, "region").join(items.select("item_key", "item_id", F.col("words").alias("item")), "item_key")
            .select("doc_id", "text_hash", "lo", "words", "hs", "ats", "item_id", "item"))

    def verify(batches):
        for pdf in batches:
            out = []
            for doc_words, hs, ats, item in zip(pdf["words"], pdf["hs"], pdf["ats"], pdf["item"]):
                d, t = np.frombuffer(doc_words, np.uint64), np.frombuffer(item, np.uint64)
                best = (0, 0, 0)
                for diagonal in _diagonals(np.asarray(hs, np.int64).view(np.uint64), np.asarray(ats, np.int64), *seeds_of(t), len(d), len(t)):
                    a, z = max(0, diagonal), min(len(d), diagonal + len(t))
                    same = d[a:z] == t[a - diagonal:z - diagonal]
                    begin, end = best_stretch(same)
                    if end - begin >= min(min_overlap, len(t)):
                        best = max(best, (int(same[begin:end].sum()), end - begin, -(a + begin)))
                out.append((-best[2], best[1], best[0], len(t)))
            got = pd.DataFrame(out, columns=["at", "overlap_words", "matched_words", "item_words"], index=pdf.index)
            got = pd.concat([pdf[["doc_id", "text_hash", "item_id"]], (got["at"] + pdf["lo"]).rename("start_word"), got.drop(columns="at")], axis=1)
            yield got[got["matched_words"] > 0]

    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", long), benchmark.schema["item_id"],
                           *[T.StructField(n, long) for n in ("start_word", "overlap_words", "matched_words", "item_words")]])
    best = F.struct("matched_words", "overlap_words", (-F.col("start_word")).alias("start"), "item_words")
    return (both.mapInPandas(verify, schema).groupBy("doc_id", "text_hash", "item_id").agg(F.max(best).alias("b"))
            .select("doc_id", "text_hash", "item_id", (-F.col("b.start")).alias("start_word"), "b.overlap_words", "b.matched_words", "b.item_words"))


def _diagonals(hs: np.ndarray, ats: np.ndarray, item_h: np.ndarray, item_at: np.ndarray, n_doc: int, n_item: int) -> np.ndarray:
    """Offsets of an item in a region at which a seed of both agrees, each once, in time of hits times item words."""
    order = np.argsort(hs, kind="stable")
    hs, ats, met = hs[order], ats[order], np.zeros(n_doc + n_item + 1, bool)
    for h, at in zip(item_h, item_at):
        met[ats[np.searchsorted(hs, h):np.searchsorted(hs, h, side="right")] - at + n_item] = True
    return np.flatnonzero(met) - n_item


def best_stretch(same: np.ndarray, misses: int = 4) -> tuple[int, int]:
    """The longest stretch with at least ``misses`` true values for each false one, between true values; (0, 0) if there is none."""
    if not same.any():
        return 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -misses))])
    # for each end, the first start whose sum is no larger
    start = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
    end = int(np.argmax(np.arange(len(total)) - start))
    hits = np.flatnonzero(same[start[end]:end]) + start[end]
    return (int(hits[0]), int(hits[-1]) + 1) if len(hits) else (0, 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns as they were."""
    bad = find_overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"]), "left_anti")
