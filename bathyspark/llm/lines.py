"""Line deduplication: two Bloom filters find suspected repeats, only those shuffle and are counted exactly.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both
ends, A-Z in lower case.  Every task hashes the keys of its documents; what it
has seen once and what it has seen in several documents goes, as sorted
32-bit prints, to the block of the filters that the hash names.  A block's two
filters (once seen, twice seen) are filled from all tasks' prints; a key whose
bits are all set in the first filter goes into the second.  The second filter
is broadcast: it has at most ``FILTER_MB``, whatever the input.  With more
keys than it has room for it lets through more lines that do not repeat, never
fewer that do.  Lines that pass it, and no others, are shuffled as (128-bit
digest of the key, doc_id) and counted exactly; a digest that enough documents
hold stays in the largest of them.

Cases: null and empty texts are one empty line; rows that share a doc_id are
one document (each row is returned, with the same lines gone); rows without
doc_id are together one document, smaller than all others; ties don't occur,
doc_ids being ordered; a document's own repeated lines stay or go together;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

#: Bits of a block of a filter, text bytes that a block is sized for, most bytes of the broadcast filter.
BLOCK_BITS, BLOCK_TEXT, FILTER_MB = 1 << 19, 1 << 22, 64
#: Prints that a task holds before it sends them on.
HELD = 1 << 20
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)

_STRIP = bytes(np.flatnonzero(SPACE).tolist())
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def digests(text: bytes, least: int) -> list[bytes | None]:
    """For each line the 128-bit digest of its key, or None where the key has fewer than ``least`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP)
        if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.translate(_LOWER)))
    return out


def _parts(marks: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and print of 64-bit hashes."""
    return ((marks >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32), marks.astype(np.uint32)


def _bits(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each print in its block."""
    mask = np.uint32(BLOCK_BITS - 1)
    return prints & mask, ((prints * np.uint32(0x9E3779B1)) >> np.uint32(11)) & mask


def _prints(docs: DataFrame, least: int, blocks: int) -> DataFrame:
    """(block, again, prints): keys that a task has met in one document, and (again) in several."""
    def send(seen):
        marks, count = np.unique(np.concatenate(seen), return_counts=True)
        block, prints = _parts(marks, blocks)
        again = count > 1
        order = np.lexsort((prints, again, block))
        group = block[order].astype(np.int64) * 2 + again[order]
        cut = np.flatnonzero(np.diff(group)) + 1
        starts = np.append(0, cut)
        packed = [p.tobytes() for p in np.split(prints[order], cut)]
        return pa.RecordBatch.from_arrays([pa.array(block[order][starts]), pa.array(again[order][starts]), pa.array(packed, pa.binary())],
                                          names=["block", "again", "prints"])

    def run(batches):
        seen, held = [], 0
        for b in batches:
            for text in b.column(0):
                own = {d for d in digests((text.as_py() or "").encode("utf-8", "replace"), least) if d}
                if own:
                    seen.append(np.frombuffer(b"".join(own), np.uint64)[::2])
                    held += len(own)
                if held >= HELD:
                    yield send(seen)
                    seen, held = [], 0
        if held:
            yield send(seen)

    return docs.select("text").mapInArrow(run, "block int, again boolean, prints binary")


def _twice(prints: DataFrame) -> DataFrame:
    """(block, bits): the twice-seen filter, from a once-seen one that stays in the task."""
    def run(batches):
        block, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            for number, again, packed in zip(*(b.column(i) for i in range(3))):
                if number.as_py() != block:
                    if block is not None and twice.any():
                        yield done()
                    block, once, twice = number.as_py(), np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                i, j = _bits(np.frombuffer(packed.as_py(), np.uint32))
                met = slice(None) if again.as_py() else once[i] & once[j]
                twice[i[met]] = twice[j[met]] = True
                once[i] = once[j] = True
        if block is not None and twice.any():
            yield done()

    return prints.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")


def _suspects(docs: DataFrame, least: int, blocks: int, twice) -> DataFrame:
    """(digest, doc): each document's keys that pass the twice-seen filter."""
    def run(batches):
        rows, filters = twice.value
        for b in batches:
            out, ids = [], []
            for doc, text in zip(b.column(0), b.column(1)):
                own = list({d for d in digests((text.as_py() or "").encode("utf-8", "replace"), least) if d})
                if not own:
                    continue
                block, prints = _parts(np.frombuffer(b"".join(own), np.uint64)[::2], blocks)
                row = rows[block]
                some = np.flatnonzero(row >= 0)
                for bit in _bits(prints):
                    some = some[(filters[row[some], bit[some] >> 3] >> (7 - (bit[some] & 7)).astype(np.uint8)) & 1 == 1]
                out += [own[k] for k in some]
                ids += [doc.as_py()] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], names=["digest", "doc"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text").mapInArrow(run, "digest binary, doc long")


def repeated_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, filter_mb: int = FILTER_MB) -> DataFrame:
    """(doc, digest): the keys whose lines document ``doc`` loses (``doc`` is NO_ID for a missing doc_id)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(-(-size // BLOCK_TEXT), filter_mb * (1 << 20) * 8 // BLOCK_BITS))
    found = staged(_twice(_prints(docs, least_chars, blocks)), "lines-twice").collect()  # at most filter_mb
    rows = np.full(blocks, -1, np.int64)
    rows[[r["block"] for r in found]] = np.arange(len(found))
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(-1, BLOCK_BITS // 8)
    twice = spark.sparkContext.broadcast((rows, bits))
    suspects = staged(_suspects(docs, least_chars, blocks, twice), "lines-suspects")
    twice.destroy()
    exact = staged(suspects.groupBy("digest").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("last"))
                   .where(F.col("n") >= least_docs).select("digest", "last"), "lines-repeated")
    return suspects.join(exact, "digest").where(F.col("doc") != F.col("last")).select("doc", "digest")


def drop_repeated_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, filter_mb: int = FILTER_MB) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, text (the lines that stay).

    Lines whose key has at least ``least_chars`` code points and is found in at
    least ``least_docs`` documents stay only in the largest doc_id that holds it.
    """
    gone = repeated_lines(docs, least_docs, least_chars, filter_mb).groupBy("doc").agg(F.collect_set("digest").alias("gone"))

    def run(batches):
        for b in batches:
            lines, dropped, texts = [], [], []
            for text, gone in zip(b.column(1), b.column(2)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                every, gone = data.split(b"\n"), set(gone.as_py() or ())
                kept = [x for x, d in zip(every, digests(data, least_chars)) if d not in gone] if gone else every
                lines.append(len(every))
                dropped.append(len(every) - len(kept))
                texts.append(b"\n".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    return rows.join(gone, "doc", "left").select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")
