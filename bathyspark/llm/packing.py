"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids (its text's, then an end id) are cut into full sequences and
a rest; the rest is cut greedily into pieces whose sizes are ``capacity // k``
for whole ``k``, the reciprocal-capacity classes.  A bin of class ``k`` takes
exactly ``k`` pieces, so bins fill without looking at each other, and every
Spark task fills its own: no shuffle, and state bounded by one open bin per
class.  What is left in open bins at the end of a task is laid end to end, cut
at the capacity, and the last stretch into powers of two, which need no
padding.

Cases: null or empty text is a document of the end id alone; null doc_ids and
repeated rows are documents of their own; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are tokenised so many characters at a time.
SLICE = 2_000_000
#: Words remembered by a task's tokeniser.
WORDS = 600_000


def piece_sizes(capacity: int) -> list[int]:
    """All ``capacity // k``, ascending."""
    return sorted({capacity // k for k in range(1, capacity + 1)})


def cut(length: int, capacity: int, sizes: list[int]) -> list[int]:
    """Piece lengths of a document: full sequences, then the largest class sizes that fit."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        size = sizes[bisect_right(sizes, rest) - 1]
        out.append(size)
        rest -= size
    return out


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE, each distinct word tokenised once per task.

    The vocabulary's pattern never joins text across a space between two
    characters that are none, so a text whose space-separated words neither begin nor end
    with white space is the concatenation of them, each with its leading space.  Other texts are
    tokenised whole.  ``path`` is a vocabulary for ``tokenizers``; ``ranks``,
    where given, is the same vocabulary for ``tiktoken``, which is faster.  Texts
    that hold one of the vocabulary's added tokens go to ``tokenizers`` as they are.
    """

    def __init__(self, path: str, added: list[str], ranks: str | None = None, pattern: str | None = None):
        self.path, self.added, self.coder = path, added, None
        if ranks:
            import tiktoken
            table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(ranks, "rb"))}
            coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.whole = coder.encode_ordinary
            size = np.zeros(max(table.values()) + 1, np.int64)
            for t, i in table.items():
                size[i] = len(t)
            self.size = size
        else:
            self.whole, self.size = self.named, None
        self.clear()

    def named(self, text: str) -> list[int]:
        if self.coder is None:
            from tokenizers import Tokenizer
            self.coder = Tokenizer.from_file(self.path)
        return self.coder.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)  # of each word's ids in flat, and the end

    def _learn(self, words: list[str]) -> None:
        if self.size is None:
            ids = [self.whole(" " + w) for w in words]
            lengths = np.array([len(x) for x in ids], np.int64)
            got = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        else:
            got = np.array(self.whole("".join(" " + w for w in words)), np.uint32)
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            lengths = np.diff(np.searchsorted(np.cumsum(self.size[got]), ends, side="left") + 1, prepend=0)
        used = int(self.first[-1])
        while used + len(got) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used:used + len(got)] = got
        for w in words:
            self.known[w] = len(self.known)
        self.first = np.concatenate([self.first, used + np.cumsum(lengths)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        added = [any(t in x for t in self.added) for x in texts]
        split = [None if a else x.split(" ") for a, x in zip(added, texts)]
        split = [None if x and len(x) > 1 and x[0] and x[0][-1].isspace() else x for x in split]
        if len(self.known) > WORDS:
            self.clear()
        # words with white space at their ends meet only single spaces here, but could meet others when joined
        new = [w for w in {w for x in split if x for w in x[1:]}.difference(self.known)]
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        if plain:
            self._learn(plain)
        odd = set(new).difference(plain)  # "" among them
        out = []
        for text, words, named in zip(texts, split, added):
            if named:
                out.append(np.array(self.named(text), np.uint32))
                continue
            if words is None or (odd and not odd.isdisjoint(words)):
                out.append(np.array(self.whole(text), np.uint32))
                continue
            head = np.array(self.whole(words[0]), np.uint32)
            k = np.fromiter(map(self.known.__getitem__, words[1:]), np.int64, len(words) - 1)
            begin, length = self.first[k], self.first[k + 1] - self.first[k]
            total = int(length.sum())
            at = np.arange(total) + np.repeat(begin - (np.cumsum(length) - length), length)
            out.append(np.concatenate([head, self.flat[at]]))
        return out


class _Bins:
    """One task's open bins; ``add`` gives the rows (document row, start, ids, sequence, offset) of bins that are full."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.sizes, self.next = capacity, piece_sizes(capacity), base
        self.open: dict[int, list] = {}

    def _sequence(self, pieces: list) -> list:
        seq, self.next, at, rows = self.next, self.next + 1, 0, []
        for doc, start, ids in pieces:
            rows.append((doc, start, ids, seq, at))
            at += len(ids)
        return rows

    def add(self, doc, ids: np.ndarray) -> list:
        rows, start = [], 0
        for size in cut(len(ids), self.capacity, self.sizes):
            pieces = self.open.setdefault(size, [])
            pieces.append((doc, start, ids[start:start + size]))
            start += size
            if len(pieces) == self.capacity // size:
                rows += self._sequence(self.open.pop(size))
        return rows

    def close(self) -> list:
        """Lay the open bins' pieces end to end and cut them anew."""
        pieces = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        rest, lengths = sum(len(p[2]) for p in pieces), []
        lengths = [self.capacity] * (rest // self.capacity)
        rest %= self.capacity
        lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        rows, pieces = [], pieces[::-1]
        for room in lengths:
            held = []
            while room:
                doc, start, ids = pieces.pop()
                held.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:]))
                room -= len(held[-1][2])
            rows += self._sequence(held)
        return rows


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
         capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Sequences are independent of the number of executors: one task packs one
    input split, and a lost task repeats with the same result.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    from tokenizers import Tokenizer
    added = [t.content for t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()]

    def run(batches):
        tokens = WordTokenizer(tokenizer_path, added, ranks_path, pattern)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 36)

        def rows_out(rows, doc_type):
            return pa.RecordBatch.from_arrays([
                pa.array([d for (d, _), *_ in rows], doc_type), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                pa.array([n for (_, n), *_ in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64())], names=schema.names)

        kind_out = None
        for batch in batches:
            kind_out = batch.schema.field(0).type
            ids_in, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids_in):
                held, size = [], 0
                while at + len(held) < len(ids_in) and size < SLICE:
                    held.append(texts[at + len(held)].as_py() or "")
                    size += len(held[-1])
                rows = []
                for doc, ids in zip(ids_in[at:at + len(held)], tokens(held)):
                    ids = np.append(ids, np.uint32(end_id))
                    rows += bins.add((doc, len(ids)), ids)
                at += len(held)
                if rows:
                    yield rows_out(rows, kind_out)
        rows = bins.close()
        if rows:
            yield rows_out(rows, kind_out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
