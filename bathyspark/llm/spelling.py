"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word is the point of its letter counts.  One replaced letter moves it by an
L1 distance of two at most, one inserted or deleted letter by one; so the words near a
word lie in a small box search among those of its own length (distance 2) and
of the next length (distance 1).  For every length a tree's upper levels, fitted to a
bounded sample of the words, cut the space into cells.  A word is a member of the
cell that its point falls into and visits each cell whose box is close enough;
of two words of one length the one with the earlier cell visits, so each pair meets
once.  In a cell the tree goes on over the cell's members, down to small
leaves; what reaches a leaf is compared by a bit form of the counts, then by
the order of the letters.  Cells are cut into blocks of bounded size, however many words fall into one.

Cases: null texts have no words; texts without doc_id count as of an empty
doc_id; rows that share a doc_id all count; words without a near word are returned
with null ``form``; ties of ``n`` go to the smallest word in code-point order;
very long words only meet words of their length and the next; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_bounds, grouped_map, staged

#: Words of the sample that trees' upper levels are fitted to, words that a cell is sized for, members of a block and of a leaf.
SAMPLE, CELL, BLOCK, LEAF = 1 << 16, 4096, 8192, 48
#: Longer words have no tree and are compared as texts.
LONG = 128
#: Words that a task counts before it sends them on.
HELD = 1 << 18

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_RUN = b"[a-z\xc0-\xff]"


def runs(text: str | None, least: int = 1) -> list[bytes]:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased, in Latin-1 (one byte a code point)."""
    data = (text or "").encode("latin-1", "replace").translate(_LOWER)
    return re.findall(_RUN + b"{%d,}" % least, data)


def word_counts(docs: DataFrame, least: int = 6, drop: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points of ``docs`` (doc_id, text).

    A run whose crc32 with its doc_id ``drop`` divides has lost the code point that the crc names.
    """
    def run(batches):
        held: Counter = Counter()

        def send():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{doc}:".encode())
                for w, n in Counter(runs(text.as_py(), least)).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % drop == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least:
                            continue
                    held[w] += n
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        if held:
            yield send()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- trees
class Words:
    """Words of one length of at most LONG as code points, with their letter counts by column."""

    def __init__(self, words: list[str]):
        self.codes = np.array(words, f"<U{max(map(len, words), default=1)}").view(np.uint32).reshape(len(words), -1)
        self.letters = np.unique(self.codes)
        self._counts: dict[int, np.ndarray] = {}

    def count(self, letter: int) -> np.ndarray:
        if letter not in self._counts:
            self._counts[letter] = (self.codes == letter).sum(1).astype(np.uint8)
        return self._counts[letter]

    def forms(self) -> np.ndarray:
        """64 bits a word: one changed letter count changes one of them at most."""
        out = np.zeros(len(self.codes), np.uint64)
        for letter in self.letters.tolist():
            n = self.count(letter)
            if 97 <= letter <= 122:
                out |= (n > 0).astype(np.uint64) << np.uint64(2 * (letter - 97)) | (n > 1).astype(np.uint64) << np.uint64(2 * (letter - 97) + 1)
            else:
                out |= (n > 0).astype(np.uint64) << np.uint64(52 + letter % 12)
        return out


def split(words: Words, rows: np.ndarray, most: int = 3) -> tuple[int, int] | None:
    """The letter and count that cut ``rows`` into the evenest halves (count or fewer, more); None if all are equal."""
    best, at = 0, None
    for letter in words.letters.tolist():
        n = words.count(letter)[rows]
        for t in range(most):
            low = int((n <= t).sum())
            if min(low, len(rows) - low) > best:
                best, at = min(low, len(rows) - low), (letter, t)
            if low == len(rows):
                break
    return at


def grow(words: Words, rows: np.ndarray, least: int, cells: list):
    """A tree of (letter, count, low, high), with leaf numbers; ``cells`` gets each leaf's rows."""
    at = split(words, rows) if len(rows) > least else None
    if at is None:
        cells.append(rows)
        return len(cells) - 1
    low = words.count(at[0])[rows] <= at[1]
    return (*at, grow(words, rows[low], least, cells), grow(words, rows[~low], least, cells))


def search(tree, words: Words, reach: int):
    """Yields (leaf, rows) of the words whose L1 distance to the leaf's box is at most ``reach``."""
    def off(n, low, high):
        return np.maximum(0, np.maximum(low - n, n - high))

    def walk(node, rows, far, box):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            yield node, rows
            return
        letter, t, below, above = node
        low, high = box.get(letter, (0, 255))
        n = words.count(letter)[rows].astype(np.int16)
        rest = far - off(n, low, high)
        for child, part in ((below, (low, min(high, t))), (above, (max(low, t + 1), high))):
            now = rest + off(n, *part)
            ok = now <= reach
            yield from walk(child, rows[ok], now[ok], box | {letter: part})

    n = len(words.codes)
    yield from walk(tree, np.arange(n), np.zeros(n, np.int16), {})


def _trees(vocab: DataFrame) -> dict[int, object]:
    """For each length up to LONG the upper levels of its tree; at most SAMPLE / LEAF cells in all."""
    size = F.length("word").alias("size")
    short = vocab.where(F.length("word") <= LONG).select("word", size)
    counts = {r["size"]: r["count"] for r in short.groupBy("size").count().collect()}
    part = min(1.0, SAMPLE / max(1, sum(counts.values())))  # so that about SAMPLE words reach the driver
    sample: dict[int, list[str]] = {}
    for r in short.where(F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(part * (1 << 32))).orderBy("word").collect():
        sample.setdefault(r["size"], []).append(r["word"])
    return {n: grow(Words(words), np.arange(len(words)), max(LEAF, CELL * len(words) // counts[n]), []) for n, words in sample.items()}


def _places(vocab: DataFrame, trees: dict[int, object]) -> DataFrame:
    """(size, cell, member, home, word, n): each word in its own cell, and in each cell that it visits.

    ``home`` is a word's own cell among the words of its length, -1 where it visits the next length.
    """
    def run(batches):
        for b in batches:
            words, count = b.column(0).to_pylist(), b.column(1)
            sizes = np.array([len(w) for w in words], np.int64)
            out: list[tuple] = []

            def add(size, cell, member, home, rows):
                out.append(tuple(np.broadcast_to(x, len(rows)) for x in (size, cell, member, home)) + (rows,))

            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size > LONG:
                    add(size, 0, True, 0, rows)
                    add(size, 0, False, 0, rows)
                    add(size + 1, 0, False, -1, rows)
                    continue
                here, home = Words([words[r] for r in rows]), np.zeros(len(rows), np.int64)
                for cell, own in search(trees.get(size, 0), here, 0):
                    home[own] = cell
                add(size, home, True, home, rows)
                for cell, own in search(trees.get(size, 0), here, 2):
                    own = own[home[own] <= cell]
                    add(size, cell, False, home[own], rows[own])
                for cell, own in search(trees.get(size + 1, 0), here, 1):
                    add(size + 1, cell, False, -1, rows[own])
            cols = [np.concatenate([x[k] for x in out]).astype(t) if out else np.empty(0, t) for k, t in enumerate((np.int64, np.int64, bool, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:4]), b.column(0).take(pa.array(cols[4])), count.take(pa.array(cols[4]))],
                                             names=["size", "cell", "member", "home", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "size long, cell long, member boolean, home long, word string, n long")


# ---------------------------------------------------------------- pairs
def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` are one edit from the same rows of ``y``, whose words are as long or one letter longer."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    head = np.cumprod(x == y[:, :-1], 1).sum(1)
    tail = np.cumprod((x == y[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= x.shape[1]


def _met(queries: list[str], members: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries and members that are one edit apart; all queries are of one length, all members too."""
    if len(members[0]) > LONG:
        got = [(i, j) for i, q in enumerate(queries) for j, m in enumerate(members) if one_edit(q, m)]
        return (np.array(got, np.int64).reshape(-1, 2)).T
    q, m, cells, left, right = Words(queries), Words(members), [], [], []
    reach = 2 if q.codes.shape[1] == m.codes.shape[1] else 1
    tree = grow(m, np.arange(len(members)), LEAF, cells)
    q_form, m_form = q.forms(), m.forms()
    for leaf, rows in search(tree, q, reach):
        own = cells[leaf]
        for at in range(0, len(rows), 4096):
            part = rows[at:at + 4096]
            i, j = np.nonzero(np.bitwise_count(q_form[part][:, None] ^ m_form[own][None, :]) <= reach)
            i, j = part[i], own[j]
            ok = _edits(q.codes[i], m.codes[j])
            left.append(i[ok])
            right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best): each word's count of near words in a block pair and the best of them."""
    bounds, out = group_bounds(pdf, ["size", "cell", "blk_m", "blk_q"]), []
    words, count, member, cell, home = (pdf[c].to_numpy() for c in ("word", "n", "member", "cell", "home"))
    for s, e in zip(bounds[:-1], bounds[1:]):
        m = s + np.flatnonzero(member[s:e])
        if not len(m):
            continue
        place = np.empty(e - s, np.int64)
        place[np.argsort(words[s:e], kind="stable")] = np.arange(e - s)
        every = s + np.flatnonzero(~member[s:e])
        same = home[every] >= 0
        for q in (every[same], every[~same]):
            if not len(q):
                continue
            i, j = _met(words[q].tolist(), words[m].tolist())
            i, j = q[i], m[j]
            # two words of one cell visit each other: that pair counts once
            once = (home[i] != cell[i]) | (place[i - s] < place[j - s])
            x, y = np.concatenate([i[once], j[once]]), np.concatenate([j[once], i[once]])
            order = np.lexsort((place[y - s], -count[y], words[x]))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.append(True, words[x][1:] != words[x][:-1])) if len(x) else np.empty(0, np.int64)
            out.append((words[x[first]], np.diff(np.append(first, len(x))), count[y[first]], words[y[first]]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (object, np.int64, np.int64, object)]
    return pd.DataFrame({name: pd.Series(c, dtype=c.dtype) for name, c in zip(("word", "n_near", "best_n", "best"), columns)})


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``vocab`` (word, n; distinct) that have a near word; ``best`` has the largest n."""
    placed = staged(_places(vocab, _trees(vocab)), "spelling-places")
    amount = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.length("word"))) / (32 * BLOCK))).cast("int")
    sizes = placed.groupBy("size", "cell").agg(amount(F.col("member")).alias("b_m"), amount(~F.col("member")).alias("b_q")).where("b_m > 0 and b_q > 0")
    number = lambda of: F.pmod(F.xxhash64("word"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    dealt = (placed.join(staged(sizes, "spelling-cells"), ["size", "cell"])
             .withColumn("blk_m", F.explode(F.when(F.col("member"), F.array(number("b_m"))).otherwise(every("b_m"))))
             .withColumn("blk_q", F.explode(F.when(F.col("member"), every("b_q")).otherwise(F.array(number("b_q"))))))
    pairs = grouped_map(dealt.select("size", "cell", "blk_m", "blk_q", "member", "home", "word", "n"), ["size", "cell", "blk_m", "blk_q"], _near,
                        "word string, n_near long, best_n long, best string")
    return (pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.col1")).alias("best_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, root: the next form), followed to the last form by doubling steps.

    Each form is at least five times as frequent as its word, so chains are short and have no circles.
    """
    while True:
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(forms.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forms = step.select("word", "root")
        if not step.where("moved").head(1):
            return forms


def variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, factor: int = 5, drop: int = 199) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of ``docs`` (doc_id, text), as the module says.

    A word's ``form`` is its most frequent near word if that has at least ``factor`` times its occurrences.
    """
    vocab = staged(word_counts(docs, least_chars, drop).where(F.col("n") >= least_n), "spelling-words")
    formed = F.col("best_n") >= factor * F.col("n")
    near = staged(vocab.join(near_words(vocab), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(near.where("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
