"""Chosen-path similarity join: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Documents with equal shingle sets are one class member from the start, under
the smallest doc_id.  For each run, a set samples about ``1 / b`` of its own
shingles by a hash that all sets share (``b``: the smallest overlap of two
similar sets, as a part of the larger); the sampled shingle is the first step
of a path, and sets that sampled the same one meet in a node.  Nodes with many
sets are split again on further shingles, recursively; small nodes, and those
of the last level, are compared by brute force in blocks on min-hash sketches.  Runs
repeat until a pair at the threshold is met with the target probability.  Sets that share
only a common passage have most of their first nodes small; a set with so many small
ones that a similar set would share one of them isn't split further (see ``enough_for``).

Sketch links only gather candidates: their components are then compared
exactly, set against set, in blocks of bounded size, however large a component is.  Blocks
return counts of links and the links that join trees, never all pairs.

Cases: words are lower-cased runs of anything but white space; texts of one to
four words have one shingle, all of it; null and empty texts link with nothing;
rows without doc_id link only with copies among themselves; rows that share a
doc_id are one document, so of one class; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, WordHasher, block_pairs, components, fresh, gram_hashes, group_bounds, grouped_map, mix, span_links, staged

#: Hashes in a sketch, of one byte each; pairs that agree in fewer than SKETCH_LEAST of 1 are no candidates.
SKETCH, SKETCH_SLACK = 128, 0.13
#: Levels of a path, sets in a node that is compared rather than split, members of a block.
LEVELS, NODE, BLOCK = 3, 128, 512


def runs_for(recall: float, levels: int = 1) -> int:
    """Runs that reach ``recall`` at the threshold, where a set shares one sampled child with its partner on average.

    A pair's shared paths are a branching process of mean one child, which has
    died out after ``levels`` levels with probability ``q``.
    """
    q = 0.0
    for _ in range(levels):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def enough_for(runs: int, least: float, loss: float = 2e-4) -> int:
    """So many paths to small nodes that a similar pair shares one of them but for a probability of ``loss``.

    On average a set shares ``1`` of its ``1 / least`` paths a run with a similar set.  If it shares
    none that ends in a small node, all its paths to small nodes are among the
    others, of which it has a Poisson number.
    """
    mean, n = runs * (1 / least - 1), 0
    term = rest = math.exp(-mean)
    while 1 - rest > loss:
        n += 1
        term *= mean / n
        rest += term
    return n + 1


def shingles(text: str | None, hasher: WordHasher, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    words = hasher(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))[0]
    h = np.sort(gram_hashes(words, min(k, len(words)) or 1))
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 0x632BE59BD9B4E019)) | np.uint64(1)


def sketch(x: np.ndarray, factors: np.ndarray) -> bytes:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (factors[:, None] * x[None, at:at + 1024]).min(1))
    return (mix(low) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sampled(x: np.ndarray, fronts: np.ndarray, level: int, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which elements each path samples at this level: (path number, element number)."""
    factor = mix(fronts ^ np.uint64(level)) | np.uint64(1)
    rows, cols = [], []
    for at in range(0, len(x), 2048):
        part = x[at:at + 2048]
        r, c = np.divmod(np.flatnonzero(factor[:, None] * part[None, :] <= limit), len(part))
        rows.append(r)
        cols.append(c + at)
    return np.concatenate(rows), np.concatenate(cols)


def paths(x: np.ndarray, runs: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen paths of a set: node, the node above, level."""
    limit = np.uint64(min(2**64 - 1, int(min(1.0, 1 / (least * len(x))) * 2**64)))
    front = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    node, above, level = [], [], []
    for lev in range(1, LEVELS + 1):
        r, c = _sampled(x, front, lev, limit)
        above.append(front[r])
        front = mix(x[c] ^ front[r])
        node.append(front)
        level.append(np.full(len(r), lev, np.int32))
        if not len(front):
            break
    return np.concatenate(node).view(np.int64), np.concatenate(above).view(np.int64), np.concatenate(level)


def _features(docs: DataFrame, k: int, runs: int, least: float) -> DataFrame:
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", long), T.StructField("h1", long), T.StructField("h2", long), T.StructField("size", T.IntegerType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.ArrayType(T.StructType([
                               T.StructField("node", long), T.StructField("above", long), T.StructField("level", T.IntegerType())])))])
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def run(batches):
        hasher, factors = WordHasher(), _odd(3, SKETCH)
        for b in batches:
            h1, h2, size, marks, steps = [], [], [], [], []
            for text in b.column(1):
                x = shingles(text.as_py(), hasher, k)
                h1.append(x.sum(dtype=np.uint64).view(np.int64))
                h2.append(mix(x * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64))
                size.append(len(x))
                marks.append(sketch(x, factors) if len(x) else None)
                steps.append(paths(x, runs, least) if len(x) else none)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([s[i] for s in steps]) if steps else none[i]) for i in range(3)],
                                              names=["node", "above", "level"])
            ends = pa.array(np.cumsum([0, *(len(s[0]) for s in steps)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int32()),
                                              pa.array(marks, pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _leaf_members(reps: DataFrame, enough: int) -> DataFrame:
    """(node, id) of the nodes to compare: small ones under split nodes, and all of the last level.

    A set with ``enough`` paths whose first node is small goes no deeper.
    """
    leaves, split = None, None
    for level in range(1, LEVELS + 1):
        if split is None:
            steps = reps.select("doc_id", F.filter("paths", lambda p: p["level"] == 1).alias("steps"))
        else:
            steps = reps.join(split.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", F.filter(
                "paths", lambda p: (p["level"] == level) & F.array_contains("nodes", p["above"])).alias("steps"))  # noqa: B023
        rows = staged(steps.select(F.col("doc_id").alias("id"), F.size("steps").alias("n_steps"), F.explode("steps.node").alias("node")).distinct(), f"jaccard-paths{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        small = sizes if level == LEVELS else sizes.where(F.col("n") <= NODE)
        part = rows.join(small.select("node"), "node", "left_semi").select("node", "id")
        leaves = part if leaves is None else leaves.unionByName(part)
        if level < LEVELS:  # a set's paths are few, so are its nodes
            large = rows.join(sizes.where(F.col("n") > NODE).select("node"), "node", "left_semi").groupBy("id").agg(
                F.collect_set("node").alias("nodes"), (F.first("n_steps") - F.count(F.lit(1))).alias("light"))
            split = staged(large if level > 1 else large.where(F.col("light") < enough), f"jaccard-large{level}").select("id", "nodes")
    return leaves


def _sketch_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    keys = ["node", "blk_a", "blk_b"]
    pdf = pdf.drop_duplicates([*keys, "id"]).reset_index(drop=True)
    bounds = group_bounds(pdf, keys)
    ids, out = pdf["id"].to_numpy(), []
    marks = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SKETCH) if len(pdf) else np.zeros((0, SKETCH), np.uint8)
    blk, a_col, b_col = (pdf[c].to_numpy() for c in ("blk", "blk_a", "blk_b"))
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        if e - s == 2:
            if (marks[s] == marks[s + 1]).sum() >= least * SKETCH and ids[s] != ids[s + 1]:
                out.append((ids[s], ids[s + 1]))
            continue
        one = a_col[s] == b_col[s]
        left = np.arange(e - s) if one else np.flatnonzero(blk[s:e] == a_col[s])
        right = left if one else np.flatnonzero(blk[s:e] == b_col[s])
        own, forest = marks[s:e], Forest(e - s)
        # links within a block are returned where it is paired with itself; here they only join trees
        for rows_of, cols_of in ((left, right),) if one else ((left, left), (right, right), (left, right)):
            forest.kept.clear()
            for at in range(0, len(rows_of), 64):
                rows = rows_of[at:at + 64]
                linked = (own[rows][:, None, :] == own[cols_of][None, :, :]).sum(2) >= least * SKETCH
                linked &= ids[s + rows][:, None] != ids[s + cols_of][None, :]
                span_links(linked, rows, cols_of, forest)
        out += [(ids[s + i], ids[s + j]) for i, j in forest.kept]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def overlap_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of indicator matrices of so many columns."""
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    shared = np.intersect1d(flat_a, flat_b)
    row_a, row_b = np.repeat(np.arange(len(sets_a)), list(map(len, sets_a))), np.repeat(np.arange(len(sets_b)), list(map(len, sets_b)))
    at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    for at, flat in ((at_a, flat_a), (at_b, flat_b)):
        if len(shared):
            at[shared[np.minimum(at, len(shared) - 1)] != flat] = -1
    for lo in range(0, len(shared), columns):
        width, part = min(columns, len(shared) - lo), []
        for at, row, n in ((at_a, row_a, len(sets_a)), (at_b, row_b, len(sets_b))):
            m = np.zeros((n, width), np.float32)
            ok = (at >= lo) & (at < lo + width)
            m[row[ok], at[ok] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _exact_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    keys = ["component", "blk_a", "blk_b"]
    pdf = pdf.drop_duplicates([*keys, "id"]).reset_index(drop=True)
    bounds, out = group_bounds(pdf, keys), []
    ids, copies, blk, a_col, b_col = (pdf[c].to_numpy() for c in ("id", "copies", "blk", "blk_a", "blk_b"))
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        one = a_col[s] == b_col[s]
        left = np.arange(s, e) if one else s + np.flatnonzero(blk[s:e] == a_col[s])
        right = left if one else s + np.flatnonzero(blk[s:e] == b_col[s])
        if not len(left) or not len(right):
            continue
        both = overlap_counts([sets[i] for i in left], [sets[i] for i in right])
        size_l, size_r = (np.array([len(sets[i]) for i in x], np.float64) for x in (left, right))
        linked = both >= threshold * (size_l[:, None] + size_r[None, :] - both) - 1e-9
        if one:
            np.fill_diagonal(linked, False)
        counts = np.zeros(e - s, np.int64)
        counts[left - s] += (linked * copies[right][None, :]).sum(1)
        if not one:
            counts[right - s] += (linked * copies[left][:, None]).sum(0)
        forest = Forest(e - s)
        span_links(linked, left - s, right - s, forest)
        out += [(ids[s + i], None, n) for i, n in enumerate(counts.tolist()) if n]
        out += [(ids[s + i], ids[s + j], 0) for i, j in forest.kept]
    got = pd.DataFrame(out, columns=["id", "other", "links"])
    return got.astype({"id": "int64", "other": "Int64", "links": "int64"})


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, component_id, n_links, kept.

    ``n_links`` counts the other documents linked directly, copies among them;
    ``component_id`` is the smallest doc_id reachable over links; ``kept`` holds for that
    document.  ``recall`` is the share of pairs exactly at the threshold that the runs
    must meet in nodes of the last level, with all above split; fewer splits lose fewer.
    """
    runs = runs_for(recall, LEVELS)
    feats = staged(_features(docs, k, runs, threshold), "jaccard-features")
    groups = (feats.where("size > 0").groupBy("h1", "h2", "size")
              .agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("copies"), F.count(F.lit(1)).alias("n_rows")))
    member = staged(feats.where("size > 0").select("doc_id", "h1", "h2", "size").join(groups, ["h1", "h2", "size"])
                    .select("doc_id", "h1", "node", F.when(F.col("node").isNull(), F.col("n_rows")).otherwise(F.col("copies")).alias("copies")), "jaccard-members")
    chosen = member.where("doc_id = node").select("doc_id", "h1", "copies").distinct()
    reps = feats.join(chosen.select("doc_id", "h1"), ["doc_id", "h1"], "left_semi")
    leaves = staged(_leaf_members(reps, enough_for(runs, threshold)), "jaccard-leaves")
    marked = leaves.join(reps.select(F.col("doc_id").alias("id"), "sketch"), "id")
    least = threshold - SKETCH_SLACK
    near = grouped_map(block_pairs(marked, ["node"], "id", BLOCK).select("node", "blk_a", "blk_b", "blk", "id", "sketch"), ["node", "blk_a", "blk_b"],
                       lambda pdf: _sketch_links(pdf, least), "u long, v long")
    close = components(near, "jaccard-candidates")

    def sets(batches):
        hasher = WordHasher()
        for b in batches:
            x = [shingles(t.as_py(), hasher, k).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.binary())], names=["id", "component", "copies", "shingles"])

    wanted = close.join(chosen.select(F.col("doc_id").alias("id"), "copies"), "id")
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id").select("id", "component", "copies", "text")
             .mapInArrow(sets, "id long, component long, copies long, shingles binary"))
    links = staged(grouped_map(block_pairs(texts, ["component"], "id", BLOCK).select("component", "blk_a", "blk_b", "blk", "id", "copies", "shingles"),
                               ["component", "blk_a", "blk_b"], lambda pdf: _exact_links(pdf, threshold), "id long, other long, links long", rows=512), "jaccard-links")
    final = components(links.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), "jaccard-classes")
    counts = links.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    per_node = final.join(counts, "id", "left").select(F.col("id").alias("node"), "component", F.coalesce("links", F.lit(0)).alias("links"))
    linked = member.join(per_node, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = feats.where("size = 0").select("doc_id", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of ``docs`` and every row that is in none, all columns as they were.

    Here every row is a document of its own, with or without doc_id.  The row
    with the smallest doc_id stays (rows without one come last, ties go by the text's hash).
    Rows with null or empty texts, or such without words, are in no class.
    """
    uid, order = fresh("uid", docs.columns), "_order"
    rows = staged(docs.withColumn(uid, F.monotonically_increasing_id()), "jaccard-rows")  # numbered once, so a retry can't renumber
    linked = near_duplicates(rows.select(F.col(uid).alias("doc_id"), "text"), **options).where("n_links > 0").select(F.col("doc_id").alias(uid), "component_id")
    keyed = staged(linked.join(rows.select(uid, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(uid)).alias(order)), uid), "jaccard-linked")
    best = keyed.groupBy("component_id").agg(F.min(order).alias("best"))
    gone = keyed.join(best, "component_id").where(F.col(order) != F.col("best")).select(uid)
    return rows.join(gone, uid, "left_anti").select(docs.columns)
