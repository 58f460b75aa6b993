"""Text vectors and exact nearest-neighbour search (V1-V6).

V1, TF-IDF: tokens, term counts, document frequencies and the vocabulary are
grouped aggregations; the vocabulary is the top ``max_features`` terms by
corpus frequency (a bounded top-k), broadcast as a table of at most
``max_features`` rows.  Weights are ``tf * (ln((1+n)/(1+df)) + 1)``,
L2-normalised per document.  The model is fitted once on the corpus, so
corpus and query vectors live in the same space.

V2/V3, exact squared-L2 kNN: corpus vectors lie with their nearest pivot (a
bounded sample), each pivot's in rings by their distance to it.  A query first
reads the block it would lie in itself; its k-th distance there and the triangle
inequality say which other blocks can hold anything nearer, and only those
are read.  Blocks of queries and of corpus vectors have a checked size; each pair is
one co-grouped task, an equi-join on block numbers.  A single-precision matrix
product, tile by tile, says with a bounded error which pairs can be near enough; NumPy computes
these pairs' distances, and the task keeps its own top k per query (by
rounded distance, then id).  The driver sees the pivots and block bounds only.

V2 on sparse vectors without negative weights (``knn_sparse``) uses inverted
lists with bounds: corpus vectors are dealt into small blocks of like ones, a
block's posting of a term is the largest weight in it, and a join on terms
bounds every query's distance to a block.  The nearest blocks give each query a
distance that its k-th neighbour can't exceed; of the others only those are
read whose bound is no larger.  Equal query vectors are searched once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bathyspark.schemas import STOP_WORDS
from bathyspark.session import cut_lineage

# The kNN scan runs helpers of this module inside Python workers.  Ship them
# by value with each task, so executors need NumPy and pandas but not this
# package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: package must be installed
    pass

TOKEN_PATTERN = r"(?U)\b\w\w+\b"
DISTANCE_DECIMALS = 6
DEFAULT_BLOCK_BYTES = 16 << 20  # bytes of dense vectors per block of either side


# --------------------------------------------------------------------------- V1
@dataclass
class TfidfModel:
    vocab: DataFrame  # term, term_index, idf
    max_features: int


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term) for every kept token: 2+ word characters, lower-cased,
    English stop words removed by a broadcast anti join (a fixed list)."""
    spark = docs.sparkSession
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)
    exploded = docs.select(F.col(id_col).alias("doc"), F.explode(toks).alias("term"))
    return exploded.join(F.broadcast(stop), "term", "left_anti").select("doc", "term")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf)."""
    return _tokens(docs, id_col, text_col).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def _fit(tf: DataFrame, n_docs: int, max_features: int) -> TfidfModel:
    dfs = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    top = dfs.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    w = Window.orderBy(F.col("total").desc(), F.col("term"))  # over at most max_features rows
    vocab = top.select("term", (F.row_number().over(w) - 1).alias("term_index"),
                       (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))
    # at most max_features rows: fetch once and keep as a local relation, so
    # every later transform reuses the fitted vocabulary instead of refitting
    spark = tf.sparkSession
    return TfidfModel(spark.createDataFrame(vocab.collect(), vocab.schema), max_features)


def _weigh(model: TfidfModel, tf: DataFrame) -> DataFrame:
    # the vocabulary has at most max_features rows: a proven broadcast bound
    w = tf.join(F.broadcast(model.vocab), "term").select(
        "doc", "term_index", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "term_index", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_fit(docs: DataFrame, id_col: str, text_col: str, max_features: int = 1000) -> TfidfModel:
    return _fit(term_counts(docs, id_col, text_col), docs.count(), max_features)


def tfidf_transform(model: TfidfModel, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse long form: (doc, term_index, weight), L2-normalised per doc."""
    return _weigh(model, term_counts(docs, id_col, text_col))


def tfidf_fit_transform(docs: DataFrame, id_col: str, text_col: str, max_features: int = 1000) -> tuple[TfidfModel, DataFrame]:
    """Model and vectors of one corpus, whose texts are tokenised and counted once."""
    tf = cut_lineage(term_counts(docs, id_col, text_col))
    model = _fit(tf, docs.count(), max_features)
    return model, _weigh(model, tf)


def to_sparse(sparse: DataFrame, docs: DataFrame | None = None, id_col: str = "doc") -> DataFrame:
    """(doc, embedding STRUCT<indices ARRAY<INT>, values ARRAY<DOUBLE>>).

    Entries are sorted by index; a document has at most ``max_features``
    entries, so its group is bounded.  Docs without any vocabulary term get
    an empty vector when ``docs`` is given.
    """
    per_doc = sparse.groupBy("doc").agg(F.array_sort(F.collect_list(
        F.struct(F.col("term_index").cast("int").alias("i"), F.col("weight").alias("v")))).alias("e"))
    if docs is not None:
        per_doc = docs.select(F.col(id_col).alias("doc")).join(per_doc, "doc", "left")
    e = F.coalesce(F.col("e"), F.array().cast("array<struct<i:int,v:double>>"))
    return per_doc.select("doc", F.struct(F.col("e.i").alias("indices"), F.col("e.v").alias("values")).alias("embedding")
                          ).select("doc", F.struct(F.coalesce(F.col("embedding.indices"), F.array().cast("array<int>")).alias("indices"),
                                                   F.coalesce(F.col("embedding.values"), F.array().cast("array<double>")).alias("values")).alias("embedding"))


def _two_arrays(df: DataFrame, vec: str, out: str) -> list[Column]:
    """A vector column as two array columns: indices (null if dense) and values."""
    kind = _values_type(df, vec)
    if isinstance(df.schema[vec].dataType, T.StructType):
        return [F.col(f"{vec}.indices").cast("array<int>").alias(f"{out}_at"), F.col(f"{vec}.values").cast(kind).alias(f"{out}_values")]
    return [F.lit(None).cast("array<int>").alias(f"{out}_at"), F.col(vec).cast(kind).alias(f"{out}_values")]


def _values_type(df: DataFrame, vec: str) -> str:
    """Floats travel as floats, all else as doubles."""
    kind = df.schema[vec].dataType
    kind = kind["values"].dataType if isinstance(kind, T.StructType) else kind
    return "array<float>" if isinstance(kind.elementType, T.FloatType) else "array<double>"


def _as_matrix(at: pa.Array, values: pa.Array, dim: int) -> np.ndarray:
    """Rows of a dense matrix of doubles from arrays of indices and values; null indices: dense values.

    A row without a vector, or with a null in it, holds NaN.
    """
    held, size = values.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(values), 0).to_numpy()
    flat = pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(np.float64)
    dense = at.null_count == len(at)
    if dense and held.all() and (size == dim).all():
        return flat.reshape(len(values), dim)
    if dense and (size[held] != dim).any():
        raise ValueError(f"vectors of {sorted(set(size[held].tolist()))} values where there should be {dim}")
    out = np.zeros((len(values), dim))
    if dense:
        out[held] = flat.reshape(-1, dim)
    else:
        out[np.repeat(np.arange(len(values)), size), pc.list_flatten(at).to_numpy(zero_copy_only=False).astype(np.int64)] = flat
    out[~held] = np.nan
    return out


def _matrix_of(table: pa.Table | pa.RecordBatch, out: str, dim: int) -> np.ndarray:
    at, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table.column(f"{out}_at"), table.column(f"{out}_values")))
    return _as_matrix(at, values, dim)


def _id_type(df: DataFrame, col: str) -> str:
    """Ids are text or whole numbers."""
    return "string" if isinstance(df.schema[col].dataType, T.StringType) else "long"


def _id_array(ids: pa.ChunkedArray) -> np.ndarray:
    """Ids as a sortable array: 64-bit integers, or text (code-point order, as in SQL)."""
    return ids.to_numpy().astype(np.int64) if pa.types.is_integer(ids.type) else ids.to_numpy().astype(str)


# --------------------------------------------------------------------------- V2
PAIRS_AT_ONCE = 1 << 14  # pairs whose exact distance is computed together


def _distances(q_columns: np.ndarray, c_columns: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded distances of pairs of columns, each the left-to-right sum over dimensions."""
    out = np.empty(len(row))
    for lo in range(0, len(row), PAIRS_AT_ONCE):
        at = slice(lo, lo + PAIRS_AT_ONCE)
        diff = q_columns.take(row[at], axis=1) - c_columns.take(col[at], axis=1)
        diff *= diff
        out[at] = diff.sum(axis=0) if len(diff) else 0.0
    return np.round(out, DISTANCE_DECIMALS)


def _nearest(q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, reach: np.ndarray | None = None,
             cells: int = 1 << 20, width: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, distance) of the k rows of c nearest to each row of q, sorted by distance, then id.

    Pairs farther apart than ``reach`` are left out.  A matrix product of single
    precision, taken tile by tile of ``cells`` pairs, says which pairs can be
    among the k nearest; its error is bounded, and only these pairs' distances are
    computed.  Rows with NaN or infinities have no neighbours and are none.
    """
    c_fine, q_fine = (np.flatnonzero(np.isfinite(x).all(1)) for x in (c, q))
    c, c_ids, q = c[c_fine], c_ids[c_fine], q[q_fine]
    limit = np.full(len(q), np.inf) if reach is None else reach[q_fine].astype(np.float64)
    found: list[tuple] = []
    if not len(c) or not len(q) or k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    id_order = np.empty(len(c), np.int64)
    id_order[np.argsort(c_ids, kind="stable")] = np.arange(len(c))  # ties go by the id's place among the ids
    dim, middle = q.shape[1], c.mean(0)
    q_near, c_near = q - middle, c - middle
    q_square, c_square = (q_near * q_near).sum(1), (c_near * c_near).sum(1)
    most = (np.sqrt(q_square) + np.sqrt(c_square.max())) ** 2
    kind = np.float32 if most.max() < 1e30 else np.float64
    margin = 2 * 10.0 ** -DISTANCE_DECIMALS + (dim + 16) * np.finfo(kind).eps * most
    left = np.concatenate([-2 * q_near, np.ones((len(q), 1))], axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate([c_near, c_square[:, None]], axis=1).astype(kind).T)
    del q_near, c_near
    c_columns = np.ascontiguousarray(c.T)
    width = min(width, len(c))
    step = max(1, cells // width)
    for top in range(0, len(q), step):
        rows = slice(top, min(len(q), top + step))
        here, q_columns = left[rows], np.ascontiguousarray(q[rows].T)
        n = len(here)
        off, slack, bound = q_square[rows], margin[rows], limit[rows].copy()
        best_row, best_col, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        product, keep = np.empty((n, width), kind), np.empty((n, width), bool)
        waiting: list[tuple] = []
        for lo in range(0, len(c), width):
            wide = min(width, len(c) - lo)
            d, near = (product, keep) if wide == width else (np.empty((n, wide), kind), np.empty((n, wide), bool))
            np.matmul(here, right[:, lo:lo + wide], out=d)
            if lo == 0 and wide >= k:  # k rows of the first tile are as near as this
                bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1] + off + slack)
            np.less_equal(d, (bound - off + slack).astype(kind)[:, None], out=near)
            row, col = np.divmod(np.flatnonzero(near), wide)
            waiting.append((row, col + lo))
            if sum(len(x) for x, _ in waiting) < n * k and lo + wide < len(c):
                continue
            row, col = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            exact = _distances(q_columns, c_columns, row, col)
            fit = exact <= bound[row] + slack[row]
            row, col, exact = (np.concatenate(x) for x in ((best_row, row[fit]), (best_col, col[fit]), (best_d, exact[fit])))
            order = np.lexsort((id_order[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best_row, best_col, best_d = (x[place < k] for x in (row, col, exact))
            bound[row[place == k - 1]] = np.minimum(bound[row[place == k - 1]], exact[place == k - 1])
        fit = best_d <= limit[rows][best_row]
        found.append((q_fine[best_row[fit] + top], c_fine[best_col[fit]], best_d[fit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _vectors(df: DataFrame, id_col: str, vec: str, out: str) -> DataFrame:
    """(``out``id, ``out``_at, ``out``_values) of the rows that have an id."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(_id_type(df, id_col)).alias(f"{out}id"), *_two_arrays(df, vec, out))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots; rows without a vector lie with the first pivot."""
    x = np.where(np.isfinite(x).all(1)[:, None], x, pivots[:1])
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


@dataclass
class Partitions:
    """Corpus vectors by nearest pivot, each pivot's in rings by their distance to it; a (pivot, ring) is a block."""

    pivots: np.ndarray
    rings: list[np.ndarray]  # of each pivot the largest distance of its rings, ascending; the least of the first ring is 0

    @property
    def single(self) -> bool:
        return sum(map(len, self.rings)) == 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot and ring of each row, and its distances to all pivots."""
        far = _to_pivots(x, self.pivots)
        pivot = far.argmin(1)
        own = far[np.arange(len(x)), pivot]
        ring = np.array([min(int(np.searchsorted(self.rings[p], d)), len(self.rings[p]) - 1) for p, d in zip(pivot, own)], np.int64)
        return pivot, ring, far

    def bounds(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (pivot, ring) and the least distance that a row so far from the pivots can have to a vector there."""
        pivot = np.repeat(np.arange(len(self.rings)), [len(r) for r in self.rings])
        ring = np.concatenate([np.arange(len(r)) for r in self.rings])
        low = np.concatenate([np.append(0.0, r[:-1]) for r in self.rings])
        high = np.concatenate(self.rings)
        at = far[:, pivot]
        return pivot, ring, np.maximum(np.maximum(low[None, :] - at, at - high[None, :]), 0)


def partitions(corpus: DataFrame, dim: int, n: int, per_block: int, most: int = 256) -> Partitions:
    """Pivots are a sample of the corpus in hash order; rings hold about ``per_block`` vectors by approximate quantiles.

    The driver holds ``most`` pivots at most and one number for each block.  A
    corpus of one block has one ring without an end.
    """
    if n <= per_block:
        return Partitions(np.zeros((1, dim)), [np.array([np.inf])])
    count = min(most, -(-n // per_block))
    sample = corpus.where(F.col("c_values").isNotNull()).orderBy(F.xxhash64("cid", F.lit("pivot")), "cid").limit(count).collect()
    pivots = _as_matrix(pa.array([r["c_at"] for r in sample], pa.list_(pa.int32())), pa.array([r["c_values"] for r in sample], pa.list_(pa.float64())), dim)
    pivots = np.nan_to_num(pivots) if len(pivots) else np.zeros((1, dim))

    def measure(batches):
        for batch in batches:
            far = _to_pivots(_matrix_of(batch, "c", dim), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(far.argmin(1), pa.int32()), pa.array(far.min(1), pa.float64())], ["pivot", "far"])

    far = corpus.select("c_at", "c_values").mapInArrow(measure, "pivot int, far double")
    share = per_block / max(n, 1)
    cuts = [min(1.0, share * i) for i in range(1, -(-n // per_block) + 1)]
    found = far.groupBy("pivot").agg(F.percentile_approx("far", [*cuts[:-1], 1.0], 1000).alias("q"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    rings = [np.zeros(1) for _ in range(len(pivots))]
    for r in found:
        step = max(1, len(r["q"]) * per_block // r["n"]) if r["n"] else 1
        inner = sorted({q for q in r["q"][step - 1:-1:step] if q < r["high"]})
        rings[r["pivot"]] = np.array([*inner, r["high"]])
    return Partitions(pivots, rings)


def knn_l2(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id",
           query_vec: str = "embedding", corpus_id: str = "id", corpus_vec: str = "embedding",
           block_bytes: int = DEFAULT_BLOCK_BYTES, dim: int | None = None) -> DataFrame:
    """Exact k nearest corpus vectors per query by squared L2 distance.

    Vectors are dense arrays, or sparse structs (indices, values) of
    dimension ``dim``, densified inside the tasks.  Ids are whole numbers or
    text; ties at the rounded distance go by the neighbour's id; rows without
    an id are left out, and so are vectors that are null or hold null or
    non-finite values.  ``block_bytes`` bounds a block of either side; the
    sides are counted before, to know the number of blocks, and the queries have
    at least as many as there are cores.
    Output (query_id, neighbour_id, rank, distance); ``rank`` starts at 1.
    An empty corpus gives no rows; a corpus smaller than k gives what exists.
    """
    found = _near_rows(queries, corpus, k, query_id, query_vec, corpus_id, corpus_vec, block_bytes, dim)[0]
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "neighbour_id", "rank", "distance"))


def _near_rows(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, query_vec: str, corpus_id: str, corpus_vec: str,
               block_bytes: int, dim: int | None) -> tuple[DataFrame, DataFrame, Partitions]:
    """Each read block's k nearest per query; the (query, block) pairs of the second pass; the corpus' partitions."""
    spark = queries.sparkSession
    q_type, c_type = _id_type(queries, query_id), _id_type(corpus, corpus_id)
    q_kind, c_kind = _values_type(queries, query_vec), _values_type(corpus, corpus_vec)
    q, c = _vectors(queries, query_id, query_vec, "q"), _vectors(corpus, corpus_id, corpus_vec, "c")
    n_queries, widest = q.agg(F.count(F.lit(1)), F.max(F.size("q_values"))).first()
    dim = max(0, int(widest or 0)) if dim is None else dim
    per_block = max(1, block_bytes // max(1, dim * 8))
    n_corpus, cores = c.count(), spark.sparkContext.defaultParallelism
    # a query is sent to each block that it reads, so it is the queries that are parted for the cores
    q_blocks = max(1, -(-n_queries // per_block), min(cores, n_queries))
    parts = partitions(c, dim, n_corpus, per_block)
    q = q.withColumn("q_block", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int"))

    def placed(df, kind, out):
        if parts.single:
            return df.withColumns({"pivot": F.lit(0), "ring": F.lit(0)})

        def home(batches):
            for batch in batches:
                pivot, ring, _ = parts.place(_matrix_of(batch, out, dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(ring, pa.int32())], [*batch.schema.names, "pivot", "ring"])

        return df.mapInArrow(home, f"{kind}, pivot int, ring int")

    def others(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                own_pivot, own_ring, far = parts.place(_matrix_of(some, "q", dim))
                pivot, ring, bound = parts.bounds(far)
                reach = some.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.sqrt(np.where(np.isnan(reach), np.inf, reach) + 10.0 ** -DISTANCE_DECIMALS) + 1e-6
                row, at = np.nonzero((bound <= reach[:, None]) & ((pivot[None, :] != own_pivot[:, None]) | (ring[None, :] != own_ring[:, None])))
                for first in range(0, len(row), 8192):
                    r, a = row[first:first + 8192], at[first:first + 8192]
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(r)).columns, pa.array(pivot[a], pa.int32()), pa.array(ring[a], pa.int32())],
                                                     [*some.schema.names, "pivot", "ring"])

    id_types = [pa.string() if x == "string" else pa.int64() for x in (q_type, c_type)]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        row, col, d = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        if left.num_rows and right.num_rows:
            reach = left.column("reach").to_numpy().astype(np.float64)
            row, col, d = _nearest(_matrix_of(left, "q", dim), _id_array(right.column("cid")), _matrix_of(right, "c", dim), k,
                                   np.where(np.isnan(reach), np.inf, reach))
        return pa.table([left.column("qid").combine_chunks().take(pa.array(row)).cast(id_types[0]),
                         right.column("cid").combine_chunks().take(pa.array(col)).cast(id_types[1]), pa.array(d, pa.float64())],
                        names=["query_id", "neighbour_id", "distance"])

    # rings are cut by approximate quantiles, so a ring of equal distances may be larger: a hash parts it
    if parts.single:
        stored, sizes = placed(c, "", "c"), None
    else:
        stored = cut_lineage(placed(c, f"cid {c_type}, c_at array<int>, c_values {c_kind}", "c"))
        counted = stored.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("n_parts"))
        sizes = spark.createDataFrame(counted.collect(), counted.schema)  # one row a block

    def parted(df, number):
        """Rows with their block's parts, as ``number`` makes them of ``n_parts``."""
        if sizes is None:
            return df.withColumn("c_part", F.lit(0))
        return df.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("c_part", number).drop("n_parts")

    dealt = parted(stored, F.pmod(F.xxhash64("cid"), "n_parts").cast("int"))
    keys = ["pivot", "ring", "c_part", "q_block"]

    def read(pairs):
        left = parted(pairs, F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        right = dealt.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, f"query_id {q_type}, neighbour_id {c_type}, distance double")

    q_columns = f"qid {q_type}, q_at array<int>, q_values {q_kind}, q_block int, reach double"
    first = read(placed(q.withColumn("reach", F.lit(None).cast("double")), q_columns, "q"))
    if parts.single:
        return first, placed(q, "", "q").where("false"), parts
    first = cut_lineage(first)
    kth = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    reach = (first.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k)
             .select(F.col("query_id").alias("qid"), F.col("distance").alias("reach")))
    pairs = q.join(reach, "qid", "left").select("qid", "q_at", "q_values", "q_block", "reach").mapInArrow(others, f"{q_columns}, pivot int, ring int")
    return first.unionByName(read(pairs)), pairs, parts


# --------------------------------------------------------------------------- V2, inverted lists
BLOCK_DOCS = 64  # corpus vectors of a block that a query reads or skips as a whole
COMMON = "common"  # the block of the vectors that are nearest to queries they share no term with


def _dot(values: Column, at: Column, weights: Column) -> Column:
    """Sum of the products of a sparse vector with a map of weights."""
    return F.aggregate(F.zip_with(at, values, lambda i, v: v * F.coalesce(F.try_element_at(weights, i), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)


def _square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, v: x + v * v)


def sparse_blocks(corpus: DataFrame, corpus_id: str, vec: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(cid, at, values, square, block): vectors beside those with the same two heaviest terms, a hash parts large blocks."""
    heaviest = F.slice(F.sort_array(F.arrays_zip(F.transform(f"{vec}.values", lambda v: -v).alias("w"), F.col(f"{vec}.indices").alias("i"))), 1, 2)
    docs = corpus.where(F.col(corpus_id).isNotNull()).select(
        F.col(corpus_id).alias("cid"), F.col(f"{vec}.indices").alias("at"), F.col(f"{vec}.values").alias("values"), _square(F.col(f"{vec}.values")).alias("square"),
        F.concat_ws(",", F.transform(heaviest, lambda x: x["i"].cast("string"))).alias("pair"))
    sizes = docs.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / block_docs).alias("parts"))
    return docs.join(sizes, "pair").select("cid", "at", "values", "square", F.concat_ws(":", "pair", F.pmod(F.xxhash64("cid"), "parts").cast("string")).alias("block"))


def _block_bounds(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, block, n, bound) of the blocks that share a term with the query: no vector of the block is nearer than ``bound``."""
    postings = (blocks.select("block", F.explode(F.arrays_zip("at", "values")).alias("e")).groupBy("block", F.col("e.at").alias("term"))
                .agg(F.max("e.values").alias("most")))
    whole = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("square").alias("least_square"))
    asked = queries.select("qid", F.explode("weights").alias("term", "weight"))
    sums = asked.join(postings, "term").groupBy("qid", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("dot"))
    return sums.join(whole, "block").join(queries.select("qid", "q_square"), "qid").select(
        "qid", "block", "n", (F.col("q_square") + F.col("least_square") - 2 * F.col("dot")).alias("bound"))


def _read_blocks(pairs: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, cid, distance) of all vectors of these (qid, block) pairs."""
    d = F.col("q_square") + F.col("square") - 2 * _dot(F.col("values"), F.col("at"), F.col("weights"))
    return pairs.select("qid", "block").join(queries, "qid").join(blocks, "block").select(
        "qid", "cid", F.round(F.greatest(d, F.lit(0.0)), DISTANCE_DECIMALS).alias("distance"))


def knn_sparse(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "embedding",
               corpus_id: str = "id", corpus_vec: str = "embedding", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Exact k nearest corpus vectors per query by squared L2 distance, for sparse vectors (indices, values) without negative values.

    Output as of ``knn_l2``.  Rows without an id are left out; vectors may be
    empty.  Equal query vectors are searched once.
    """
    asked = queries.where(F.col(query_id).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(f"{query_vec}.indices").alias("indices"), F.col(f"{query_vec}.values").alias("values"))
    unique = cut_lineage(asked.groupBy("indices", "values").agg(F.min("query_id").alias("qid")).select(
        "qid", "indices", "values", F.map_from_arrays("indices", "values").alias("weights"), _square(F.col("values")).alias("q_square")))
    docs = sparse_blocks(corpus, corpus_id, corpus_vec, block_docs)
    # a vector that shares no term with a query is no nearer than these k, so they stand for all such
    common = docs.orderBy(F.round("square", DISTANCE_DECIMALS), "cid").limit(k).withColumn("block", F.lit(COMMON))
    blocks = cut_lineage(docs.unionByName(common))
    q = unique.select("qid", "weights", "q_square")
    bounds = cut_lineage(_block_bounds(q, blocks.where(F.col("block") != COMMON)))
    nearest = Window.partitionBy("qid").orderBy("bound", "block")
    before = F.coalesce(F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bounds.withColumn("first", before < k)  # the nearest blocks that hold k vectors
    first = cut_lineage(_read_blocks(ranked.where("first").unionByName(q.select("qid", F.lit(COMMON).alias("block")), allowMissingColumns=True), q, blocks).distinct())
    kth = Window.partitionBy("qid").orderBy("distance", "cid")
    reach = (first.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("qid", F.col("distance").alias("reach")))
    margin = 10.0 ** -DISTANCE_DECIMALS
    rest = ranked.where(~F.col("first")).join(reach, "qid", "left").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach") + margin))
    found = first.unionByName(_read_blocks(rest, q, blocks)).distinct()
    top = found.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
    same = asked.join(unique.select("qid", "indices", "values"), ["indices", "values"]).select("query_id", "qid")
    return same.join(top, "qid").select("query_id", F.col("cid").alias("neighbour_id"), "rank", "distance")
