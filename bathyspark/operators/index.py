"""Float index: summary text, vectors and metadata per float.

One job builds the whole index: floats left join the per-float summary (A2),
the text summary (T1), TF-IDF vectors fitted once on all summaries (V1), and
the metadata struct.  No per-float loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyspark.functions.text import float_text
from bathyspark.operators import vectors as V
from bathyspark.operators.stats import summary_by_float
from bathyspark.session import cut_lineage

MAX_FEATURES = 1000
BATCH = "batch"


def float_summaries(floats: DataFrame, profiles: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Floats with their A1 summary columns (null when a float has no levels).

    ``summaries`` is A2 of the levels, if that is there already; the levels are not read then.
    """
    return floats.join(summary_by_float(profiles) if summaries is None else summaries, "float_id", "left")


def index_documents(floats: DataFrame, profiles: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """T1 with the metadata: float_id, doc (the vector's key, the float_id), text_summary, metadata struct."""
    return float_summaries(floats, profiles, summaries).select(
        "float_id", F.col("float_id").alias("doc"), float_text().alias("text_summary"),
        F.struct("latitude", "longitude", "status", "platform_type", "institution").alias("metadata"))


def build_index(floats: DataFrame, profiles: DataFrame, max_features: int = MAX_FEATURES, summaries: DataFrame | None = None):
    """(index DataFrame, fitted TF-IDF model).

    Index columns: those of ``index_documents`` and ``embedding`` (sparse
    struct<indices, values> of dimension ``max_features``).  ``summaries`` as of ``float_summaries``.
    """
    # fitting and transforming read the summaries several times: compute
    # them once (reliable checkpoint in the shared folder)
    docs = cut_lineage(index_documents(floats, profiles, summaries))
    model, sparse = V.tfidf_fit_transform(docs, "doc", "text_summary", max_features)
    # the index is reused by every search: cut its lineage with a reliable
    # checkpoint in the shared checkpoint folder
    return cut_lineage(docs.join(V.to_sparse(sparse, docs, "doc"), "doc")), model


def embed_texts(model: V.TfidfModel, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Vectors for query texts in the index's space: (id, embedding)."""
    sparse = V.tfidf_transform(model, texts, id_col, text_col)
    return V.to_sparse(sparse, texts, id_col).withColumnRenamed("doc", id_col)


def search_index(index: DataFrame, model: V.TfidfModel, texts: DataFrame, id_col: str, text_col: str,
                 k: int = 5) -> DataFrame:
    """V2 + V4: the k floats nearest to each text, with text and metadata; an empty index gives no row."""
    qv = embed_texts(model, texts, id_col, text_col)
    hits = V.knn_sparse(qv, index, k, query_id=id_col, corpus_id="doc")
    return (hits.join(index.select("doc", "float_id", "text_summary", "metadata"),
                      hits.neighbour_id == index.doc)
            .select(F.col("query_id").alias(id_col), "rank", "float_id", "distance", "text_summary", "metadata"))


# ------------------------------------------------------------------ stored index
def save_index(index: DataFrame, path: str, model: V.TfidfModel | None = None) -> None:
    """Write the index as Parquet (a durable, shareable table), as its batch 0, with the model that its vectors are of."""
    index.withColumn(BATCH, F.lit(0)).write.mode("overwrite").partitionBy(BATCH).parquet(f"{path}/vectors")
    if model is not None:
        model.vocab.withColumn("max_features", F.lit(model.max_features)).write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_index(spark, path: str) -> DataFrame:
    """Read the index back; of several versions of a float the one of the newest batch."""
    rows = spark.read.parquet(f"{path}/vectors")
    if rows.select(F.max(BATCH)).first()[0] == 0:  # never added to: no float has two versions
        return rows.drop(BATCH)
    newest = rows.groupBy("float_id").agg(F.max(BATCH).alias(BATCH))
    return rows.join(newest, ["float_id", BATCH]).select([c for c in rows.columns if c != BATCH])


def load_model(spark, path: str) -> V.TfidfModel:
    """The vocabulary and weights that the index was built with (at most ``max_features`` rows)."""
    rows = spark.read.parquet(f"{path}/vocabulary")
    held = rows.select("term", "term_index", "idf").orderBy("term_index")
    size = rows.select("max_features").first()
    return V.TfidfModel(spark.createDataFrame(held.collect(), held.schema), size[0] if size else MAX_FEATURES)


def add_to_index(spark, path: str, floats: DataFrame, profiles: DataFrame, batch: int, summaries: DataFrame | None = None) -> None:
    """Add new or changed floats to the stored index, under its frozen vocabulary and weights.

    ``batch`` numbers the additions from 1 on; a float of a later batch takes
    the place of its earlier versions.  Only the given floats are read and
    written.  Running a batch again (after a failure, say) writes the same folder
    once more, so nothing is there twice.  ``summaries`` as of ``float_summaries``.
    """
    if batch < 1:
        raise ValueError("batches of additions are numbered from 1 on")
    model = load_model(spark, path)
    given = profiles.join(floats.select("float_id"), "float_id", "left_semi")
    docs = cut_lineage(index_documents(floats, given, summaries))
    vectors = V.to_sparse(V.tfidf_transform(model, docs, "doc", "text_summary"), docs, "doc")
    docs.join(vectors, "doc").write.mode("overwrite").parquet(f"{path}/vectors/{BATCH}={batch}")


def compact_index(spark, path: str, to: str) -> None:
    """The newest versions alone, as batch 0 of a new stored index."""
    save_index(load_index(spark, path), to, load_model(spark, path))
