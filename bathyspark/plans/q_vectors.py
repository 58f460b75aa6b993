"""Registered queries: vectors, float index, neighbours, answer text."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyspark.operators import index as X
from bathyspark.operators import vectors as V
from bathyspark.operators.stats import summary_by_float
from bathyspark.plans import answer
from bathyspark.functions.text import FLOAT_PREFIX, NEIGHBOURS_HEADER, SUMMARY_SEPARATOR
from bathyspark.plans.oracle import fixed, sql
from bathyspark.plans.q_questions import BOUNDS_CTE, CURRENT_YEAR, EXACT_CTE, MATCH_COND, PARSED_CTE, exact_mean_sql
from bathyspark.plans.q_stats import SUMMARY_SQL
from bathyspark.schemas import CONTEXT_NEIGHBOURS, DEFAULT_K, QUESTION_PARAMETERS, STOP_WORDS
from bathyspark.session import cut_lineage
from bathyspark.sources import bindings as B
from bathyspark.sources.io import scratch_dir


def _emb(s, d):
    return B.table(s, d, "embeddings")


def knn_graph(s, d, k=5):
    """V2/V3: the k nearest vectors of every vector of the table (itself included)."""
    e = _emb(s, d)
    return V.knn_l2(e, e, k, query_id="vec_id", corpus_id="vec_id")


def knn_with_metadata(s, d):
    """V4: neighbours with the neighbour's stored metadata (its label)."""
    e = _emb(s, d)
    hits = knn_graph(s, d)
    return hits.join(e.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("neighbour_label")),
                     "neighbour_id")


def _index(s, d):
    return X.build_index(B.floats(s, d), B.profiles(s, d))


def index_floats(s, d):
    idx, _ = _index(s, d)
    return idx.select("float_id", "text_summary",
                      F.size("embedding.indices").alias("n_terms"),
                      "metadata.*")


def floats_near_text(s, d):
    """G1 + G3 over the float index: id, distance, summary text, metadata."""
    from bathyspark.operators.geo import floats_near
    docs = X.index_documents(B.floats(s, d), B.profiles(s, d))
    return floats_near(docs.select("float_id", "text_summary", "metadata.*"), 10.5, 70.25, 2.0)


def float_text(s, d):
    return X.float_summaries(B.floats(s, d), B.profiles(s, d)).select(
        "float_id", X.float_text().alias("text_summary"))


def tfidf_vectors(s, d):
    """V1 over the document corpus: per document, vocabulary terms and norm."""
    docs = B.table(s, d, "documents").select("doc_id", "text")
    _, sp = V.tfidf_fit_transform(docs, "doc_id", "text", 1000)
    return sp.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"),
        F.round(F.sum("weight"), 6).alias("weight_sum"))


def embedding_store(s, d):
    """Write the float index as Parquet and read it back."""
    idx, model = _index(s, d)
    path = scratch_dir(s, "float-index")
    X.save_index(idx, path, model)
    return _written_vectors(X.load_index(s, path))


def _written_vectors(index):
    texts = F.transform("embedding.values", lambda v: v.cast("decimal(10,6)").cast("string"))
    return index.select("float_id", "text_summary", "metadata.*", F.array_join("embedding.indices", ",").alias("vector_terms"),
                        F.array_join(texts, ",").alias("vector_values"))


def index_added(s, d):
    """An index of the floats deployed before 1996, to which the others are added, and some of the first once more."""
    floats, levels = B.floats(s, d), B.profiles(s, d)
    early = F.col("deployment_date") < F.lit("1996-01-01").cast("timestamp_ntz")
    path = scratch_dir(s, "float-index")
    summaries = cut_lineage(summary_by_float(levels))  # of one set of levels, for the build and both additions
    # the first build knows the inactive floats as active
    idx, model = X.build_index(floats.where(early).withColumn("status", F.when(F.col("status") == "inactive", "active").otherwise(F.col("status"))), levels, summaries=summaries)
    X.save_index(idx, path, model)
    X.add_to_index(s, path, floats.where(~early), levels, 1, summaries)
    X.add_to_index(s, path, floats.where(early & (F.col("status") == "inactive")), levels, 2, summaries)
    return _written_vectors(X.load_index(s, path))


def knn_small(s, d):
    """V6: fewer corpus vectors than k; every vector against the mean vectors of the labels, all of them ranked."""
    e = _emb(s, d)
    means = (e.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("at", "value"))
             .groupBy("label", "at").agg(F.avg(F.col("value").cast("double")).alias("value")))
    corpus = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select(
        F.col("label").cast("string").alias("label"), F.col("v.value").alias("embedding"))  # one entry per dimension
    n_labels_and_more = 1000
    return V.knn_l2(e, corpus, n_labels_and_more, query_id="vec_id", corpus_id="label")


def knn_empty(s, d):
    """V5: every vector against a corpus without a row (no label is negative) has no neighbour."""
    e = _emb(s, d)
    return V.knn_l2(e, e.where("label < 0"), 5, query_id="vec_id", corpus_id="vec_id")


def _neighbours(s, d, parsed=None):
    idx, model = _index(s, d)
    parsed = answer.parse_once(B.questions(s, d), CURRENT_YEAR) if parsed is None else parsed
    return answer.question_neighbours(idx, model, parsed, 5)


def question_neighbours(s, d):
    return _neighbours(s, d).select("question_id", "rank", "float_id", "distance")


def context_neighbours(s, d):
    return _neighbours(s, d).where(F.col("rank") <= 3).select("question_id", "rank", "float_id", "text_summary")


def _batch_and_neighbours(s, d):
    """Both parts of the answers, of questions that are parsed once."""
    questions = B.questions(s, d)
    parsed = answer.parse_once(questions, CURRENT_YEAR)
    return answer.question_batch(B.profile_levels(s, d), questions, CURRENT_YEAR, parsed=parsed), _neighbours(s, d, parsed)


def answer_context(s, d):
    return answer.answer_context(*_batch_and_neighbours(s, d))


def answer_records(s, d):
    rec = answer.answer_records(*_batch_and_neighbours(s, d))
    return rec.select("question_id", "query", "response", "data_summary.total_records",
                      F.array_join("data_summary.parameters_found", ",").alias("parameters_found"),
                      F.size("vector_results").alias("n_neighbours"))


QUERIES = {
    "knn_l2": knn_graph,
    "knn_with_metadata": knn_with_metadata,
    "knn_small": knn_small,
    "knn_empty": knn_empty,
    "index_floats": index_floats,
    "float_text": float_text,
    "floats_near_text": floats_near_text,
    "tfidf_vectors": tfidf_vectors,
    "embedding_store": embedding_store,
    "index_added": index_added,
    "question_neighbours": question_neighbours,
    "context_neighbours": context_neighbours,
    "answer_context": answer_context,
    "answer_records": answer_records,
}

_KNN_SQL = (
    ", d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_sum(list_transform("
    "list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))), 6) "
    "AS distance FROM embeddings a, embeddings b), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rk FROM d) "
)

# ------------------------------------------------------------------ DuckDB SQL of texts and their vectors
def _when_measured(text: str) -> str:
    return f"CASE WHEN total_measurements > 0 THEN {text} END"


_TEXT_SQL = f"concat_ws('{SUMMARY_SEPARATOR}', " + ", ".join([
    f"'{FLOAT_PREFIX}' || f.float_id", "'Platform: ' || platform_type", "'Status: ' || status",
    f"'Location: ' || {fixed('latitude', 2)} || '°N, ' || {fixed('longitude', 2)} || '°E'",
    "'Deployed: ' || strftime(deployment_date, '%Y-%m-%d')", "'Institution: ' || institution",
    _when_measured("'Total profiles: ' || cast(total_profiles AS varchar)"),
    _when_measured(f"'Depth range: ' || {fixed('depth_min', 0)} || '-' || {fixed('depth_max', 0)} || 'm'"),
    _when_measured(f"'Temperature range: ' || {fixed('temperature_min', 1)} || '-' || {fixed('temperature_max', 1)} || '°C'"),
    _when_measured(f"'Salinity range: ' || {fixed('salinity_min', 1)} || '-' || {fixed('salinity_max', 1)} || ' PSU'")]) + ")"
_SUMMARIES_CTE = (f", measured AS (SELECT float_id, {SUMMARY_SQL} FROM profiles GROUP BY float_id), "
                  f"summaries AS (SELECT f.*, {_TEXT_SQL} AS text_summary FROM floats f LEFT JOIN measured m ON f.float_id = m.float_id) ")
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def _terms_cte(name: str, docs: str) -> str:
    """(doc, term, tf) of the kept tokens of ``docs`` (doc, text)."""
    return (f", {name} AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(regexp_extract_all(lower(text), "
            rf"'[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]{{2,}}')) AS term FROM {docs}) WHERE term NOT IN ({_STOP_SQL}) GROUP BY doc, term) ")


def _vocab_cte(terms: str, docs: str, size: int = 1000) -> str:
    return (f", vocab AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS term_index, "
            f"ln((1 + (SELECT count(*) FROM {docs})) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total "
            f"FROM {terms} GROUP BY term ORDER BY total DESC, term LIMIT {size})) ")


def _weights_cte(name: str, terms: str) -> str:
    return (f", {name} AS (SELECT doc, term_index, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)) AS weight "
            f"FROM {terms} JOIN vocab ON vocab.term = {terms}.term) ")


def _corpus_cte(docs: str, size: int = 1000) -> str:
    """Terms, vocabulary and weights of a corpus."""
    return _terms_cte("terms", docs) + _vocab_cte("terms", docs, size) + _weights_cte("weights", "terms")


_INDEX_CTE = _SUMMARIES_CTE + ", docs AS (SELECT float_id AS doc, text_summary AS text FROM summaries) " + _corpus_cte("docs")
_META = "s.latitude, s.longitude, s.status, s.platform_type, s.institution"
_NEAR_CTE = (
    ", asked AS (SELECT question_id AS doc, question AS text FROM parsed2 WHERE intent IN ('general_query', 'location_query')) "
    + _terms_cte("q_terms", "asked") + _weights_cte("q_weights", "q_terms")
    + ", dots AS (SELECT q.doc AS q, c.doc AS c, sum(q.weight * c.weight) AS dot FROM q_weights q JOIN weights c "
      "ON q.term_index = c.term_index GROUP BY q.doc, c.doc), "
      "dist AS (SELECT a.doc AS question_id, d.doc AS float_id, round(abs("
      "(CASE WHEN a.doc IN (SELECT doc FROM q_weights) THEN 1 ELSE 0 END) + (CASE WHEN d.doc IN (SELECT doc FROM weights) THEN 1 ELSE 0 END) "
      "- 2 * coalesce(dot, 0.0)), 6) AS distance FROM asked a CROSS JOIN docs d LEFT JOIN dots ON dots.q = a.doc AND dots.c = d.doc), "
      "hits AS (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY distance, float_id) AS integer) AS rank FROM dist), "
      f"near AS (SELECT h.*, s.text_summary FROM hits h JOIN summaries s ON s.float_id = h.float_id WHERE rank <= {DEFAULT_K}) ")

_ANSWER_CTE = (
    ", agg AS (SELECT q.question_id, any_value(q.question) AS question, any_value(q.parameters) AS parameters, "
    "count(r.profile_id) AS total_records, min(r.latitude) AS min_lat, max(r.latitude) AS max_lat, min(r.longitude) AS min_lon, "
    "max(r.longitude) AS max_lon, min(r.timestamp) AS time_min, max(r.timestamp) AS time_max, "
    + ", ".join(f"count(r.{p}) AS {p}_n, min(r.{p}) AS {p}_min, max(r.{p}) AS {p}_max, {exact_mean_sql(p)} AS {p}_mean"
                for p in QUESTION_PARAMETERS)
    + f" FROM bounds q LEFT JOIN exact_levels r ON {MATCH_COND} GROUP BY q.question_id), "
      f"quoted AS (SELECT question_id, string_agg('- ' || float_id || ': ' || text_summary, chr(10) ORDER BY rank) AS lines "
      f"FROM near WHERE rank <= {CONTEXT_NEIGHBOURS} GROUP BY question_id), "
      "contexts AS (SELECT a.*, concat_ws(chr(10), "
      "CASE WHEN total_records > 0 THEN 'Found ' || cast(total_records AS varchar) || ' data points:' END, "
    + ", ".join(f"CASE WHEN {p}_n > 0 AND contains(',' || parameters || ',', ',{p},') THEN '- {p}: ' || {fixed(p + '_min', 2)} || ' to ' || "
                f"{fixed(p + '_max', 2)} || ' (mean: ' || {fixed(p + '_mean', 2)} || ')' END" for p in QUESTION_PARAMETERS)
    + f", '- Geographic range: ' || {fixed('min_lat', 2)} || '°N to ' || {fixed('max_lat', 2)} || '°N, ' || {fixed('min_lon', 2)} "
      f"|| '°E to ' || {fixed('max_lon', 2)} || '°E', "
      "'- Time range: ' || strftime(time_min, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(time_max, '%Y-%m-%d %H:%M:%S'), "
      f"CASE WHEN lines IS NOT NULL THEN '{NEIGHBOURS_HEADER}' END, lines) AS context "
      "FROM agg a LEFT JOIN quoted n ON n.question_id = a.question_id) ")

_LABEL_MEANS = (
    ", parts AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS value FROM embeddings WHERE label IS NOT NULL), "
    "means AS (SELECT label, list(value ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(cast(value AS double)) AS value "
    "FROM parts GROUP BY label, pos) GROUP BY label), "
    "d AS (SELECT a.vec_id AS query_id, cast(b.label AS varchar) AS neighbour_id, round(list_sum(list_transform("
    "list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]) * (x[1]::double - x[2]))), 6) AS distance "
    "FROM embeddings a, means b) ")

_VECTORS_SQL = (
    f"SELECT s.float_id, s.text_summary, {_META}, coalesce(w.terms, '') AS vector_terms, coalesce(w.vals, '') AS vector_values "
    "FROM summaries s LEFT JOIN (SELECT doc, string_agg(cast(term_index AS varchar), ',' ORDER BY term_index) AS terms, "
    "string_agg(cast(cast(weight AS decimal(10,6)) AS varchar), ',' ORDER BY term_index) AS vals FROM weights GROUP BY doc) w "
    "ON w.doc = s.float_id")

ORACLE = {
    "knn_l2": sql(_KNN_SQL + "SELECT query_id, neighbour_id, cast(rk AS integer) AS rank, distance FROM r WHERE rk <= 5"),
    "knn_with_metadata": sql(
        _KNN_SQL + "SELECT r.query_id, r.neighbour_id, cast(r.rk AS integer) AS rank, r.distance, "
        "e.label AS neighbour_label FROM r JOIN embeddings e ON e.vec_id = r.neighbour_id WHERE r.rk <= 5"),
    "knn_small": sql(_LABEL_MEANS + "SELECT query_id, neighbour_id, distance, cast(row_number() OVER "
                     "(PARTITION BY query_id ORDER BY distance, neighbour_id) AS integer) AS rank FROM d"),
    "knn_empty": sql("SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, cast(0 AS double) AS distance, cast(1 AS integer) AS rank "
                     "FROM embeddings q JOIN embeddings c ON c.label < 0"),
    "float_text": sql(_SUMMARIES_CTE + "SELECT float_id, text_summary FROM summaries"),
    "floats_near_text": sql(
        _SUMMARIES_CTE + ", near AS (SELECT *, sqrt((10.5 - latitude) * (10.5 - latitude) + (70.25 - longitude) * (70.25 - longitude)) "
        "AS distance FROM summaries) SELECT float_id, distance, latitude, longitude, status, platform_type, institution, text_summary "
        "FROM near WHERE distance <= 2.0"),
    "index_floats": sql(
        _INDEX_CTE + f"SELECT s.float_id, s.text_summary, cast(coalesce(w.n, 0) AS integer) AS n_terms, {_META} FROM summaries s "
        "LEFT JOIN (SELECT doc, count(*) AS n FROM weights GROUP BY doc) w ON w.doc = s.float_id"),
    "embedding_store": sql(_INDEX_CTE + _VECTORS_SQL),
    "index_added": sql(
        _SUMMARIES_CTE + ", docs AS (SELECT float_id AS doc, text_summary AS text FROM summaries), first_docs AS (SELECT float_id AS doc, "
        "CASE status WHEN 'inactive' THEN replace(text_summary, 'Status: inactive', 'Status: active') ELSE text_summary END AS text "
        "FROM summaries WHERE deployment_date < TIMESTAMP '1996-01-01') "
        + _terms_cte("first_terms", "first_docs") + _vocab_cte("first_terms", "first_docs") + _terms_cte("terms", "docs") + _weights_cte("weights", "terms")
        + _VECTORS_SQL),
    "tfidf_vectors": sql(
        ", docs AS (SELECT doc_id AS doc, text FROM documents) " + _corpus_cte("docs")
        + "SELECT doc AS doc_id, count(*) AS n_terms, round(sqrt(sum(weight * weight)), 6) AS norm, round(sum(weight), 6) AS weight_sum "
          "FROM weights GROUP BY doc"),
    "question_neighbours": sql(
        _INDEX_CTE + PARSED_CTE + _NEAR_CTE + "SELECT question_id, rank, float_id, distance FROM near"),
    "context_neighbours": sql(
        _INDEX_CTE + PARSED_CTE + _NEAR_CTE + f"SELECT question_id, rank, float_id, text_summary FROM near WHERE rank <= {CONTEXT_NEIGHBOURS}"),
    "answer_context": sql(
        _INDEX_CTE + EXACT_CTE + PARSED_CTE + BOUNDS_CTE + _NEAR_CTE + _ANSWER_CTE + "SELECT question_id, question, total_records, context FROM contexts"),
    "answer_records": sql(
        _INDEX_CTE + EXACT_CTE + PARSED_CTE + BOUNDS_CTE + _NEAR_CTE + _ANSWER_CTE
        + "SELECT c.question_id, c.question AS query, c.context AS response, c.total_records, concat_ws(',', "
        + ", ".join(f"CASE WHEN {p}_n > 0 THEN '{p}' END" for p in QUESTION_PARAMETERS)
        + ") AS parameters_found, cast(coalesce(n.n, 0) AS integer) AS n_neighbours FROM contexts c "
          "LEFT JOIN (SELECT question_id, count(*) AS n FROM near GROUP BY question_id) n ON n.question_id = c.question_id"),
}
