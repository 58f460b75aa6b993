"""The corpus pipeline: stages in order, their decisions, and its registration."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from bathyspark.llm import decontam, jaccard
from tests.llm.conftest import SF


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages_on_edge_rows(spark, docs):
    """Rejected documents, near copies and leaks go, personal data is replaced, the rest is packed."""
    held, counts = docs.select("doc_id", "text", "lang", "source", "n_chars"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = held.columns
        held = stage(spark, held, SF).cache()
        counts[name] = held.select("doc_id").distinct().count()
        if name != "packing":
            assert held.columns == before
        if name == "language_id":
            assert not {90001, 90002, 90003} & {r["doc_id"] for r in held.select("doc_id").collect()}
        if name == "near_duplicates":
            again = jaccard.near_duplicates(held)
            assert again.where("n_links > 0").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontam.find_overlaps(held, bench).count() == 0
    assert counts["packing"] == counts["personal_data"] == counts["decontamination"] > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, stage):
    assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").where("false"), SF).count() == 0
