import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents with edge rows and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    edge = [(90001, None, None, None, 0), (90002, "", "en", "x", 0), (90003, "!!! ??? 12", "en", "x", 10), (90004, "word", None, "x", 4),
            (90005, "the same words again and again in this short text " * 3000, "en", "x", 1), (90006, "a\tb\r\nc  d \x0b e", "fr", None, 1),
            (90007, "twice " * 30, "en", "x", 1), (90007, "twice " * 30, "en", "x", 1), (None, "no id but words enough to be a document of its own here", "en", "x", 1)]
    more = spark.createDataFrame(edge, "doc_id long, text string, lang string, source string, n_chars long")
    both = base.withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(more)
    return both.withColumns({"start": F.lit(1), "spans": F.lit("x"), "component": F.lit(2), "id": F.lit(3), "node": F.lit(4)}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
