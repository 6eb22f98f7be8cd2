import pytest


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture
def frame(spark):
    """Rows (id, text) as a table whose further columns clash with names that operators use."""

    def make(rows, partitions=3):
        schema = "doc_id long, text string"
        table = spark.createDataFrame(rows, schema).repartition(partitions)
        extra = ["score", "row", "kind", "size", "target", "node", "bucket", "count", "start", "minimiser", "component_id", "found"]
        extra += ["_text", "_found", "_id", "_key", "_found_key", "_text_key", "_source", "_copies", "_copy", "_gone", "_suspect", "_salt"]
        from pyspark.sql import functions as F

        return table.select("*", *[F.lit(-1).alias(c) for c in extra])

    return make
