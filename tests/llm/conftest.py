import pytest

EDGES = [
    (1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "g h i j k l", "en"), (2, None, None), (3, "", "en"), (4, " \t\n\x0b\x0c\r ", "en"), (None, "a b c d e f", "en"), (None, None, None),
    (5, "word " * 5000, "en"), (6, "x" * 200_000, None), (7, "A B c D e F", "en"), (8, "é ß … 漢字 🙂   z", "xx"), (9, "word " * 5000, "en"), (10, "tie tie tie " * 40, "en"), (11, " ".join(f"w{i}" for i in range(120)), "en"), (12, "start " + " ".join(f"w{i}" for i in range(120)), "en"),
]
#: Columns whose names the operators use themselves.
CLASHING = ["n_words", "key", "c", "starts", "ends", "_id", "_row", "size", "class", "ids", "kept", "score"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
