import pytest
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.operators import vector_index
from evidara.operators.vector_index import IndexBuildError, build, embed_missing, entries, missing, publish, read

SCHEMA = "id long, text string"
ROWS = [(i, f"text {i % 17}") for i in range(60)] + [(60, None), (61, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted((r["id"], r["text_hash"], tuple(round(x, 9) for x in r["vector"])) for r in df.collect())


def counting(spark, bad=None):
    """Vectors of texts, and how many were asked for; texts that hold bad have none."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(text):
        asked.add(1)
        return None if bad is not None and bad in text else [float(len(text) + 1), float(sum(map(ord, text)) + 1), 0.5]

    return asked, vector.asNondeterministic()


def test_each_text_is_embedded_once(spark, docs, tmp_path):
    asked, embed = counting(spark)
    manifest = build(docs, str(tmp_path), embed, "m", "1")
    assert (asked.value, manifest["embedded"], manifest["records"], manifest["texts"], manifest["dimension"]) == (18, 18, 62, 18, 3)
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in read(spark, str(tmp_path)).collect())
    more = docs.union(spark.createDataFrame([(100, "new"), (101, "text 3")], SCHEMA))
    again = build(more, str(tmp_path), embed, "m", "1")
    assert (asked.value, again["embedded"], again["records"]) == (19, 1, 64)
    assert build(more, str(tmp_path), embed, "m", "2")["embedded"] == 19


def test_a_build_that_failed_is_taken_up(spark, docs, tmp_path):
    _, failing = counting(spark, bad="text 11")
    with pytest.raises(IndexBuildError, match="bad vectors"):
        embed_missing(docs, str(tmp_path), failing, "m", "1", portions=9)
    kept = entries(spark, str(tmp_path), "m", "1").count()
    left = missing(docs, str(tmp_path), "m", "1").count()
    assert 0 < kept < 18 and kept + left == 18
    with pytest.raises(IndexBuildError, match="without a vector"):
        publish(docs, str(tmp_path), "m", "1")
    # A folder that a killed build left is not read.
    spark.createDataFrame([("x", [1.0], "m", "1")], vector_index.ENTRY).write.parquet(str(tmp_path / "entries" / "pending-0"))
    asked, embed = counting(spark)
    assert build(docs, str(tmp_path), embed, "m", "1")["embedded"] == asked.value == left
    whole = build(docs, str(tmp_path / "other"), counting(spark)[1], "m", "1")
    assert rows(read(spark, str(tmp_path))) == rows(read(spark, str(tmp_path / "other")))
    assert whole["content_hash"] == vector_index.json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])["content_hash"]


@pytest.mark.parametrize("vector", ["array(0D, 0D)", "array(1D, double('NaN'))", "array(double('Infinity'))", "cast(array() AS array<double>)", "cast(NULL AS array<double>)"])
def test_vectors_that_cannot_be(spark, docs, tmp_path, vector):
    with pytest.raises(IndexBuildError):
        embed_missing(docs, str(tmp_path), lambda text: F.expr(vector), "m", "1")
    assert entries(spark, str(tmp_path), "m", "1").count() == 0


def test_one_dimension_for_all(spark, docs, tmp_path):
    build(docs.where("id < 9"), str(tmp_path), lambda t: X.stable_vector(t, 4), "m", "1")
    with pytest.raises(IndexBuildError, match="dimension"):
        build(docs, str(tmp_path), lambda t: X.stable_vector(t, 5), "m", "1")
    assert read(spark, str(tmp_path)).count() == 9


def test_ids_and_manifests(spark, docs, tmp_path):
    embed = X.stable_vector
    build(docs, str(tmp_path), embed, "m", "1")
    for wrong in (docs.union(docs.limit(1)), docs.union(spark.createDataFrame([(None, "text 1")], SCHEMA)), docs.where("false")):
        with pytest.raises(IndexBuildError):
            build(wrong, str(tmp_path), embed, "m", "1")
    assert read(spark, str(tmp_path)).count() == 62
    at = vector_index.json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])["snapshot"]
    spark.createDataFrame([(1, "x", [1.0])], "id long, text_hash string, vector array<double>").write.mode("append").parquet(at)
    with pytest.raises(IndexBuildError, match="not what the manifest says"):
        read(spark, str(tmp_path))
