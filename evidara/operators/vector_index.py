"""A vector index that is built in portions and can be taken up again: what was embedded once is not embedded anew.

Entries are kept by (hash of the text, model, revision) in committed folders; a portion is written to a pending folder,
checked there, and renamed. A build embeds what an anti join finds missing, each text once however many documents have it,
and then binds documents to vectors in a snapshot with a manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..plans.settled import settle, shared_dir
from ..sources.tables import table

ENTRY = "text_hash string, vector array<double>, model string, revision string"


class IndexBuildError(ValueError):
    """What the model returned, or what the documents are, cannot be an index."""


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Folders of committed portions; what a killed build left pending is not among them."""
    at, files = _folder(spark, f"{path}/entries")
    return sorted(x.getPath().toString() for x in (files.listStatus(at) if files.exists(at) else []) if x.getPath().getName().startswith("commit-"))


def entries(spark: SparkSession, path: str, model: str, revision: str) -> DataFrame:
    """text_hash and vector of what is there for a model's revision."""
    found = _commits(spark, path)
    every = spark.read.schema(ENTRY).parquet(*found) if found else spark.createDataFrame([], ENTRY)
    return every.where((F.col("model") == model) & (F.col("revision") == revision)).select("text_hash", "vector").dropDuplicates(["text_hash"])


def _bad(vector: Column) -> Column:
    value = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNull() | (F.size(vector) == 0) | F.exists(vector, value) | ~F.exists(vector, lambda x: x != 0)


def missing(docs: DataFrame, path: str, model: str, revision: str) -> DataFrame:
    """text_hash and text of every distinct text that has no entry. docs: id, text; null texts are empty ones."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    # Hashes are compared before texts travel; one row of each text is kept, combined before the shuffle.
    lacking = texts.join(entries(docs.sparkSession, path, model, revision).select("text_hash"), "text_hash", "left_anti")
    return lacking.groupBy("text_hash").agg(F.first("text").alias("text"))


def embed_missing(docs: DataFrame, path: str, embed: Callable[[Column], Column], model: str, revision: str, portions: int = 8) -> int:
    """Embed in portions by hash what is missing, and return how many texts were. embed: a column of vectors of a column.

    A portion counts once it is written whole and checked: every vector there, finite, not zero, of the one dimension that
    all entries have. A portion that fails is dropped and the build ends with an error; portions before it stay.
    """
    spark = docs.sparkSession
    need = settle(missing(docs, path, model, revision).withColumn("portion", F.pmod(F.xxhash64("text_hash"), F.lit(portions))), "missing")
    size = entries(spark, path, model, revision).select(F.size("vector").alias("n")).limit(1).collect()
    size = size[0]["n"] if size else None
    done = 0
    for portion in sorted(r["portion"] for r in need.select("portion").distinct().collect()):
        name = uuid.uuid4().hex
        pending, commit = f"{path}/entries/pending-{name}", f"{path}/entries/commit-{name}"
        part = need.where(F.col("portion") == portion)
        part.select("text_hash", embed(F.col("text")).cast("array<double>").alias("vector"), F.lit(model).alias("model"), F.lit(revision).alias("revision")).write.parquet(pending)
        seen = spark.read.schema(ENTRY).parquet(pending).agg(F.count("*").alias("n"), F.sum(_bad(F.col("vector")).cast("int")).alias("bad"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        at, files = _folder(spark, pending)
        if seen["bad"] or seen["low"] != seen["high"] or size not in (None, seen["low"]):
            files.delete(at, True)
            raise IndexBuildError(f"{seen['bad']} bad vectors" if seen["bad"] else "vectors of more than one dimension")
        size = seen["low"]
        files.rename(at, _folder(spark, commit)[0])
        done += seen["n"]
    return done


def publish(docs: DataFrame, path: str, model: str, revision: str) -> dict:
    """Write the snapshot (id, text_hash, vector of norm 1) and its manifest, which names it and is written last.

    Documents with a repeated or null id, documents without an entry, and no documents are errors; the manifest of before
    stays then. The content hash does not depend on order.
    """
    spark = docs.sparkSession
    rows = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    norm = F.sqrt(X.dot(F.col("vector"), F.col("vector")))
    bound = rows.join(entries(spark, path, model, revision), "text_hash", "left").select("id", "text_hash", F.transform("vector", lambda x: x / norm).alias("vector"))
    at = f"{path}/snapshots/{uuid.uuid4().hex}"
    bound.write.parquet(at)
    written = spark.read.parquet(at)
    seen = written.agg(F.count("*").alias("records"), F.count(F.when(F.col("vector").isNull(), 1)).alias("without"), F.countDistinct("text_hash").alias("texts"), F.max(F.size("vector")).alias("dimension"), F.hex(F.bit_xor(F.xxhash64("id", "text_hash", "vector"))).alias("content_hash"), F.hex(F.bit_xor(F.xxhash64("id", "text_hash"))).alias("input_hash")).first().asDict()
    repeated = written.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").take(1)
    lacks = "there are no documents" if not seen["records"] else "ids are null or repeated" if repeated else f"{seen['without']} documents without a vector" if seen["without"] else ""
    if lacks:
        folder, files = _folder(spark, at)
        files.delete(folder, True)
        raise IndexBuildError(lacks)
    del seen["without"]
    manifest = seen | {"model": model, "revision": revision, "snapshot": at}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def build(docs: DataFrame, path: str, embed: Callable[[Column], Column], model: str, revision: str, portions: int = 8) -> dict:
    """Embed what is missing and publish; a build that was ended anywhere is taken up by calling this again."""
    embedded = embed_missing(docs, path, embed, model, revision, portions)
    return publish(docs, path, model, revision) | {"embedded": embedded}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that the manifest names, if it holds what the manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = spark.read.parquet(manifest["snapshot"])
    if rows.agg(F.hex(F.bit_xor(F.xxhash64("id", "text_hash", "vector")))).first()[0] != manifest["content_hash"]:
        raise IndexBuildError("the snapshot is not what the manifest says")
    return rows


_STABLE = "round_even(('0x' || substring(sha256(text || '‖' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1, 6)"


@query(f"""WITH v AS (SELECT doc_id, i, sha256(text) AS text_hash, {_STABLE} AS x FROM documents, (SELECT unnest(range(8)) AS i)), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id)
SELECT doc_id AS id, text_hash, i AS position, round(x / norm, 6) AS value FROM v JOIN n USING (doc_id)""")
def vector_index_rows(spark, d):
    """An index over all documents, built in two sessions of portions, read back through its manifest."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    embed_missing(docs.where("id % 3 = 0"), path, X.stable_vector, "stable", "1", 2)
    build(docs, path, X.stable_vector, "stable", "1", 2)
    return read(spark, path).select("id", "text_hash", F.posexplode("vector").alias("position", "value")).select("id", "text_hash", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))
