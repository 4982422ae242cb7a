"""Readers and writers: Parquet tables, JSON lines, CSV, whole files and HTML, and manifests of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core, by Spark's own estimate, under which a table in fewer files than cores is dealt out.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small and in fewer files than these: one row group is read by one task.

    Larger tables, and those of many files, stay as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object to a line; blank lines are skipped. strict fails on bad JSON, else it is kept in _corrupt_record."""
    reader = spark.read.schema(schema)
    return (reader.option("mode", "FAILFAST") if strict else reader.option("columnNameOfCorruptRecord", "_corrupt_record")).json(path)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, quoted fields may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256, is_binary and n_lines of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    binary = F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\x00") > 0
    lines = F.when(binary, F.lit(None)).otherwise(F.size(F.split(F.decode("content", "ISO-8859-1"), "\n")) - 1)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), binary.alias("is_binary"), lines.cast("long").alias("n_lines"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """Sections of numbered standards text: heading lines such as '2.1. Title'; without any, one section named full.

    Empty sections and what stands before the first heading are dropped.
    """
    # Fixed value: what a numbered heading is.
    heading = r"(?m)^(\d+(?:\.\d+)*\.?)\s+([A-Z][^\n]{2,120})$"
    parts = F.split(F.col(text), rf"(?m)(?=^\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{{2,120}}$)")
    named = F.transform(F.filter(parts, lambda p: p.rlike(heading)), lambda p: F.struct(F.regexp_extract(p, heading, 1).alias("section_id"), F.btrim(F.regexp_extract(p, heading, 2)).alias("heading"), F.btrim(F.regexp_replace(p, r"\A[^\n]*\n?", ""), F.lit(" \n\r\t")).alias("content")))
    full = F.array(F.struct(F.lit("full").alias("section_id"), F.lit("full").alias("heading"), F.btrim(F.col(text)).alias("content")))
    sections = F.when(F.col(text).rlike(heading), F.filter(named, lambda s: s["content"] != "")).otherwise(full)
    return documents.select("*", F.posexplode(sections).alias("position", "s")).select(*documents.columns, "position", "s.*")


def top_level_blocks(documents: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of YAML text by top-level key, with title and version taken from the whole."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^[A-Za-z_][\w-]*:\s*$)"), lambda p: p.rlike(r"\A[A-Za-z_][\w-]*:\s*(\n|\z)"))
    return documents.select(
        "*", F.regexp_extract(text, r"(?m)^\s*title:\s*['\"]?([^'\"\n]+)", 1).alias("title"), F.regexp_extract(text, r"(?m)^\s*version:\s*['\"]?([^'\"\n]+)", 1).alias("version"), F.posexplode(parts).alias("position", "block")
    ).withColumn("key", F.regexp_extract("block", r"\A([^:]+):", 1))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """List columns are joined by a semicolon, other nested ones become JSON."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name) if f.dataType.simpleString() in ("array<string>", "array<bigint>", "array<int>") else F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "struct", "map")) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def publish(df: DataFrame, path: str, key: str) -> dict:
    """Write Parquet with Spark's committer and return a manifest: rows, distinct keys, and an order-free content hash."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    row = written.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.hex(F.bit_xor(F.xxhash64(*written.columns))).alias("content_hash")).first()
    return row.asDict() | {"path": path, "schema": written.schema.simpleString()}


def content_addressed(files: DataFrame) -> DataFrame:
    """One row for each distinct content: sha256, size, object path and the first path that had it."""
    return files.groupBy("sha256").agg(F.min("size").alias("size"), F.min("path").alias("first_path"), F.count("*").alias("n_paths")).withColumn("object_path", F.concat(F.lit("objects/sha256/"), "sha256"))
