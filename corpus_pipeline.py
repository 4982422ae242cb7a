"""Five stages that make training text of the documents table; each one's output is written as Parquet and reread.

Every stage takes rows with null ids or texts, repeated rows, columns of any further name and empty tables. A stage that
filters returns rows as they are; repeated rows are judged alike, but for near copies, of which one doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import bpe, decontamination, near_duplicates, quality_rules, substring_dedup
from evidara.llm.common import settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list and its base rule keep.

    Null and empty texts have no words and go by the base rule, ids or not. Without labels of both kinds there is no list.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null, empty and blank texts and rows without a doc_id are near to nothing and stay. Rows of one doc_id stay or go
    together.
    """
    return near_duplicates.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; n_chars follows the text.

    Every row comes back. Null texts stay null, rows without a doc_id are not edited, and rows of one doc_id do not count
    as earlier for each other.
    """
    cut = substring_dedup.remove_repeats(docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(length).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of the benchmark.

    Null and empty texts have no words and stay, as does every document if the benchmark is empty.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes; a null text counts as empty."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: Learned rules and BPE merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
