"""Helpers shared by the operators: reading tables, cutting lineage, splitting words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settled import discard, settle, shared_dir
from ..sources import tables

__all__ = ["discard", "drop_matching", "free_name", "settle", "shared_dir", "table", "words_of"]

#: ASCII white space, the separators of words: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of anything but ASCII white space; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it if df already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_matching(docs: DataFrame, gone: DataFrame, **on: Column) -> DataFrame:
    """docs without the rows whose expressions equal (nulls too) the columns of that name in gone; gone is settled, so
    Spark broadcasts it if the table's size is below the session's threshold and else shuffles both sides."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[x.alias(f"_on_{name}") for name, x in on.items()])
    small = settle(gone.select(*[F.col(name).alias(f"_gone_{name}") for name in on]).distinct(), "gone")
    same = [F.col(f"_on_{name}").eqNullSafe(F.col(f"_gone_{name}")) for name in on]
    return row.join(small, same, "left_anti").select("_row.*")
