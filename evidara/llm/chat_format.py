"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the assistant and the
others as users by name; masks name the characters that a loss counts, the participant's words and closing marks. A row
holds at most ``TURNS`` turns of the dialogue; a longer one goes on in further parts, so no task gathers a whole large
one. Each further part begins with the system turns of the first, so that what they ask for is in front of every part.

Turns are in the order of turn, rows with one number by a hash of who says what; null numbers come first. A turn's place
is the sum of three counts, of blocks of numbers, of numbers and hashes in its block, and of rows alike in these, so a
conversation of any size is numbered without sorting it in one task. Repeated rows are repeated turns, counted before
the shuffle.

Roles are taken as names; ``system`` is an instruction to all and no participant. Null roles and blank ones are the
participant "unknown"; null texts are empty; rows without a conv_id make a conversation of their own name (null).
Markers inside texts and names are broken by a space, and line breaks in names are spaces, so nobody can forge a turn.
A conversation of system turns only has no participant and gives no rows; neither does an empty table. Other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
TURNS = 256
#: Numbers of turn to a block, and hexadecimal digits of the hash that part rows of one number.
NUMBERS, DIGITS = 1024, 3


def _said(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark[:-2] + " |>"))
    return text


def numbered(said: DataFrame) -> DataFrame:
    """said with before: how many turns come before each row of its conversation."""
    upto = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = said.groupBy("conv_id", "block", "turn", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("in_block", upto(["turn", "bin"], "conv_id", "block"))
    blocks = said.groupBy("conv_id", "block").agg(F.sum("n").alias("n")).withColumn("in_conv", upto(["block"], "conv_id"))
    known = lambda df, names: df.select(*[F.col(x).alias(f"_{x}") for x in names], *[c for c in df.columns if c.startswith("in_")])
    alike = lambda names: [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names]
    places = known(bins, ["conv_id", "block", "turn", "bin"]).join(known(blocks, ["conv_id", "block"]).withColumnsRenamed({"_conv_id": "_c", "_block": "_b"}), F.col("_conv_id").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b")))
    places = settle(places.select("_conv_id", "_turn", "_bin", (F.col("in_block") + F.col("in_conv")).alias("_before")), "places")
    inner = said.withColumn("in_bin", upto(["hash", "author", "body"], "conv_id", "turn", "bin"))
    return inner.join(places, alike(["conv_id", "turn", "bin"])).select("conv_id", "author", "body", (F.col("_before") + F.col("in_bin")).alias("before"), "n")


def distinct_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, author, body, with how often each is said (n), and the block, hash and bin that it is numbered by."""
    author = F.when(F.coalesce(F.btrim("role"), F.lit("")) == "", UNKNOWN).otherwise(F.col("role"))
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), author.alias("author"), F.coalesce("text", F.lit("")).alias("body"))
    said = said.groupBy("conv_id", "turn", "author", "body").agg(F.count("*").alias("n")).withColumn("hash", F.md5(F.concat_ws("|", "author", "body").cast("binary")))
    return settle(said.withColumns({"block": F.floor(F.col("turn") / NUMBERS), "bin": F.substring("hash", 1, DIGITS)}), "said")


def rotate(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, masks and n_trained: each participant's view of each part of the dialogue.

    most: turns of a part, without the system turns that a further part repeats, of which there are as many at most.
    masks: start-end of the trained spans, in characters of text, joined by commas. n_trained: their characters. Turns
    meet by conversation and part once, and are rendered for every speaker behind the last shuffle.
    """
    said = distinct_turns(turns)
    speakers = settle(said.where(F.col("author") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("author").alias("speaker")).distinct(), "speakers")
    rows = numbered(said)
    first, last = F.floor(F.col("before") / most), F.floor((F.col("before") + F.col("n") - 1) / most)
    rows = rows.withColumn("part", F.explode(F.sequence(first, last)))
    times = F.least(F.col("before") + F.col("n"), (F.col("part") + 1) * most) - F.greatest("before", F.col("part") * most)
    one = F.struct(F.greatest("before", F.col("part") * most).alias("at"), times.cast("int").alias("times"), "author", "body")
    parts = settle(rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(one)).alias("said")), "parts")
    if parts.where("part > 0").take(1):
        asked = F.filter("said", lambda x: x["author"] == SYSTEM)
        opening = parts.where("part = 0").select(F.col("conv_id").alias("_o"), asked.alias("asked")).where(F.size("asked") > 0)
        later = parts.where("part > 0").join(opening, F.col("conv_id").eqNullSafe(F.col("_o")), "left")
        later = later.select("conv_id", "part", F.concat(F.coalesce("asked", F.slice("said", 1, 0)), F.col("said")).alias("said"))
        parts = parts.where("part = 0").unionByName(later)
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def turn(x: Column) -> Column:
        own = x["author"] == F.col("speaker")
        role = F.when(x["author"] == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.translate(_said(x["author"]), "\r\n", "  ")))
        return F.array_repeat(F.struct(F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), F.concat(_said(x["body"]), F.lit(CLOSE + "\n")).alias("tail"), own.alias("own")), x["times"])

    parts = seen.select("conv_id", "speaker", "part", F.flatten(F.transform("said", turn)).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("masks"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, x: Column) -> Column:
        low = a["at"] + F.length(x["head"])
        high = low + F.length(x["tail"])
        masks = F.when(x["own"], F.concat(a["masks"], F.array(F.concat_ws("-", low, high)))).otherwise(a["masks"])
        return F.struct(high.alias("at"), masks.alias("masks"), (a["n"] + F.when(x["own"], F.length(x["tail"])).otherwise(0)).alias("n"))

    parts = parts.withColumn("m", F.aggregate("s", start, add))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["tail"])), "")
    return parts.select("conv_id", "speaker", "part", F.size("s").cast("long").alias("n_turns"), text.alias("text"), F.array_join("m.masks", ",").alias("masks"), F.col("m.n").alias("n_trained"))
