"""Benchmark decontamination by windows of 13 words, with DataFrame functions only.

The 64-bit hashes of length, first, middle and last word of the benchmark's windows form a broadcast hash set. Each document is
scanned once: at every position the hash of a window is looked up, and only the few that pass are spelled out and
verified by an equality join with the benchmark's windows. A set of more than ``max_broadcast`` hashes is cut into
blocks of that size, each of which scans the documents, so what is broadcast is bounded and nothing else changes.

Null texts have no words and are hit by nothing; so is every text if the benchmark is empty. Benchmark rows without
words, text or item_id are passed over; repeated items count once by item_id. Rows of documents that are alike in
doc_id and text are judged alike and all returned. Columns of any name are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_matching, free_name, settle

WINDOW = 13
#: Everything but digits, ASCII letters (lower case by then) and characters beyond ASCII parts words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    # lower() is faster but also folds letters beyond ASCII, so it serves texts without any.
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, APART), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, len, first, middle, last, item_ids: each distinct window with the items that hold it."""
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = words.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len")).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)))
    one = at.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("g"))
    middle = F.get("g", F.expr("len div 2").cast("int"))
    return one.groupBy(F.array_join("g", " ").alias("gram"), "len", F.col("g")[0].alias("first"), middle.alias("middle"), F.element_at("g", -1).alias("last")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _scan(words: DataFrame, lengths: list[int], hashes: DataFrame) -> DataFrame:
    """words (doc_id, key, w) by position, where the window's hash is in hashes; and one row, with at -1, for each row."""
    n = len(lengths)
    # Position -1 keeps the row itself; the others run through the lengths at each word.
    at = words.select("doc_id", "key", "w", F.explode_outer(F.sequence(F.lit(-1), F.size("w") * n - 1)).alias("j"))
    length = F.element_at(F.array(*[F.lit(x) for x in lengths]), F.when(F.col("j") < 0, 1).otherwise(F.col("j") % n + 1))
    at = at.select("doc_id", "key", "w", F.expr(f"if(j < 0, -1, cast(j div {n} as int))").alias("at"), length.alias("len"))
    last = F.col("at") + F.col("len") - 1
    look = F.when((F.col("at") >= 0) & (last < F.size("w")), F.xxhash64("len", F.get("w", F.col("at")), F.get("w", F.col("at") + F.expr("len div 2").cast("int")), F.get("w", last)))
    near = at.withColumn("look", look).join(F.broadcast(hashes.select(F.col("h").alias("_h"))), F.col("look") == F.col("_h"), "left").where("at < 0 OR _h IS NOT NULL")
    gram = F.when(F.col("at") >= 0, F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " "))
    return near.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "at", "len", gram.alias("gram"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, key, n_words, n_hit, item_ids and spans (start and end of runs of hit words, from 0) for every row of docs."""
    grams = settle(benchmark_windows(items, window), "grams")
    hashes = settle(grams.select(F.xxhash64("len", "first", "middle", "last").alias("h")).distinct(), "hashes")
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect()) or [window]
    blocks = max(1, -(-hashes.count() // max_broadcast))
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), item_words(F.col("text")).alias("w"))
    parts = [_scan(words, lengths, hashes.where(F.pmod("h", F.lit(blocks)) == b)) for b in range(blocks)]
    near = settle(reduce(DataFrame.union, [parts[0], *(p.where("at >= 0") for p in parts[1:])]), "near")
    verified = near.where("at >= 0").join(grams.select("gram", "item_ids"), "gram").select("doc_id", "key", "n_words", "at", "len", "item_ids")
    rows = near.where("at < 0").select("doc_id", "key", "n_words", "at", "len", F.lit(None).cast("array<string>").alias("item_ids")).union(verified)
    by = rows.groupBy("doc_id", "key", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    by = by.withColumns({"n_hit": _covered("hits"), "spans": _spans("hits")})
    # Rows alike in doc_id and text met in one group; each gets its own row again.
    return by.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "key", "n_words", "n_hit", "item_ids", "spans")


def _covered(hits: str) -> Column:
    """How many words the windows cover; they are sorted by start."""

    def add(a: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"]))).cast("long").alias("n"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), add)["n"]


def _spans(hits: str) -> Column:
    """Runs of covered words."""
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    run = lambda p, step: F.filter(p, lambda x, i: (F.coalesce(F.get(p, i + step), F.lit(-2)) != x + step))
    spans = F.transform(F.array(words), lambda p: F.zip_with(run(p, -1), run(p, 1), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))))
    return F.get(spans, F.lit(0))


def judge(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256 and contaminated: 5 % of its words or more are hit."""
    hits = find_hits(docs, items, **options)
    return hits.select(
        "doc_id", "key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """docs without the contaminated rows, its columns unchanged. Rows with a null doc_id are judged too."""
    bad = judge(docs, items, **options).where("contaminated")
    return drop_matching(docs, bad, doc_id=F.col("doc_id"), key=F.xxhash64("text"))


def cut(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """docs with the words of every hit window cut from text, each with what stands before it; other columns unchanged."""
    mine, key, spans = free_name(docs, "_hit_id"), free_name(docs, "_hit_key"), free_name(docs, "_hit_spans")
    hit = find_hits(docs, items, **options).where("n_hit > 0").select(F.col("doc_id").alias(mine), F.col("key").alias(key), F.col("spans").alias(spans))
    hit = settle(hit.dropDuplicates([mine, key]), "hit")
    apart = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # APART, with capitals in words
    pieces = F.regexp_extract_all("text", F.lit(f"[{apart}]*[^{apart}]+"), F.lit(0))
    tail = F.regexp_extract("text", f"[{apart}]*\\z", 0)
    kept = F.filter(pieces, lambda x, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(hit[mine]) & (F.xxhash64(docs["text"]) == hit[key]), "left")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))).select(*docs.columns)
