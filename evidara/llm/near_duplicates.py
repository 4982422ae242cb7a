"""MinHash near-duplicates over five-word shingles.

1. Every text becomes a shingle set in one Python pass. Texts with equal sets form a class, known by a 128-bit hash of
   the set; all further work is on classes, so exact copies cost nothing more.
2. 128 universal hash minima of a set make 32 bands of four, and a sketch of four bits of each; 1024 parities of the
   set join it, which bound the difference of two sets from below, without error. For a pair at the threshold of 0.75,
   the chance that no band agrees is 5e-6.
3. In every bucket with several classes, each class is compared with two of them (the least and greatest hash). Pairs
   whose signatures could reach the threshold are confirmed on full sets; alternating large-star and small-star makes
   clusters of the links. A bucket that lies in one cluster is settled.
4. In the other buckets every pair from different clusters is tested, inside the join and at the first band that the
   pair shares, so only plausible pairs leave it; they are confirmed as before, and the links of both passes make the
   components. So no link that a band finds is lost, and a large group of copies is never paired with itself. A bucket
   of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks meets in a task of its own.

Null, empty and blank texts have empty sets and link with nothing, as do rows without a doc_id (component_id null,
kept). A doc_id in several rows is judged row by row; all rows come back. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, drop_matching, settle
from .shingles import mix, shingle_set

HASHES, ROWS, SKETCH_LONGS, NIBBLES = 128, 4, 8, 16
#: At a similarity of 0.75 a pair differs in 30 of 128 nibbles, with a deviation of 4.8; beyond this it is no candidate.
MAX_DIFFERENT = 60
#: Classes of a bucket that one task compares with each other.
BLOCK = 1024
#: Bits of a set's parity sketch: bit i is set if an odd number of shingles hash to i.
PARITY_LONGS = 16
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.int64).view(np.uint64)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() folds A-Z only


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes a * x + b modulo 2 ** 64; a long set is taken in parts."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _sketch(minima: np.ndarray) -> np.ndarray:
    nibbles = (mix(minima) & np.uint64(15)).reshape(SKETCH_LONGS, NIBBLES)
    return np.bitwise_or.reduce(nibbles << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4)), axis=1)


def _parity(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(shingles) % np.uint64(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(bits.astype(bool)).view(np.uint64)


def _bands(minima: np.ndarray) -> np.ndarray:
    key = np.arange(HASHES // ROWS, dtype=np.uint64)
    for column in minima.reshape(-1, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            shingles = shingle_set(_data(text))
            if len(shingles):
                minima = _minima(shingles)
                rows.append((doc_id, len(shingles), _class_of(shingles), _signed(np.append(_sketch(minima), _parity(shingles))), _signed(_bands(minima))))
            else:
                rows.append((doc_id, 0, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "c", "sketch", "bands"]).astype({"doc_id": batch["doc_id"].dtype})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(_data(text)) for text in batch["text"]]
        rows = [(c, s.tobytes()) for c, s in zip(batch["c"], sets, strict=True) if _class_of(s) == bytes(c)]
        yield pd.DataFrame(rows, columns=["c", "s"])


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["sa"], batch["sb"], strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.loc[np.array(keep, bool), ["u", "v"]]


def _different(a: str, b: str) -> Column:
    """In how many nibbles two sketches differ."""
    ones = F.lit(0x1111111111111111)

    def part(i: int) -> Column:
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))

    return reduce(lambda p, q: p + q, [part(i) for i in range(SKETCH_LONGS)])


def _odd(a: str, b: str) -> Column:
    """In how many parity bits two sets differ; never more than the members that only one of them has."""
    at = range(SKETCH_LONGS, SKETCH_LONGS + PARITY_LONGS)
    return reduce(lambda p, q: p + q, [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in at])


def _plausible(na: str, nb: str, a: str, b: str) -> Column:
    """Whether a pair can be alike by 0.75: then at most a seventh of both sizes lies outside the intersection."""
    sizes = 100 * F.least(na, nb) >= 75 * F.greatest(na, nb)
    return sizes & (7 * _odd(a, b) <= F.col(na) + F.col(nb)) & (_different(a, b) <= MAX_DIFFERENT)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar on their full sets."""
    both = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("sa")), "u").join(sets.select(F.col("c").alias("v"), F.col("s").alias("sb")), "v")
    return both.select("u", "v", "sa", "sb").mapInPandas(_confirm, "u binary, v binary")


def _edges(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Edges with the components of all links: from each node of the first pass to its cluster, and the second's links."""
    classes = settle(signed.where("c IS NOT NULL AND doc_id IS NOT NULL").select("c", "n", "sketch", "bands").dropDuplicates(["c"]), "classes")
    rows = classes.select("c", F.explode("bands").alias("b"))
    shared = settle(rows.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high"), "shared")
    members = settle(rows.join(shared, "b"), "members")
    one = members.select("c").distinct().join(classes, "c")
    named = settle(one, "named")
    least = signed.where("c IS NOT NULL AND doc_id IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    at = settle(least.join(named.select("c"), "c", "left_semi"), "sources")
    # A merge at every size: else small tables would be broadcast and large ones not.
    sets = docs.select("doc_id", "text").join(at.hint("merge"), "doc_id").select("c", "text").mapInPandas(_sets, "c binary, s binary")
    sets = settle(sets.dropDuplicates(["c"]), "sets")
    discard(classes, shared, at)

    star = members.select(F.col("c").alias("v"), F.explode(F.array("low", "high")).alias("u")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    told = lambda end: named.select(F.col("c").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
    likely = star.join(told("u"), "u").join(told("v"), "v").where(_plausible("nu", "nv", "su", "sv")).select("u", "v")
    first = settle(_confirmed(likely, sets), "links")

    clusters = connected_components(first)
    placed = settle(members.select("b", "c").join(clusters.withColumnRenamed("node", "c"), "c", "left").select("b", "c", F.coalesce("component", "c").alias("k")), "placed")
    open_ = settle(placed.groupBy("b").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("size")).where("low <> high").select("b", F.ceil(F.col("size") / BLOCK).alias("blocks")), "buckets")
    left = settle(placed.join(open_, "b").join(named, "c").withColumn("block", F.pmod(F.xxhash64("c"), "blocks")), "open")
    discard(members, first, placed, open_)
    cell = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    a, b = (cell.select("b", "i", "j", *[F.col(x).alias(f"{x}{end}") for x in ("c", "k", "n", "sketch", "bands", "block")]) for end in "ab")
    same_first = F.get(F.filter(F.zip_with("bandsa", "bandsb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0))
    met = (a["b"] == b["b"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & ((a["i"] == a["j"]) | (F.col("blocka") != F.col("blockb")))
    pairs = a.join(b, met & (F.col("ca") < F.col("cb")) & (F.col("ka") != F.col("kb")) & _plausible("na", "nb", "sketcha", "sketchb") & (same_first == a["b"]))
    second = settle(_confirmed(pairs.select(F.col("ca").alias("u"), F.col("cb").alias("v")), sets), "links")
    discard(sets, named, left)
    return clusters.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second)


def find_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    signed = settle(docs.select("doc_id", "text").mapInPandas(_signatures, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, c binary, sketch array<long>, bands array<long>"), "signatures")
    roots = connected_components(_edges(docs, signed)).select(F.col("node").alias("c"), "component")
    placed = signed.select("doc_id", "n", "c").join(roots, "c", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "c")).alias("root"))
    placed = settle(placed, "placed")
    least = settle(placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    discard(signed)
    out = placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Columns unchanged."""
    return drop_matching(docs, find_components(docs).where("NOT kept"), doc_id=F.col("doc_id"))
