"""Removal of passages of 50 words or more that an earlier document already has, by a compacted de Bruijn graph.

The graph's edges are token k-mers of 50 words, its nodes the 49 words that neighbouring edges share; a document is a
walk. As in BCALM (Chikhi, Limasset and Medvedev 2016), edges are dealt out by their minimizer, the 17 words of least
hash among the 34 such pieces of the 50, so equal edges meet wherever they are; a maximal run of edges with one
minimizer is a fragment of a path: minimizer, hash of the whole fragment, document and source coordinates, and the
fragments before and behind it.

1. Minimizers of one document only are dropped: none of their edges repeats.
2. A fragment branches if the documents that hold its minimizer do not all agree on it. Degrees of the others come from
   one count: a fragment whose every copy has the same next one, which in turn always has this one before it, is joined
   to it. Joins that double their reach compact these chains to paths, known by their first fragment.
3. Every copy of a compacted path is spelled out at its source coordinates and named by 128 bits of its words; so is,
   of branching fragments, each edge of the first document that holds them (later holders have the path whole). A path
   or edge goes from every document but the least that has it.

So only repeated text is spelled out, once a path. Hot passages meet as counts, combined before each shuffle; joins back
are with written tables, whose hot partitions Spark splits.

Null, empty and short texts lose nothing. Windows are judged on the input. Rows with a null doc_id are neither sources
nor edited. A doc_id in several rows is one source for the others; rows alike in doc_id never count as earlier for each
other, and all rows come back, each judged by its own text. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, free_name, settle
from .shingles import mix, sliding_minimum, window_hashes, word_hashes

WINDOW, MINIMIZER = 50, 17
_SECOND_BASE = 0xD1342543DE82EF95


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _text_key(text: str) -> Column:
    """Tells rows of one doc_id apart; in Python the same is zlib.crc32 of the text's bytes."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")


def _runs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    cut = np.flatnonzero(edges[1:] != edges[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(edges)]]) - 1


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = np.zeros(1, np.int64)
    for batch in batches:
        found = {k: [] for k in ("t", "minimizer", "fragment", "before", "behind", "start", "end")}
        docs = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            data = _data(text)
            words = word_hashes(data)
            if len(words) < WINDOW:
                continue
            least = sliding_minimum(window_hashes(words, MINIMIZER), WINDOW - MINIMIZER + 1)
            first, last = _runs(least)
            edges = window_hashes(words, WINDOW)
            # Up to 50 edges overlap, so the first and last spell all of a fragment's words; longer ones take every edge.
            name = mix(edges[first] + mix(edges[last] + (last - first).astype(np.uint64)))
            for i in np.flatnonzero(last - first >= WINDOW):
                name[i] = mix(np.uint64(31) + np.bitwise_xor.reduce(mix(edges[first[i] : last[i] + 1] + np.arange(last[i] - first[i] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keepdims=True))[0]
            name = name.view(np.int64)
            values = np.full(len(first), zlib.crc32(data)), least[first].view(np.int64), name, np.concatenate([none, name[:-1]]), np.concatenate([name[1:], none]), first, last
            for x, y in zip(found.values(), values, strict=True):
                x.append(y)
            docs.append(np.full(len(first), doc_id))
        if docs:
            yield pd.DataFrame({"doc_id": np.concatenate(docs)} | {k: np.concatenate(v) for k, v in found.items()})


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """128 bits of the words of each compacted path, and of the edges of those branching fragments that are to be spelled."""
    for batch in batches:
        parts = []
        for doc_id, t, text, spans in zip(batch["doc_id"], batch["t"], batch["text"], batch["spans"], strict=True):
            data, single, rows, run = _data(text), [], [], None
            words = data.split()
            for start, end, path, spelled in sorted({(x["start"], x["end"], x["path"], x["spelled"]) for x in spans}):
                if spelled:
                    single.append(np.arange(start, end + 1))
                elif run and run[1] + 1 == start and run[2] == path:
                    run[1] = end
                else:
                    run = [start, end, path]
                    rows.append(run)
            digests = [np.frombuffer(hashlib.blake2b(b" ".join(words[s : e + WINDOW]), digest_size=16).digest(), np.int64) for s, e, _ in rows]
            named = pd.DataFrame({"start": [r[0] for r in rows], "end": [r[1] for r in rows], "a": [d[0] for d in digests], "b": [d[1] for d in digests]}, dtype=np.int64)
            if single:
                at, hashes = np.unique(np.concatenate(single)), word_hashes(data)
                a, b = window_hashes(hashes, WINDOW), window_hashes(hashes, WINDOW, _SECOND_BASE)
                named = pd.concat([named, pd.DataFrame({"start": at, "end": at, "a": a[at].view(np.int64), "b": b[at].view(np.int64)})])
            parts.append(named.assign(doc_id=doc_id, t=t))
        if parts:
            yield pd.concat(parts)


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the windows from starts to ends cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(np.asarray(ends) + WINDOW, n), -1)
    return np.cumsum(edge)[:n] > 0


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, starts, ends in zip(batch["doc_id"], batch["text"], batch["starts"], batch["ends"], strict=True):
            words, gone = _data(text).split(), 0
            n = len(words)
            if starts is not None and len(starts):
                covered = _cover(starts, ends, n)
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            rows.append((doc_id, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": batch["doc_id"].dtype})


def _cut(starts_name: str, ends_name: str) -> Callable:
    """Texts without their covered words; white space next to what stays is kept."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if s is None or not len(s) else _without(t, s, e) for t, s, e in zip(batch["text"], batch[starts_name], batch[ends_name], strict=True)]
            yield batch.assign(text=texts).drop(columns=[starts_name, ends_name])

    return work


def _without(text: str, starts: np.ndarray, ends: np.ndarray) -> str:
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    covered = _cover(starts, ends, len(spans))
    out, at = [], 0
    first, last = _runs(covered)
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        if covered[i]:
            out.append(text[at : spans[i][0]])
            at = spans[j + 1][0] if j + 1 < len(spans) else len(text)
    return "".join([*out, text[at:]])


def _compacted(arcs: DataFrame) -> DataFrame:
    """node, up: the first fragment of each node's chain. arcs: node, up, with one row for a node and for an up at most.

    The reach of up doubles with each join, so a chain of n fragments takes log2(n) of them.
    """
    now = settle(arcs, "arcs")
    for _ in range(64):
        reach = now.select(F.col("node").alias("_at"), F.col("up").alias("_up"))
        joined = now.join(reach, F.col("up") == F.col("_at"), "left").select("node", F.coalesce("_up", "up").alias("up"), F.col("_at").isNotNull().alias("grew"))
        before, now = now, settle(joined, "arcs")
        discard(before)
        if not now.where("grew").take(1):
            return now.select("node", "up")
    raise RuntimeError("a chain of fragments has no first one")


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, t, starts, ends: per document, the runs of windows whose words go. One row for a document at most."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    fragments = settle(docs.mapInPandas(_fragments, f"doc_id {kind}, t long, minimizer long, fragment long, before long, behind long, start int, end int"), "fragments")
    held = fragments.groupBy("minimizer").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other"), F.min("fragment").alias("low"), F.max("fragment").alias("high"))
    repeated = settle(held.where("first <> other").select("minimizer", (F.col("low") != F.col("high")).alias("branches")), "repeated")
    shared = settle(fragments.join(repeated, "minimizer").drop("minimizer"), "shared")
    discard(fragments, repeated)

    ends = {f"{least}_{x}": f(x) for x in ("before", "behind") for least, f in (("low", F.min), ("high", F.max))}
    nodes = settle(shared.groupBy("fragment").agg(F.min("doc_id").alias("holder"), F.max("branches").alias("branches"), *[v.alias(k) for k, v in ends.items()]), "nodes")
    plain = nodes.where("NOT branches")
    left = plain.where("low_behind = high_behind").select(F.col("fragment").alias("up"), F.col("low_behind").alias("node"))
    right = plain.where("low_before = high_before").select(F.col("fragment").alias("node"), F.col("low_before").alias("up"))
    chains = _compacted(left.join(right, ["node", "up"]))
    known = settle(nodes.select("fragment", "holder", "branches").join(chains, F.col("fragment") == F.col("node"), "left").select("fragment", "branches", "holder", F.coalesce("up", "fragment").alias("path")), "paths")
    spans = shared.join(known.drop("branches"), "fragment")
    # A branching fragment is a path by itself, and its edges are spelled where it is first held.
    whole = F.struct("start", "end", "path", F.lit(False).alias("spelled"))
    each = F.struct("start", "end", "path", F.lit(True).alias("spelled"))
    spans = spans.select("doc_id", "t", F.explode(F.when(F.col("branches") & (F.col("holder") == F.col("doc_id")), F.array(whole, each)).otherwise(F.array(whole))).alias("x"))
    spans = settle(spans.groupBy("doc_id", "t").agg(F.collect_list("x").alias("spans")), "spans")
    discard(shared, nodes, chains, known)

    keyed = docs.select(F.col("doc_id").alias("_id"), "text", _text_key("text").alias("_t"))
    spelled = keyed.join(spans, (F.col("_id") == F.col("doc_id")) & (F.col("_t") == F.col("t"))).select("doc_id", "t", "text", "spans")
    named = settle(spelled.mapInPandas(_spell, f"doc_id {kind}, t long, start int, end int, a long, b long"), "named")
    least = settle(named.groupBy("a", "b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("other")).where("source <> other").drop("other"), "least")
    gone = named.join(least, ["a", "b"]).where("doc_id <> source")
    out = settle(gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s")).select("doc_id", "t", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")), "repeats")
    discard(spans, named, least)
    return out


def _with_repeats(docs: DataFrame, names: tuple[str, str], work: Callable, schema: str | StructType) -> DataFrame:
    mine, own = free_name(docs, "_id"), free_name(docs, "_t")
    runs = find_repeats(docs).select(F.col("doc_id").alias(mine), F.col("t").alias(own), F.col("starts").alias(names[0]), F.col("ends").alias(names[1]))
    return docs.join(runs, (docs["doc_id"] == runs[mine]) & (_text_key("text") == runs[own]), "left").drop(mine, own).mapInPandas(work, schema)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_repeats(docs.select("doc_id", "text"), ("starts", "ends"), _digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from text; the other columns unchanged."""
    names = free_name(docs, "starts"), free_name(docs, "ends")
    return _with_repeats(docs, names, _cut(*names), docs.schema)
