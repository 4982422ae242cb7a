"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks of ``chunk`` characters that overlap by ``overlap``, and each is pre-tokenised by itself.
The pattern looks ahead but never back, so two pre-tokenisations that share one boundary share all later ones:
neighbours are stitched at the first boundary that both have inside their overlap. Where they share none (one pre-token
fills the overlap), the chunks are joined and done over as one. The pieces between stitches are encoded apart, and their
ids concatenated in order. A text of more than ``spread`` characters is first cut so into chunks ``DEALT`` times as
long, which Spark deals out to all tasks; its pieces are then encoded like other texts. Decoding concatenates the bytes
of the ids.

Null texts count as empty and have no ids. Rows alike in doc_id and text are all returned. Other columns are not
looked at. ``vocabulary`` names a file of public_tokenizers, which every executor must have.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 2_048, 256
#: Characters from which a text's chunks are dealt out, and how much longer those are than a task's own.
SPREAD, DEALT = 1 << 18, 16


def tokenizer(vocabulary: str = VOCABULARY):
    """The ranks of a vocabulary file as a tiktoken encoding without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def boundaries(text: str) -> list[int]:
    """Where pre-tokens begin, and the end of the text."""
    import public_tokenizers
    import regex

    return [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] + [len(text)]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Where each chunk begins, and the chunk with the overlap behind it."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(len(text) - overlap, 1), chunk)]


def ends(part: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The boundaries at either end of a chunk; what touches its very end may go on behind it."""
    at = boundaries(part)
    return at[: bisect_right(at, overlap)], at[bisect_left(at, chunk) : bisect_left(at, len(part))]


def pieces(text: str, chunk: int, overlap: int) -> Iterator[str]:
    """The text between the stitches of its chunks."""
    first, tail = 0, []
    chunks = cut(text, chunk, overlap)
    for k, (start, part) in enumerate(chunks):
        own = None
        if k:
            head, own = ends(part, chunk, overlap)
            seam = min(set(tail).intersection(start + h for h in head), default=None)
            if seam is None:
                own = None
            else:
                yield text[first:seam]
                first = seam
        if k + 1 < len(chunks):
            # Without a stitch the chunk is joined to what is before it and done over from the last one.
            at, joined = (start, part) if own is not None else (first, text[first : start + len(part)])
            own = own if own is not None else ends(joined, start - first + chunk, overlap)[1]
            tail = [at + x for x in own]
    yield text[first:]


def encode_text(encoding, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    return list(chain.from_iterable(map(encoding.encode_ordinary, pieces(text, chunk, overlap))))


def _encode_whole(vocabulary: str, chunk: int, overlap: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary)
        for batch in _slices(batches):
            ids = [np.array(encode_text(encoding, t or "", chunk, overlap), np.int32) for t in batch["text"].to_pylist()]
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, np.concatenate(ids))], ["doc_id", "ids"])

    return work


def _chunks(chunk: int, overlap: int) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                starts, parts = zip(*cut(text, chunk, overlap), strict=True)
                rows = pd.DataFrame({"k": range(len(starts)), "start": starts, "part": parts})
                yield rows.assign(doc_id=pd.Series([doc_id] * len(rows), dtype=batch["doc_id"].dtype), key=[key] * len(rows), size=len(text))

    return work


def _scan(chunk: int, overlap: int) -> Callable:
    """The boundaries at either end of each chunk, as positions in the text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, tails = [], []
            for start, part in zip(batch["start"], batch["part"], strict=True):
                head, tail = ends(part, chunk, overlap)
                heads.append([start + x for x in head])
                tails.append([start + x for x in tail])
            yield batch.assign(head=heads, tail=tails)

    return work


def _encode_pieces(vocabulary: str, chunk: int, overlap: int) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(vocabulary)
        for batch in batches:
            out = []
            for parts, first, stop, stitched in zip(batch["parts"], batch["first"], batch["stop"], batch["stitched"], strict=True):
                parts = sorted(parts, key=lambda p: p["k"])
                at = parts[0]["start"]
                text = "".join([p["part"][: q["start"] - p["start"]] for p, q in pairwise(parts)] + [parts[-1]["part"]])
                piece = text[first - at : stop - at]
                if len(parts) > 1 and stitched and stop - first not in set(boundaries(text[first - at :])):
                    raise ValueError("joined chunks have no boundary where the next one begins")
                out.append(encode_text(encoding, piece, chunk, overlap))
            yield batch[["doc_id", "key", "k", "copies"]].assign(ids=out)

    return work


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    short, long = _by_length(docs, spread)
    return short.mapInArrow(_encode_whole(vocabulary, chunk, overlap), f"doc_id {kind}, ids array<int>").union(_encode_dealt(long, vocabulary, chunk, overlap))


def _by_length(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > most
    return docs.where(~long), docs.where(long)


def _encode_dealt(docs: DataFrame, vocabulary: str, small: int, small_overlap: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunk, overlap = DEALT * small, DEALT * small_overlap
    parts = docs.mapInPandas(_chunks(chunk, overlap), f"doc_id {kind}, key binary, size int, k int, start int, part string")
    # The grouping deals a text's chunks out to all tasks; repeated rows meet and are counted.
    parts = parts.groupBy("doc_id", "key", "k", "start", "size").agg(F.first("part").alias("part"), F.count("*").alias("copies"))
    scanned = parts.mapInPandas(_scan(chunk, overlap), f"doc_id {kind}, key binary, k int, start int, size int, part string, copies long, head array<int>, tail array<int>")
    order = Window.partitionBy("doc_id", "key").orderBy("k")
    last = F.lead("k").over(order).isNull()
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    seams = scanned.withColumn("stop", F.when(last, F.col("size")).otherwise(stitch)).withColumn("stitched", ~last & F.col("stop").isNotNull())
    seams = seams.withColumn("first", F.when(F.col("k") == 0, 0).otherwise(F.lag("stop").over(order)))
    seams = seams.withColumn("run", F.count("first").over(order))  # a chunk without a stitch before it stays in the run
    joined = seams.groupBy("doc_id", "key", "run", "copies").agg(
        F.collect_list(F.struct("k", "start", "part")).alias("parts"), F.min("k").alias("k"), F.max("first").alias("first"), F.max("stop").alias("stop"), F.max("stitched").alias("stitched"),
    )
    pieces = joined.mapInPandas(_encode_pieces(vocabulary, small, small_overlap), f"doc_id {kind}, key binary, k int, copies long, ids array<int>")
    whole = pieces.groupBy("doc_id", "key", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")
    return whole.select("doc_id", ids, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def _decoded(vocabulary: str) -> Callable:
    """Batches with ids, and the bytes of each row's ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary)
        for batch in _slices(batches):
            data = [None if ids is None else encoding.decode_bytes(ids) for ids in batch["ids"].to_pylist()]
            yield batch.append_column("decoded", pa.array(data, pa.binary()))

    return work


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with a column decoded, the bytes of its ids; null ids stay null."""
    return encoded.mapInArrow(_decoded(vocabulary), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def _digests(vocabulary: str, chunk: int, overlap: int, encoded: bool) -> Callable:
    """The result's columns, from texts or from ids; one text's ids are held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary)
        names = [str(i) for i in range(encoding.n_vocab)]
        for batch in _slices(batches):
            counts, sums, back = [], [], []
            for value in batch["ids" if encoded else "text"]:
                ids = value.as_py() if encoded else encode_text(encoding, value.as_py() or "", chunk, overlap)
                counts.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return work


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by a space) and of the decoded bytes."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short, long = _by_length(docs, spread)
    dealt = _encode_dealt(long, vocabulary, chunk, overlap).mapInArrow(_digests(vocabulary, chunk, overlap, encoded=True), schema)
    return short.mapInArrow(_digests(vocabulary, chunk, overlap, encoded=False), schema).union(dealt)
