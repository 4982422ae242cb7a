"""Edit-aware token counts with a segment tree per document.

A document's text is kept as leaves of whole pre-tokens, about ``LEAF`` characters each; the inner nodes of its tree hold
sums of characters and of tokens. ``build`` encodes texts once and gives their trees as a table: the sums, in the order
of a heap. ``apply_edits`` takes that table, a table of edits and the texts of edited documents only. An edit goes down
the tree by characters to the leaves it touches. These and one leaf of context on either side are pre-tokenised and
encoded anew, more leaves to the right until the old and new pre-tokens share a boundary again; then the sums above them
are updated. The rest is never encoded again, and what it returns are texts and trees that take the next edits.

Edits are (at, removed, inserted): at a character of the unedited text, remove so many and insert a string. Those of one
document apply together, in any order. An edit that overlaps an earlier one by position, or lies outside the text, is
refused and counted as such; null edits and null inserted strings count as none and empty. Null texts are empty. Every
row of the input gives a row; rows alike in doc_id and text have the same tree. Edits of a doc_id without a row, or of a
null one without the text's key, have no effect. Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, boundaries, tokenizer
from .common import settle

LEAF = 256
#: A space between letters always begins a pre-token: no alternative of the pattern goes on over it.
CERTAIN = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Beyond the end of a region, so that what touches the end is seen whole.
LOOK = 64
EDITS = "array<struct<at:int,removed:int,inserted:string>>"


def leaf_ends(text: str) -> Iterator[int]:
    """Ends of leaves, at boundaries of pre-tokens: certain ones, and in stretches without these whatever is found."""
    at = 0
    while at < len(text):
        found = CERTAIN.search(text, at + LEAF)
        end = found.start() if found else len(text)
        if end - at >= 4 * LEAF:
            last = at
            for b in boundaries(text[at:end]):
                if at + b - last >= LEAF and at + b < end:
                    last = at + b
                    yield last
        yield end
        at = end


class SegmentTree:
    """Leaves of one text with sums of (characters, tokens)."""

    def __init__(self, text: str, encoding, sums: Iterable[tuple[int, int]] | None = None) -> None:
        """sums: of a tree that was stored; without them the text is encoded."""
        self.encoding, self.encoded = encoding, 0
        if sums is not None:
            self.sums = list(sums)
            self.width = len(self.sums) // 2
            ends = [0, *accumulate(n for n, _ in self.sums[self.width :])]
            self.leaves = [text[a:b] for a, b in pairwise(ends)]
            return
        ends = [0, *leaf_ends(text)]
        self.leaves = [text[a:b] for a, b in pairwise(ends)] or [""]
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.width + i] = (len(leaf), self._count(leaf))
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def _add(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    def _put(self, leaf: int, text: str) -> None:
        if text:
            self.encoded += len(text)
        self.leaves[leaf] = text
        i = self.width + leaf
        self.sums[i] = (len(text), self._count(text))
        while i > 1:
            i //= 2
            self._add(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one for the end), and the leaf's start."""
        i, start = 1, 0
        while i < self.width:
            left = self.sums[2 * i][0]
            i, at, start = (2 * i, at, start) if at < left else (2 * i + 1, at - left, start + left)
        leaf = i - self.width
        while leaf >= len(self.leaves) or not self.leaves[leaf] and leaf:
            leaf -= 1
            start -= len(self.leaves[leaf]) if leaf < len(self.leaves) else 0
        return leaf, start

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with text in a direction, or the same one at the end."""
        i = leaf + step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i if 0 <= i < len(self.leaves) else leaf

    def edit(self, at: int, removed: int, inserted: str) -> None:
        size = self.sums[1][0]
        if not 0 <= at <= at + removed <= size:
            raise ValueError(f"edit at {at} of {removed} characters lies outside a text of {size}")
        low, start = self.find(at)
        high, _ = self.find(at + removed)
        before = self._beside(low, -1)
        start -= len(self.leaves[before]) if before < low else 0
        low = before
        while True:
            high = self._beside(high, 1)
            region = "".join(self.leaves[low : high + 1])
            new = region[: at - start] + inserted + region[at - start + removed :]
            beyond, i = "", high
            while len(beyond) < LOOK and (j := self._beside(i, 1)) != i:
                i, beyond = j, beyond + self.leaves[j]
            if not beyond:
                break
            marks = boundaries(new + beyond)
            if marks[bisect_left(marks, len(new))] == len(new):
                break
        self._put(low, new)
        for i in range(low + 1, high + 1):
            if self.leaves[i]:
                self._put(i, "")

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def _apply(tree: SegmentTree, edits: Iterable) -> tuple[int, int]:
    """Numbers of edits applied and refused; from the last position to the first so that the others stay right."""
    size, end, fit, refused = tree.sums[1][0], 0, [], 0
    for e in sorted((e for e in edits if e is not None), key=lambda e: (e["at"], e["removed"], e["inserted"] or "")):
        if end <= e["at"] <= e["at"] + e["removed"] <= size and e["removed"] >= 0:
            fit.append(e)
            end = e["at"] + e["removed"]
        else:
            refused += 1
    for e in reversed(fit):
        tree.edit(int(e["at"]), int(e["removed"]), e["inserted"] or "")
    return len(fit), refused


def _build(vocabulary: str) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(vocabulary)
        for batch in batches:
            sums = [SegmentTree(text or "", encoding).sums for text in batch["text"]]
            yield batch[["doc_id", "key"]].assign(chars=[[a for a, _ in x] for x in sums], tokens=[[b for _, b in x] for x in sums])

    return work


def _edited(vocabulary: str) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for text, chars, tokens, edits in zip(batch["text"], batch["chars"], batch["tokens"], batch["edits"], strict=True):
                tree = SegmentTree(text or "", encoding, zip(chars.tolist(), tokens.tolist(), strict=True))
                n, refused = _apply(tree, edits)
                rows.append((tree.text, [a for a, _ in tree.sums], [b for _, b in tree.sums], n, refused, tree.encoded))
            out = pd.DataFrame(rows, columns=["text", "chars", "tokens", "n_edits", "n_refused", "n_reencoded"])
            yield pd.concat([batch[["doc_id", "key"]].reset_index(drop=True), out], axis=1)

    return work


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text, which tells rows of one doc_id apart) and text."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def build(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, key, chars and tokens for every row of docs: the sums of its tree, the root's at 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInPandas(_build(vocabulary), f"doc_id {kind}, key long, chars array<int>, tokens array<int>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, key, text, chars, tokens, n_edits, n_refused and n_reencoded (characters) of each edited doc_id and text.

    docs: doc_id and text, of which those with edits are read on. trees: as built from these. edits: doc_id, at, removed,
    inserted, and key where an edit is of one text of its doc_id only. key stays that of the unedited text; text, chars
    and tokens are the new ones.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    edit = F.collect_list(F.struct("at", "removed", "inserted")).cast(EDITS).alias("edits")
    if "key" in edits.columns:
        mine = edits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(edit)
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    else:
        mine = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(edit)
        same = F.col("doc_id") == F.col("_id")
    todo = settle(trees.dropDuplicates(["doc_id", "key"]).join(mine, same).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "chars", "tokens", "edits"), "todo")
    texts = keyed(docs).join(todo, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).drop("_id", "_key").dropDuplicates(["doc_id", "key"])
    return texts.mapInPandas(_edited(vocabulary), f"doc_id {kind}, key long, text string, chars array<int>, tokens array<int>, n_edits long, n_refused long, n_reencoded long")


def count(docs: DataFrame, edits: DataFrame, edited: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_refused and n_reencoded for every row of docs, by stored trees.

    edited: the rows of docs that edits can be of, where fewer than all are known to be; only their texts are joined.
    """
    trees = settle(build(docs, vocabulary), "trees")
    after = settle(apply_edits(docs if edited is None else edited, trees, edits, vocabulary).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.get("tokens", F.lit(1)).cast("long").alias("_after"), "n_edits", "n_refused", "n_reencoded"), "after")
    before = F.get("tokens", F.lit(1)).cast("long")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = trees.join(after, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", before.alias("n_tokens"), F.coalesce("_after", before).alias("n_tokens_after"), none("n_edits"), none("n_refused"), none("n_reencoded"))


#: Tried only where a run of its characters begins, so that a very long word is passed once.
EMAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def with_addresses(docs: DataFrame) -> DataFrame:
    """The rows of docs in which EMAIL can match."""
    return docs.where(F.col("text").contains("@"))


def redactions(docs: DataFrame, pattern: str = EMAIL, inserted: str = "<email>") -> DataFrame:
    """The edits that replace every match of a pattern: doc_id, key, at, removed, inserted. One set for rows alike."""
    matcher = re.compile(pattern)

    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"at": m.start(), "removed": m.end() - m.start(), "inserted": inserted} for m in matcher.finditer(t or "")] for t in texts])

    found.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    some = keyed(with_addresses(docs) if pattern == EMAIL else docs).select("doc_id", "key", F.explode(F.pandas_udf(found, EDITS)("text")).alias("e"))
    return some.select("doc_id", "key", "e.*").distinct()
