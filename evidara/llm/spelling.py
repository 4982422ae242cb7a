"""Groups of spelling variants: words one edit apart, found by a Levenshtein automaton over shards of a compact trie.

Words and their counts come from whole texts. The vocabulary is sorted and cut by range into shards of ``SHARD`` words;
a task builds each as a trie in flat arrays, with single tails kept whole. Shards are broadcast in blocks of at most
``BLOCK`` words. A task intersects the distance-one automaton of each of its words with every shard of the block, depth
first: it follows the word itself with its one edit unspent and, at each node, tries the edits that leave it; after an
edit only the exact rest is followed. What the shards accept is reduced in the task to a count and the best neighbour,
and over blocks by one aggregation. Forms are followed to the last by doubling.

A null doc_id is written as an empty one where the damage is dealt; null and empty texts have no words. Each repeated row
counts. A form with equal n is the one of least code points. Without words that are long and frequent enough the result
is empty. Other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, MUCH, DAMAGE = 6, 5, 5, 199
#: Words of a shard, and of the shards that are broadcast at once: at most some 30 bytes a word, 30 MB a block.
SHARD, BLOCK = 20_000, 1_000_000


def word_counts(docs: DataFrame, shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """word, n of every run of at least so many letters; one in ``damage`` of the runs, by hash, loses a letter."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    raw = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), runs.alias("_run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = raw.select("_id", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", upper, upper.lower())).otherwise(F.col("_run")).alias("_run"))
    hashed = low.select("_run", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")).alias("_h"))
    at = F.expr("int(_h % length(_run))")
    cut = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    words = hashed.select(F.when(F.col("_h") % damage == 0, cut).otherwise(F.col("_run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Trie:
    """Words in code-point order, with their n. Children of node i are the nodes first[i] to first[i + 1].

    A node that one word alone goes through is a leaf and keeps the rest of that word; ``n`` of a node is that of the
    word that ends there, at a leaf after its rest.
    """

    __slots__ = ("first", "labels", "n", "rest_at", "rests")

    def __init__(self, words: list[str], n: list[int]) -> None:
        labels, rests, self.first, self.n, self.rest_at = ["\0"], [], array("I"), array("q"), array("I", [0])
        todo, at, size = [(0, len(words), 0)], 0, 0
        while at < len(todo):
            low, high, depth = todo[at]
            at += 1
            self.first.append(len(todo))
            rest, here = "", 0
            if high - low == 1:
                rest, here, low = words[low][depth:], n[low], high
            elif low < high and len(words[low]) == depth:
                here, low = n[low], low + 1
            rests.append(rest)
            size += len(rest)
            self.rest_at.append(size)
            self.n.append(here)
            while low < high:
                label, end = words[low][depth], low + 1
                while end < high and words[end][depth] == label:
                    end += 1
                labels.append(label)
                todo.append((low, end, depth + 1))
                low = end
        self.first.append(len(todo))
        self.labels, self.rests = "".join(labels), "".join(rests)

    def parts(self) -> tuple:
        return tuple(getattr(self, name) for name in self.__slots__)

    @classmethod
    def of(cls, parts: tuple) -> Trie:
        trie = cls.__new__(cls)
        for name, part in zip(cls.__slots__, parts, strict=True):
            setattr(trie, name, part)
        return trie

    def _exact(self, node: int, word: str, i: int) -> int:
        """n of the word that goes on from node with word[i:], 0 if there is none."""
        first, find = self.first, self.labels.find
        while True:
            low, high = first[node], first[node + 1]
            if low == high:
                return self.n[node] if self.rests[self.rest_at[node] : self.rest_at[node + 1]] == word[i:] else 0
            if i == len(word):
                return self.n[node]
            node = find(word[i], low, high)
            if node < 0:
                return 0
            i += 1

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Each accepted word at distance one, once, with its n.

        Of the edits that give one string, a deletion is tried at the last of equal letters, an insertion where the new
        letter differs from the next.
        """
        first, labels, exact, node, size = self.first, self.labels, self._exact, 0, len(word)
        for i in range(size + 1):
            low, high = first[node], first[node + 1]
            if low == high:
                rest = self.rests[self.rest_at[node] : self.rest_at[node + 1]]
                if self.n[node] and one_edit(rest, word[i:]):
                    yield word[:i] + rest, self.n[node]
                return
            here = word[i] if i < size else ""
            if here and here != word[i + 1 : i + 2] and (n := exact(node, word, i + 1)):
                yield word[:i] + word[i + 1 :], n
            onward = -1
            for child in range(low, high):
                label = labels[child]
                if label == here:
                    onward = child
                    continue
                if here and (n := exact(child, word, i + 1)):
                    yield word[:i] + label + word[i + 1 :], n
                if n := exact(child, word, i):
                    yield word[:i] + label + word[i:], n
            if onward < 0:
                return
            node = onward


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def build_shards(words: DataFrame, count: int, size: int = SHARD) -> DataFrame:
    """n_words and the pickled trie of each shard of at most size words, by ranges of words. count: words there are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        held = ([], [])

        def shard(k: int) -> pd.DataFrame:
            trie = pickle.dumps(Trie(held[0][:k], held[1][:k]).parts())
            del held[0][:k], held[1][:k]
            return pd.DataFrame({"n_words": [k], "trie": [trie]})

        for batch in batches:
            held[0].extend(batch["word"])
            held[1].extend(map(int, batch["n"]))
            while len(held[0]) >= size:
                yield shard(size)
        if held[0]:
            yield shard(len(held[0]))

    return words.repartitionByRange(-(-count // size), "word").sortWithinPartitions("word").mapInPandas(work, "n_words int, trie binary")


def _search(shards) -> callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        tries = [Trie.of(pickle.loads(x)) for x in shards.value]
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                near, best = 0, None
                for trie in tries:
                    for other, m in trie.near(word):
                        near += 1
                        if best is None or (-m, other) < best:
                            best = (-m, other)
                out.append((word, n, near, best[1] if best else None, -best[0] if best else None))
            yield pd.DataFrame(out, columns=["word", "n", "n_near", "form", "form_n"]).astype({"form_n": "Int64"})

    return work


def neighbours(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """word, n, n_near and the near word of largest n with that n, for every word. words: word and n, settled."""
    spark, schema = words.sparkSession, "word string, n long, n_near long, form string, form_n long"
    count = words.count()
    if not count:
        return spark.createDataFrame([], schema)
    shards = settle(build_shards(words, count, shard).withColumn("id", F.monotonically_increasing_id()), "shards")
    blocks, filled = [[]], 0
    for row in shards.select("id", "n_words").orderBy("id").collect():
        if blocks[-1] and filled + row["n_words"] > block:
            blocks.append([])
            filled = 0
        blocks[-1].append(row["id"])
        filled += row["n_words"]
    dealt = words.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-count // shard)), "word")
    parts = []
    for low, high in ((b[0], b[-1]) for b in blocks):
        sent = spark.sparkContext.broadcast([bytes(r["trie"]) for r in shards.where(F.col("id").between(low, high)).select("trie").collect()])
        parts.append(settle(dealt.mapInPandas(_search(sent), schema), "near"))
        sent.destroy()
    discard(shards)
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))).alias("best")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "best.form", (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the form at the end of the chain. forms: word and form, without nulls and circles; n grows along it.

    Each round doubles how far a word has been followed, so 2 ** rounds steps are behind it.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        then = settle(now.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then
        if not now.where("moved").take(1):
            return now.select("word", "root")


def group_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, much: int = MUCH, damage: int = DAMAGE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least so many letters and occurrences."""
    words = settle(word_counts(docs, shortest, damage).where(F.col("n") >= least), "words")
    strong = F.col("form_n") >= much * F.col("n")
    near = settle(neighbours(words, shard, block).select("word", "n", "n_near", F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")), "near")
    last = roots(near.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return near.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
