"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learnt first: words and their beginnings of four to six letters, as they stand and with obfuscation undone,
by the log-odds of labelled documents that hold them. Each word of a text then has a level of that lexicon. The features
are densities of these levels, how many such words stand near a second person, the densest stretch, and rates of
capitals, punctuation, symbols and obfuscated words. Boosted trees learn on these, with each document's own evidence taken
out of the lexicon; an isotonic regression on rows that the trees have not seen makes shares of their margins. Scoring is
one pass over whole texts without a shuffle.

Null, empty and blank texts have features of zero and get the score of these. Identical texts score alike. Labels that
are null, not 0 or 1, held out or without a document are not learned from; of a doc_id that is there many times one row
is. Without labels of both kinds every score is the share of label 1, or 0.5. doc_id only decides what is held out;
source, lang and other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .quality_classifier import FOLDS, held_out

CUT = 0.5
#: Bounds of what is learned from: labelled documents, and entries of the lexicon with the documents an entry needs.
MAX_DOCS, MAX_TERMS, LEAST_DOCS = 12_000, 20_000, 3
#: Characters of a piece of text; a run without blanks that is longer than LONGEST is no word.
PIECE, LONGEST = 1 << 20, 64
LEVELS = np.array([0.7, 1.4, 2.1, 2.8, 3.5, 4.2, 5.0])
STRONG, SECOND, ODD, SHOUT = 4, 8, 16, 32
#: Words that speak to someone, in the languages of the corpus.
TO_SOMEONE = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su tuyo".split())
#: What stands for a letter in disguise.
DISGUISE = str.maketrans("01345789@$!€|", "oieastbgasiel")
MARKS = string.punctuation
_BLANK = re.compile(r"\s")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .*_-]){2,}[^\W_](?!\S)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_REPEATED = re.compile(r"(.)\1{2,}")


def plain(word: str) -> tuple[str, bool]:
    """A word in lower case without marks at its ends, disguise undone, and whether there was any."""
    low = word.lower().strip(MARKS)
    if low.isalpha() and not _REPEATED.search(low):
        return low, False
    low = _EDGES.sub("", low)
    if not any(c.isalpha() for c in low):
        # Digits and marks alone are not a disguise.
        return low, False
    seen = low.translate(DISGUISE)
    open_ = _REPEATED.sub(r"\1", _INNER.sub("", seen))
    # One apostrophe or hyphen inside is spelling.
    return open_, open_.isalpha() and (seen != low or bool(_REPEATED.search(seen)) or len(_INNER.findall(seen)) > 1)


def beginnings(low: str) -> list[str]:
    """What the lexicon may know a plain word by: itself, and its beginnings with a star."""
    return [low, *(f"{low[:k]}*" for k in (4, 5, 6) if len(low) > k)] if len(low) > 1 else []


def keys(word: str) -> list[str]:
    return beginnings(plain(word)[0]) if len(word) <= LONGEST else []


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in runs of about so many characters, cut before blanks."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


@dataclass(frozen=True)
class Lexicon:
    """Documents of each label, and for each key how many of label 1 and of label 0 hold it."""

    toxic: int
    clean: int
    held: dict[str, tuple[int, int]]

    def levels(self) -> dict[str, int]:
        """The level of each key, of texts that the lexicon was not learnt from."""
        odds = lambda a, b: math.log((a + 0.1) / (self.toxic + 1)) - math.log((b + 0.5) / (self.clean + 1))
        return {key: int(np.searchsorted(LEVELS, odds(a, b), "right")) for key, (a, b) in self.held.items() if a > 0}

    def weight(self, word: str, label: int | None = None) -> float:
        """The largest log-odds of a word's keys, 0 at least; label: of the document it stands in, which then does not
        count."""
        best = 0.0
        for key in keys(word):
            if key in self.held:
                a, b = self.held[key]
                a, b, n1, n0 = a - (label == 1), max(b - (label == 0), 0), self.toxic - (label == 1), self.clean - (label == 0)
                if a > 0:
                    best = max(best, math.log((a + 0.1) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)))
        return best


class Codes(dict):
    """The code of a word, kept while it lasts: its level, and flags for second person, obfuscation and capitals."""

    def __init__(self, lexicon: Lexicon, label: int | None = None) -> None:
        super().__init__()
        self.lexicon, self.label = lexicon, label
        self.levels = lexicon.levels() if label is None else {}

    def level(self, low: str, word: str) -> int:
        if self.label is not None:
            return int(np.searchsorted(LEVELS, self.lexicon.weight(word, self.label), "right"))
        of = self.levels.get
        return max(of(low, 0), of(low[:4] + "*", 0), of(low[:5] + "*", 0), of(low[:6] + "*", 0)) if len(low) > 6 else max((of(k, 0) for k in beginnings(low)), default=0)

    def __missing__(self, word: str) -> int:
        low, odd = plain(word) if len(word) <= LONGEST else ("", False)
        code = self.level(low, word) | SECOND * (low in TO_SOMEONE) | ODD * odd | SHOUT * (len(low) > 2 and word.isupper())
        if len(self) > 400_000:
            self.clear()
        self[word] = code
        return code


_ASCII = {name: np.isin(np.arange(256), list(marks.encode())) for name, marks in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "!": "!", "?": "?", "mark": ".,;:'\"()-", "symbol": "#*$%&@^~|<>"}.items()}
N_FEATURES = 2 * len(LEVELS) + len(_ASCII) + 13


def features(text: str | None, codes: Codes) -> list[float]:
    """The dense features of a whole text, which is read piece by piece; kept are one byte a word and counts."""
    found, size, spaced, runs, counts, hidden = [], 0, 0, 0, dict.fromkeys(_ASCII, 0), 0
    for piece in pieces(text or ""):
        words = piece.split()
        found.append(np.fromiter(map(codes.__getitem__, words), np.uint8, len(words)))
        data = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
        size += len(data)
        held = np.bincount(data, minlength=256)
        for name, is_it in _ASCII.items():
            counts[name] += int(held[is_it].sum())
        runs += piece.count("!!") + piece.count("??")
        for m in _SPACED.finditer(piece):
            spaced += 1
            hidden = max(hidden, codes[_INNER.sub("", m[0])] & 7)
    code = np.concatenate(found) if found else np.empty(0, np.uint8)
    n = len(code)
    if not n:
        return [0.0] * N_FEATURES
    level = code & 7
    at_least = len(code) - np.cumsum(np.bincount(level, minlength=8))[: len(LEVELS)]
    strong, second = (level >= STRONG).astype(np.int32), ((code & SECOND) > 0).astype(np.int32)
    hits = int(strong.sum())
    # Words to someone within five words of each hit, and the most hits in twenty words that follow each other.
    around = lambda x, back, on: (c := np.append(0, np.cumsum(x)))[np.minimum(np.arange(n) + on + 1, n)] - c[np.maximum(np.arange(n) - back, 0)]
    near = int(((around(second, 5, 5) > 0) & (strong > 0)).sum())
    out = [*(at_least / n), *np.log1p(at_least)]
    out += [counts[name] / size for name in _ASCII]
    out += [int(level.max()), hits and near / hits, math.log1p(near), second.mean(), int(around(strong, 0, 19).max()), ((code & ODD) > 0).mean(), ((code & SHOUT) > 0).mean(), runs / n, math.log1p(spaced), hidden, math.log1p(n), size / n, float(np.mean(level))]
    return [float(x) for x in out]


def _distinct_keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([list({k for piece in pieces(t or "") for w in set(piece.split()) for k in keys(w)}) for t in batch], dtype=object)


_distinct_keys.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}


def learn_lexicon(rows: DataFrame, max_terms: int = MAX_TERMS, least: int = LEAST_DOCS) -> Lexicon:
    """The entries of largest log-odds in labelled texts. rows: text, toxic; counted by Spark, max_terms come to the driver."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held = rows.select("toxic", F.explode(F.pandas_udf(_distinct_keys, "array<string>")("text")).alias("key")).groupBy("key").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.1) / (n.get(1, 0) + 1)) - F.log((F.col("b") + 0.5) / (n.get(0, 0) + 1))
    best = held.where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") >= float(LEVELS[0])).orderBy(F.desc("odds"), "key").limit(max_terms)
    return Lexicon(n.get(1, 0), n.get(0, 0), {r["key"]: (r["a"], r["b"]) for r in best.collect()})


@dataclass(frozen=True)
class Model:
    share: float
    lexicon: Lexicon | None = None
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None


def _featured(rows: DataFrame, lexicon: Lexicon, labelled: bool) -> DataFrame:
    """rows with a vector "_features"; of labelled rows, without the document's own evidence."""

    def work(batches):
        codes = {label: Codes(lexicon, label) for label in (None, 0, 1)}
        for batch in batches:
            text, labels = batch if labelled else (batch, [None] * len(batch))
            yield pd.Series([features(t, codes[y]) for t, y in zip(text, labels, strict=True)], dtype=object)

    columns = ["text", "toxic"] if labelled else ["text"]
    work.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]] if labelled else Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("_features", array_to_vector(F.pandas_udf(work, "array<double>")(*columns)))


def _margin(model: Model, featured: DataFrame) -> DataFrame:
    judged = model.trees.transform(featured)
    return judged.withColumn("_margin", vector_to_array("rawPrediction")[1])


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, rounds: int = 40, depth: int = 4) -> Model:
    """A model from about max_docs labelled rows that are not held out, picked by hash; a quarter of them calibrate."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    part = min(1.0, max_docs / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * part))
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = settle(one.withColumn("text", F.coalesce("text", F.lit(""))), "labelled")
    lexicon = learn_lexicon(rows)
    total = lexicon.toxic + lexicon.clean
    share = lexicon.toxic / total if total else 0.5
    if not lexicon.toxic or not lexicon.clean:
        return Model(share)
    # One fold of the labelled rows is held out already; the next is kept from the trees.
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 1
    known = settle(_featured(rows, lexicon, labelled=True).select(F.col("toxic").cast("double").alias("toxic"), apart.alias("apart"), vector_to_array("_features").alias("x")), "features")
    known = known.select("toxic", "apart", array_to_vector("x").alias("_features")).coalesce(2)
    trees = GBTClassifier(featuresCol="_features", labelCol="toxic", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.2, minInstancesPerNode=3, seed=11)
    grown = Model(share, lexicon, trees.fit(known.where("NOT apart")))
    if not known.where("apart").take(1):
        return grown
    steps = IsotonicRegression(featuresCol="_margin", labelCol="toxic", predictionCol="_share").fit(_margin(grown, known.where("apart")).select("toxic", "_margin"))
    return Model(share, lexicon, grown.trees, steps)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A thousandth of the score is the trees' own probability, so that rows on one step of the regression keep their order.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model.trees is None:
        scored = rows.select("doc_id", "held_out", F.lit(model.share).alias("score"))
    else:
        judged = _margin(model, _featured(rows, model.lexicon, labelled=False))
        own = vector_to_array("probability")[1]
        step = F.col("_share") if model.steps else own
        judged = model.steps.transform(judged) if model.steps else judged
        scored = judged.select("doc_id", "held_out", (step * 0.999 + own * 0.001).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
