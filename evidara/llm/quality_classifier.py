"""Quality by attention over passages (multiple-instance learning).

Every run of 50 words of a text is a passage, described by what its bytes and words are like and encoded by a small
layer. Gated attention weighs a document's passages, the weighted sum of their codes is scored, and all layers learn
together from the labels of whole documents, by Adam on a bounded sample of rows that are not held out. Scoring reads
every passage of every text in one pass without a shuffle.

A null, empty or blank text has one passage of zeros and gets the score of that. Identical texts score alike. Labels
that are null, not 0 or 1, held out or without a document are not learned from; without any label of either kind every
score is the share of label 1, or 0.5. doc_id only decides what is held out; source, lang and other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _hash_piece, mix, window_hashes

PASSAGE, FOLDS, CUT = 50, 5, 0.3
#: Bounds of what is learned from: documents, and passages of each, evenly spaced.
MAX_DOCS, MAX_PASSAGES = 4_000, 64
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r\x0b\x0c", ".,;:", "!?", "'\"()[]{}", "#", "*", "$", "%&", "|", "<>", "-_/\\=+~^@`"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _kind in enumerate(_KINDS):
    _KIND[list(_kind.encode())] = _i
N_KINDS = len(_KINDS) + 1
N_FEATURES = N_KINDS + N_KINDS * N_KINDS // 8 + 5


def describe(text: str | None) -> np.ndarray:
    """A row of features for each passage, one of zeros if there is none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    blank = (kind == 3) | (kind == 4)
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1)) if len(b) else np.empty(0, np.int64)
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    k = -(-n // PASSAGE)
    first = np.append(start[::PASSAGE], len(b))
    single, double = _counted(kind, first)
    words, of_word = _hash_piece(data) if len(data) < 1 << 20 else _long_hashes(data), np.arange(n) // PASSAGE
    held = np.bincount(of_word, minlength=k)
    mean = lambda x: np.bincount(of_word, weights=x, minlength=k) / held
    _, at = np.unique(mix(words + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(of_word[at], minlength=k) / held
    again = np.append(False, words[1:] == words[:-1])
    seen = np.zeros(n)
    if n > 2:
        windows = window_hashes(words, 3)
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        seen[: len(windows)] = count[back] > 1
    length = (end - start).astype(float)
    more = np.stack([np.minimum(mean(length), 50) / 10, distinct, mean(again), mean(seen), np.log1p(held) / 5], axis=1)
    return np.concatenate([single, np.minimum(double, 1), more], axis=1).astype(np.float32)


def _counted(kind: np.ndarray, first: np.ndarray, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each kind of byte and of pairs of neighbours in each passage; first: where passages begin, and the end.

    Counted piece by piece, so that work arrays stay small for texts of any length.
    """
    k, width = len(first) - 1, N_KINDS * N_KINDS // 8
    single, double = np.zeros((k, N_KINDS), np.float32), np.zeros((k, width), np.float32)
    for low in range(first[0], first[-1], piece):
        high = min(low + piece, first[-1])
        of = np.searchsorted(first, np.arange(low, high), "right") - 1
        a, b = of[0], of[-1] + 1
        here = kind[low : high + 1].astype(np.int64)
        single[a:b] += np.bincount((of - a) * N_KINDS + here[: high - low], minlength=(b - a) * N_KINDS).reshape(b - a, N_KINDS)
        pair, of = (here[:-1] * N_KINDS + here[1:]) * 37 % width, of[: len(here) - 1]
        double[a:b] += np.bincount((of - a) * width + pair, minlength=(b - a) * width).reshape(b - a, width)
    size = np.diff(first).astype(np.float32)[:, None]
    return single / size, double / size


def _long_hashes(data: bytes) -> np.ndarray:
    from .shingles import word_hashes

    return word_hashes(data)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict[str, np.ndarray], x: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of documents. x: passages of all, one after another; cut: where each document begins."""
    h = np.tanh(((x - model["mean"]) / model["scale"]) @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(x))))
    a = np.exp(e - np.maximum.reduceat(e, cut)[of])
    a = a / np.add.reduceat(a, cut)[of]
    z = np.add.reduceat(a[:, None] * h, cut, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "of": of, "z": z, "score": _sigmoid(z @ model["c"] + model["d"][0])}


def _gradients(model: dict[str, np.ndarray], x: np.ndarray, cut: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(model, x, cut)
    h, t, g, a, of, z = (f[k] for k in ("h", "t", "g", "a", "of", "z"))
    out = (f["score"] - y) / len(y)
    dz = out[:, None] * model["c"]
    da = (dz[of] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, cut)[of])
    dt, dg = de[:, None] * model["w"] * g * (1 - t * t), de[:, None] * model["w"] * t * g * (1 - g)
    dh = a[:, None] * dz[of] + dt @ model["V"].T + dg @ model["U"].T
    dp = dh * (1 - h * h)
    return {"W": ((x - model["mean"]) / model["scale"]).T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (de[:, None] * t * g).sum(axis=0), "c": z.T @ out, "d": np.array([out.sum()])}


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 16, gates: int = 8, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 11) -> dict[str, np.ndarray]:
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))
    model = {"W": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gates)), "U": rng.normal(0, 0.3, (hidden, gates)), "w": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    fixed = {"mean": every.mean(axis=0).astype(float), "scale": np.maximum(every.std(axis=0), 0.01).astype(float)}
    share = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        model["c"][:], model["d"][0] = 0, np.log((share + 1e-6) / (1 - share + 1e-6))
        return model | fixed
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    sizes = np.array([len(b) for b in bags])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            cut = np.append(0, np.cumsum(sizes[pick])[:-1])
            step += 1
            for k, grad in _gradients(model | fixed, np.concatenate([bags[i] for i in pick]).astype(float), cut, y[pick]).items():
                grad = grad + decay * model[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * grad, 0.999 * m2[k] + 0.001 * grad * grad
                model[k] = model[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model | fixed


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _bags(max_passages: int) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = []
            for text in batch["text"]:
                x = describe(text)
                bags.append((x if len(x) <= max_passages else x[np.linspace(0, len(x) - 1, max_passages).astype(int)]).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bag": bags})

    return work


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> dict[str, np.ndarray]:
    """A model from about max_docs labelled rows that are not held out, picked by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    part = min(1.0, max_docs / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * part))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # One row of each id, however often it is there: the text of least hash.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInPandas(_bags(max_passages), f"doc_id {kind}, quality int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows], [r["quality"] for r in rows])


def _scorer(model: dict[str, np.ndarray]) -> Callable:
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 64):
                bags = [describe(t) for t in batch.iloc[at : at + 64]]
                cut = np.append(0, np.cumsum([len(b) for b in bags])[:-1]).astype(int)
                out.append(forward(model, np.concatenate(bags).astype(float), cut)["score"])
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return scores


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = docs.select("doc_id", held_out().alias("held_out"), F.pandas_udf(_scorer(model), "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
