import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import decontamination, quality_classifier, quality_rules

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.mark.parametrize("which", ["docs", "edge_docs"])
def test_statistics(request, which):
    df = request.getfixturevalue(which)
    got = sorted(tuple(r) for r in quality_rules.text_statistics(df.select("text"), "text").select(*STATS).collect())
    assert got == sorted(brute.statistics(r["text"]) for r in df.select("text").collect())


def test_rules_follow_labels(docs, labels):
    judged = {r["doc_id"]: r for r in quality_rules.judge(docs, labels, "doc_id").collect()}
    assert len(judged) == docs.count()
    known = [(judged[r["doc_id"]], r["quality"]) for r in labels.collect() if not judged[r["doc_id"]]["base_failed"]]
    assert sum(j["kept"] == bool(q) for j, q in known) >= 0.95 * len(known)
    assert all(j["kept"] for j, q in known if q == 1)


def test_rules_without_labels_or_rows(edge_docs, no_docs, labels):
    judged = quality_rules.judge(edge_docs, labels.where("false"), "doc_id").collect()
    assert len(judged) == edge_docs.count() and all(r["kept"] != r["base_failed"] for r in judged)
    assert quality_rules.keep_good(no_docs, labels).count() == 0
    kept = quality_rules.keep_good(edge_docs, labels.where("false"))
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} == {11, 12}


def test_decontamination(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r) for r in decontamination.judge(docs, items).select(*columns).collect()) == want
    in_blocks = decontamination.judge(docs, items, max_broadcast=400)
    assert sorted(tuple(r) for r in in_blocks.select(*columns).collect()) == want
    gone = {w[0] for w in want if w[-1]}
    assert {r["doc_id"] for r in decontamination.clean(docs, items).collect()} == {w[0] for w in want} - gone


def test_decontamination_of_edges(spark, edge_docs, no_docs):
    rows = [("1", "c D"), ("1", "c D"), ("2", "word " * 30), (None, "a b"), ("3", None), ("4", ".."), ("5", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), ("6", "F")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute.contamination([(r["doc_id"], r["text"]) for r in edge_docs.collect()], rows), key=key)
    judged = decontamination.judge(edge_docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in judged.collect()), key=key) == want
    assert decontamination.clean(edge_docs, items).columns == edge_docs.columns
    assert decontamination.judge(no_docs, items).count() == 0
    assert not decontamination.judge(edge_docs, items.where("false")).where("contaminated").count()


def test_decontamination_by_many_windows(spark, docs):
    rows = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(2012))) for k in range(100)] + [("own", docs.where("doc_id = 3").first()["text"])]
    items = spark.createDataFrame(rows, "item_id string, text string")
    near = docs.where("doc_id < 40").unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("so " + rows[5][1].upper() + " it is")}))
    want = sorted(brute.contamination([(r["doc_id"], r["text"]) for r in near.collect()], rows))
    assert decontamination.benchmark_windows(items).count() > 200_000
    for options in ({}, {"max_broadcast": 60_000}):
        judged = decontamination.judge(near, items, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(tuple(r) for r in judged.collect()) == want


def test_decontamination_cuts_spans(spark, edge_docs, no_docs):
    items = spark.createDataFrame([("a", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), ("b", "c d"), ("c", "W18")], "item_id string, text string")
    out = decontamination.cut(edge_docs, items)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count() and decontamination.cut(no_docs, items).count() == 0
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id IN (7, 11, 12)").collect()}
    left = " ".join(["w0", "w1", "w2", "w17", *(f"w{i}" for i in range(19, 120))])
    assert got == {7: "A B e F", 11: left, 12: "start " + left}
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontamination.find_hits(edge_docs, items).collect()}
    assert spans[11] == [(3, 17), (18, 19)] and spans[7] == [(2, 4)] and spans[3] == []


def test_classifier_on_held_out_rows(docs, labels, edge_docs, no_docs):
    model = quality_classifier.learn(docs, labels)
    scored = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    held = [(scored[r["doc_id"]], r["quality"]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert held and sum(s["predicted"] == q for s, q in held) >= 0.9 * len(held)
    edges = quality_classifier.score(edge_docs, model).collect()
    assert len(edges) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in edges)
    assert quality_classifier.score(no_docs, model).count() == 0
    blank = quality_classifier.learn(no_docs, labels)
    assert {r["score"] for r in quality_classifier.score(edge_docs, blank).collect()} == {0.5}


def plain_score(model, x):
    """Gated attention for one document, passage by passage."""
    codes, weights = [], []
    for row in x.astype(float):
        h = [math.tanh(sum((row[i] - model["mean"][i]) / model["scale"][i] * model["W"][i][j] for i in range(len(row))) + model["b"][j]) for j in range(len(model["b"]))]
        gate = lambda m: [sum(h[i] * m[i][j] for i in range(len(h))) for j in range(len(model["w"]))]
        e = sum(w * math.tanh(t) / (1 + math.exp(-u)) for w, t, u in zip(model["w"], gate(model["V"]), gate(model["U"]), strict=True))
        codes.append(h)
        weights.append(math.exp(e))
    z = [sum(a * h[j] for a, h in zip(weights, codes, strict=True)) / sum(weights) for j in range(len(model["b"]))]
    return 1 / (1 + math.exp(-sum(c * v for c, v in zip(model["c"], z, strict=True)) - model["d"][0]))


def test_attention_against_a_plain_version():
    rng, rnd = np.random.default_rng(1), random.Random(1)
    bags = [quality_classifier.describe(" ".join(rnd.choice(["ab", "Cd.", "1#", "é"]) for _ in range(n))) for n in (1, 49, 51, 160, 0)]
    model = quality_classifier.fit(bags, [0, 1, 1, 0, 1], epochs=3)
    cut = np.append(0, np.cumsum([len(b) for b in bags])[:-1]).astype(int)
    x, y = np.concatenate(bags).astype(float), np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    scores = quality_classifier.forward(model, x, cut)["score"]
    assert np.allclose(scores, [plain_score(model, b) for b in bags])
    loss = lambda m: -np.mean(y * np.log(s := quality_classifier.forward(m, x, cut)["score"]) + (1 - y) * np.log(1 - s))
    for name, grad in quality_classifier._gradients(model, x, cut, y).items():
        for at in rng.integers(0, grad.size, 5):
            step = np.zeros(grad.size)
            step[at] = 1e-5
            moved = [loss(model | {name: model[name] + sign * step.reshape(model[name].shape)}) for sign in (1, -1)]
            assert abs((moved[0] - moved[1]) / 2e-5 - grad.flat[at]) < 1e-6


def test_passages_counted_in_pieces():
    data = b"ab Cd 1# word. " * 400 + b"x" * 3000
    kind = quality_classifier._KIND[np.frombuffer(data, np.uint8)]
    first = np.array([0, 40, 41, 2000, 6500, len(data)])
    whole = quality_classifier._counted(kind, first)
    assert all(np.array_equal(a, b) for a, b in zip(whole, quality_classifier._counted(kind, first, 7), strict=True))
    for k, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        assert np.allclose(whole[0][k], np.bincount(kind[a:b], minlength=quality_classifier.N_KINDS) / (b - a))


def test_learning_takes_one_row_of_an_id(spark, docs, labels):
    one = labels.where("quality = 1 AND doc_id > 0").orderBy("doc_id").first()["doc_id"]
    many = docs.unionByName(docs.where(F.col("doc_id") == one).crossJoin(spark.range(500)).drop("id"))
    stats = [quality_rules.labelled_statistics(df, labels, 8_000).count() for df in (docs, many)]
    assert stats[0] == stats[1]


def test_first_rule_is_the_best_threshold(spark):
    """Brute force: no single threshold on a feature gains more than the first one grown."""
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        bad = rnd.random() < 0.4
        rows.append((i, 0 if bad else 1, *[rnd.gauss(2.0 if bad and k == 1 else 0.0, 1.0) for k in range(len(quality_rules.FEATURES))]))
    df = spark.createDataFrame(rows, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    rules = quality_rules.learn_rules(df, n_cuts=64, max_literals=1, min_precision=0.6)
    best = rules[0][0]
    assert best.feature == quality_rules.FEATURES[1] and best.above

    def gain(f, above, cut):
        grow = [r for r in df_rows if r["grow"]]
        p0, n0 = sum(r["quality"] == 0 for r in grow), sum(r["quality"] == 1 for r in grow)
        held = [r for r in grow if (r[f] > cut) == above]
        p, n = sum(r["quality"] == 0 for r in held), sum(r["quality"] == 1 for r in held)
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

    df_rows = df.withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) > 0).collect()
    most = max(gain(f, above, r[f]) for f in quality_rules.FEATURES for above in (False, True) for r in df_rows)
    assert gain(best.feature, best.above, best.cut) >= 0.9 * most
