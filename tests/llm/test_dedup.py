import random

import brute
import pytest
from pyspark.sql import functions as F

from evidara.llm import near_duplicates, substring_dedup
from evidara.llm.shingles import window_hashes, word_hashes


def key(row):
    return tuple((x is not None, x) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_word_hashes_follow_words():
    for data in (b"", b" ", b"a", b" a b  c\n", b"abc abc\x0babd", b"x" * 3_000_000, b"ab " * 900_000):
        h, w = word_hashes(data), data.split()
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    h = word_hashes(b"a b c a b c d")
    for k in range(1, 9):
        got = window_hashes(h, k)
        assert len(got) == max(0, 7 - k + 1) and len(set(got.tolist())) == len({tuple(h[i : i + k]) for i in range(max(0, 7 - k + 1))})


def test_near_duplicates_of_edges(edge_docs):
    assert rows(near_duplicates.find_components(edge_docs)) == sorted(brute.components(pairs(edge_docs)), key=key)


def test_near_duplicates_keep_chains_and_bound(spark):
    base = [f"t{i}" for i in range(40)]
    chain = [(k, " ".join(base[:k * 2] + [f"z{k}"] + base[k * 2 + 1:])) for k in range(12)] + [(50, " ".join(base[:30])), (51, " ".join(f"q{i}" for i in range(40)))]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows(near_duplicates.find_components(df)) == sorted(brute.components(chain), key=key)
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(df).collect()} == {i for i, _, _, kept in brute.components(chain) if kept}


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates.find_components(no_docs).count() == 0
    assert near_duplicates.drop_near_duplicates(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("which", ["docs", "edge_docs"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    assert rows(substring_dedup.judge(df)) == sorted(brute.repeats(pairs(df)), key=key)


def test_substring_dedup_cuts_texts(edge_docs, no_docs):
    out = substring_dedup.remove_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    want = {i: d for i, _, _, d in brute.repeats(pairs(edge_docs)) if i is not None and i > 8}
    assert {r["doc_id"]: brute.sha(" ".join(brute.BLANK.findall(r["text"]))) for r in out.where("doc_id > 8").collect()} == want
    assert substring_dedup.judge(no_docs).count() == substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_dedup_boundaries(spark):
    w = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(w)), (2, " ".join(["a"] * 30 + w[20:69] + ["b"])), (3, " ".join(["c"] + w[20:70] + ["d"] * 60)), (4, " ".join(w[100:160] + ["e"] + w[20:75])), (5, " ".join(["d"] * 60))]
    assert rows(substring_dedup.judge(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted(brute.repeats(texts), key=key)


def test_substring_dedup_of_long_shared_passages(spark):
    rnd = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((60, 400, 49, 50, 51, 2000))] + [["again"] * 300]
    texts = []
    for i in range(40):
        w = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(passages)
            a = rnd.choice([0, 0, 0, rnd.randrange(len(p))])
            w += p[a : rnd.choice([len(p), len(p), rnd.randint(a, len(p))])] + [f"own{i}_{rnd.random()}" for _ in range(rnd.choice([0, 3, 70]))]
        texts.append((i // 2 if i % 7 == 0 else i, " ".join(w)))
    texts += texts[:6]
    assert rows(substring_dedup.judge(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted(brute.repeats(texts), key=key)


def test_chains_of_fragments_compact(spark):
    arcs = spark.createDataFrame([(i, i - 1) for i in range(1, 70)] + [(200, 100)], "node long, up long")
    assert {r["node"]: r["up"] for r in substring_dedup._compacted(arcs).collect()} == {i: 0 for i in range(1, 70)} | {200: 100}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(60):  # one bucket of many classes: all share long runs, few are alike
        w = list(base)
        for k in range(rnd.choice([1, 2, 3, 9, 12])):
            w[rnd.randrange(60)] = f"x{i}_{k}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(brute.components(texts), key=key)
    for block in (4, 1024):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        assert rows(near_duplicates.find_components(df)) == want
