import pytest
from pyspark.sql import functions as F

from evidara.operators import fusion
from evidara.operators.fusion import RetrievalUnavailable

ITEMS = "query long, channel string, doc string, rank int"


def items(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], ITEMS)


def test_the_best_rank_of_a_channel_counts_once(spark):
    got = {r["doc"]: r for r in fusion.fuse(items(spark, ("lexical", "a", 3), ("lexical", "a", 1), ("vector", "a", 2), ("vector", "b", 1), ("vector", "c", 65), ("vector", None, 1))).collect()}
    assert set(got) == {"a", "b"} and got["a"]["channels"] == "lexical,vector"
    assert got["a"]["rrf"] == round(1 / 61 + 1 / 62, 8) and got["b"]["rrf"] == round(1 / 61, 8)


def test_what_fits_the_intent_is_raised(spark):
    fused = fusion.fuse(items(spark, ("lexical", "a", 1), ("lexical", "b", 2), ("lexical", "c", 3)))
    intents = spark.createDataFrame([(1, "data")], "query long, intent string")
    types = spark.createDataFrame([("a", "paper"), ("b", "tool_doc")], "doc string, source_type string")
    got = {r["doc"]: (r["boost"], r["score"] > 1 / 61) for r in fusion.with_intent(fused, intents, types).collect()}
    assert got == {"a": (0.0, False), "b": (0.02, True), "c": (0.0, False)}


def test_named_sources_first_and_two_of_a_source(spark):
    fused = fusion.fuse(items(spark, *[("lexical", f"d{i}", i + 1) for i in range(8)]))
    sources = spark.createDataFrame([(f"d{i}", "s1" if i < 4 else "ripe" if i < 6 else None) for i in range(8)], "doc string, source string")
    anchored = spark.createDataFrame([(1, "ripe", "ripe")], "query long, source string, matched_terms string")
    got = fusion.select(fused, sources, anchored).orderBy("rank").collect()
    assert [r["doc"] for r in got] == ["d4", "d0", "d6", "d7", "d5", "d1"] and got[0]["matched_terms"] == "ripe"
    assert [r["doc"] for r in fusion.select(fused, sources, anchored, limit=2).orderBy("rank").collect()] == ["d4", "d0"]
    for limit in (0, 21):
        with pytest.raises(ValueError, match="limit"):
            fusion.select(fused, sources, anchored, limit=limit)


def test_rerank_says_what_went_and_why(spark):
    rows = [("a", 0.9, "s1", "h1"), ("b", 0.8, "s1", "h1"), ("c", 0.7, "s2", "h1"), ("d", 0.6, "s1", "h2"), ("e", 0.5, "s1", "h3"), ("f", 0.4, None, None), ("g", 0.3, None, None)]
    pool = spark.createDataFrame([(1, *r) for r in rows], "query long, doc string, rrf double, source string, text_hash string")
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "d", 3.0), (1, "e", 2.0), (1, "f", 9.0)], "query long, doc string, model_score double")
    best, gone = fusion.rerank(pool, scores, 5)
    assert [r["doc"] for r in best.orderBy("rank").collect()] == ["f", "d", "e", "c", "g"]
    assert sorted((r["doc"], r["kept"], r["rule"][:5]) for r in gone.collect()) == [("a", None, "per_d"), ("b", "a", "exact")]
    with pytest.raises(ValueError, match="top_n"):
        fusion.rerank(pool, scores, 4)


def test_channels_that_fail(spark):
    states = lambda *rows: spark.createDataFrame(rows, "query long, channel string, error string, disabled boolean")
    found = items(spark, ("lexical", "a", 1))
    got = fusion.channel_status(states((1, "lexical", None, None), (1, "vector", "timeout", False), (2, "lexical", None, False), (2, "vector", "x", True)), found)
    assert sorted((r["query"], r["channel"], r["status"], r["degraded"]) for r in got.collect()) == [(1, "lexical", "complete", True), (1, "vector", "failed", True), (2, "lexical", "empty", False), (2, "vector", "disabled", False)]
    with pytest.raises(RetrievalUnavailable, match="for 1"):
        fusion.channel_status(states((1, "lexical", "down", False), (1, "vector", None, True)), found)
    assert fusion.fuse(found.where(F.lit(False))).count() == 0


def test_strategies_over_documents_against_a_plain_count(spark, sf_dir):
    """The exact strategy by hand: words in order, of neighbours and of changed copies."""
    from evidara.operators import dedup

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", "n_chars").collect()
    words = lambda t: __import__("re").findall("[a-z0-9]+", t.lower())
    groups = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups.setdefault((r["source"], r["n_chars"] // 100), []).append(r)
    pairs = [(a["text"], b["text"], a["text"] == b["text"]) for g in groups.values() for a, b in zip(g, g[1:], strict=False)]
    for r in rows:
        changed = " ".join(f"other{i % 7}" if (i + r["doc_id"]) % 20 == 0 else w for i, w in enumerate(r["text"].split(" ")))
        pairs.append((r["text"], changed, True))
    got = {r["strategy"]: r for r in dedup.dedup_strategy_report(spark, sf_dir).collect()}
    equal = [words(a) == words(b) for a, b, _ in pairs]
    assert {r["pairs"] for r in got.values()} == {len(pairs)} and set(got) == {"exact", "shingles", "minhash", "simhash"}
    assert got["exact"]["missed"] == sum(s and not e for (_, _, s), e in zip(pairs, equal, strict=True))
    assert got["exact"]["false_collapses"] == sum(e and not s for (_, _, s), e in zip(pairs, equal, strict=True))


def test_nearest_takes_few_documents_of_one_value(spark, monkeypatch):
    """One length with most documents, repeated ids, null keys: as the window over all pairs has it; few rows are joined."""
    rows = [(i, "a", 100) for i in range(300)] + [(1000 + i, "a", 90 + i % 21) for i in range(60)] + [(2000 + i, "b", i) for i in range(40)] + [(50, "a", 100), (1010, "a", 95), (3000, None, 100), (None, "a", 100), (3001, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long").repartition(3)
    asked = docs.where("doc_id % 50 = 0 OR doc_id = 2007")
    got = fusion.nearest(asked, docs, [F.col("source")], F.col("n_chars"), 8)
    known = [r for r in rows if None not in r]
    want = set()
    for q in {r[0] for r in known if r[0] % 50 == 0 or r[0] == 2007}:
        found = sorted((abs(m - v), i) for j, s, v in known if j == q for i, o, m in known if o == s and i != q)
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(found[:8])}
    assert {tuple(r) for r in got.collect()} == want
    # Of 300 documents of one length nine may meet a question.
    made = {}
    monkeypatch.setattr(fusion, "settle", lambda df, name: made.setdefault(name, df.localCheckpoint()))
    fusion.nearest(docs.where("doc_id < 300 AND n_chars = 100"), docs, [F.col("source")], F.col("n_chars"), 8)
    assert made["firsts"].where("_k0 = 'a' AND _m = 100").select("doc_id").distinct().count() == 9
    assert made["nearest"].count() <= 9 + 1
