import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.operators import chunking, dedup, governance, relational, retrieval
from evidara.operators.components import connected_components
from evidara.sources import tables as S
from evidara.streaming import turns


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_normal_forms(spark):
    assert one(spark, X.normal_form(F.col("t"), fold=True), t="Ｓtraße  x \r\n y") == "strasse x\ny"
    assert one(spark, X.normal_form(F.col("t"), "NFC", keep_lines=False), t="e\u0301  a\nb") == "\u00e9 a b"
    assert one(spark, X.normal_form(F.col("t")), t=None) is None


def test_clean_text(spark):
    assert one(spark, X.clean_text(F.col("t")), t="inter-\nnet  of AS 65000\nline\n\n\n\nnext") == "internet of AS65000 line\n\nnext"


def test_hashes_follow_their_definition(spark):
    row = spark.createDataFrame([(["a b c", "b c d"], [])], "s array<string>, e array<string>").select(X.minhash(F.col("s"), 3).alias("m"), X.minhash(F.col("e"), 2).alias("e")).first()
    assert row["m"] == [min(hashlib.sha256(f"{i}\0{x}".encode()).hexdigest()[:16] for x in ("a b c", "b c d")) for i in range(3)]
    assert row["e"] == ["0" * 16] * 2
    assert spark.createDataFrame([([],)], "w array<string>").select(X.simhash(F.col("w")).alias("h")).first()["h"] == -1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "y"}\n')
    assert S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n')
    assert S.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string").first()["t"] == "x\ny"
    (tmp_path / "d.json").write_text(json.dumps({"k": [1, 2]}))
    assert S.read_json_document(spark, str(tmp_path / "d.json")).first()["k"] == [1, 2]
    files = S.read_files(spark, str(tmp_path), "*.csv")
    assert files.first()["sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    assert S.content_addressed(files.union(files)).first()["n_paths"] == 2
    df = spark.range(10).withColumn("v", F.array("id", "id"))
    assert S.publish(df, str(tmp_path / "out"), "id")["rows"] == 10
    S.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("id = 3").first()["v"] == "3;3"


def test_sections(spark):
    text = "preamble\n1. First Part\nbody a\n\n1.1. Second Part\nbody b\n2. Empty Part\n"
    df = spark.createDataFrame([("d", text), ("e", "no heading here")], "id string, text string")
    rows = [(r["id"], r["section_id"], r["content"]) for r in S.read_sections(df).orderBy("id", "position").collect()]
    assert rows == [("d", "1.", "body a"), ("d", "1.1.", "body b"), ("e", "full", "no heading here")]
    yaml = "openapi: 3\ninfo:\n  title: Api\n  version: 2\npaths:\n  /a:\n"
    keys = [r["key"] for r in S.top_level_blocks(spark.createDataFrame([(yaml,)], "text string")).collect()]
    assert keys == ["info", "paths"]


def test_contracts(spark, sf_dir):
    with pytest.raises(ValueError):
        relational.list_query(spark.range(3), {}, [F.asc("id")], 0)
    with pytest.raises(ValueError):
        retrieval.bm25(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), ["a"], 65)
    with pytest.raises(ValueError):
        governance.eligibility_rules("other")
    loop = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a")], "src string, relation string, dst string")
    with pytest.raises(Exception, match="cycle"):
        relational.subtree(loop, "a").collect()


def test_lineage_kinds(spark):
    old = spark.createDataFrame([("o1", 1), ("o2", 2), ("o3", 3), ("o4", 4), ("o4", 5), ("o5", 9)], "chunk string, block int")
    new = spark.createDataFrame([("n1", 1), ("n2", 2), ("n2", 3), ("n3", 4), ("n4", 5)], "chunk string, block int")
    assert dict(dedup.lineage(old, new).collect()) == {"o1": "equivalent", "o2": "merged", "o3": "merged", "o4": "split", "o5": "retired"}


@pytest.mark.parametrize("hot", [64, 2, 0])
def test_similar_pairs_match_brute_force(spark, sf_dir, hot, monkeypatch):
    monkeypatch.setattr(dedup, "HOT", hot)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.lit("one"))
    found = {(r["left_id"], r["right_id"]) for r in dedup.similar_pairs(docs).collect()}
    import re

    sets, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        w = re.findall("[a-z0-9]+", re.sub("[0-9]+", "0", r["text"].lower()))
        if w and tuple(w) not in first:
            first[tuple(w)] = r["doc_id"]
            sets[r["doc_id"]] = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert found == want


PLANTED = [
    (1, "Prefix 10 was seen 4 times.", "a"), (2, "Prefix 11 was seen 9 times.", "a"), (3, "prefix  11 WAS seen 9 times", "a"), (4, "times 9 seen was prefix 11", "a"), (5, "Prefix 10 was seen 4 times.", "a"),
    (6, "路由 在 中午 撤回", "a"), (7, "маршруты отозваны в полдень", "a"), (8, "!!!", "a"), (9, "???", "a"), (10, None, "a"), (None, "路由 在 中午 撤回!", "a"), (None, "null id alone here", None), (11, "Prefix 10 was seen 4 times.", "b"),
    (12, "the table lists all peers of the exchange point today and was last changed in spring by hand", "a"), (13, "the table lists all peers of the exchange point today and was last changed in spring by us", "a"), (14, "null id alone here", None),
]


def reference_tokens(text):
    import re
    import unicodedata

    return ["<number>" if w.isdigit() else w for w in re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").casefold())]


def test_simhash_pairs_match_brute_force(spark, sf_dir):
    def simhash(tokens):
        votes = [0] * 64
        for t in tokens:
            v = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            votes = [x + (1 if v >> i & 1 else -1) for i, x in enumerate(votes)]
        return sum(1 << i for i, x in enumerate(votes) if x >= 0)

    planted = spark.createDataFrame(PLANTED, "doc_id long, text string, source string")
    rows = planted.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "source").limit(300)).collect()
    found = dedup.simhash_classes(spark.createDataFrame(rows, planted.schema)).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [simhash(reference_tokens(r["text"])) for r in rows]
    key = lambda x: str(x)
    assert sorted(((r["right_id"], r["right_hash"]) for r in found if r["kind"] == "member"), key=key) == sorted(((r["doc_id"], signed(h)) for r, h in zip(rows, hashes, strict=True)), key=key)
    linked = {(r["left_hash"], r["right_hash"]): r["distance"] for r in found if r["kind"] == "pair"}
    every = sorted({signed(h) for h in hashes})
    assert linked == {(a, b): n for i, a in enumerate(every) for b in every[i + 1 :] if (n := ((a ^ b) % (1 << 64)).bit_count()) <= 3}
    of = {r["right_id"]: r["left_id"] for r in found if r["kind"] == "member" and r["right_id"]}
    assert of[1] == of[2] == of[3] == of[4] == 1 and of[6] != of[7] and of[8] == of[9] == of[10]


def test_near_classes_match_the_reference_rule(spark, sf_dir):
    import unicodedata

    planted = spark.createDataFrame(PLANTED, "doc_id long, text string, source string")
    rows = planted.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("one").alias("source")).limit(300)).collect()
    found = dedup.near_classes(spark.createDataFrame(rows, planted.schema)).collect()
    members = [r for r in found if r["kind"] == "member"]
    assert len(members) == len(rows)
    near = {(r["left_class"], r["right_class"]) for r in found if r["kind"] == "pair"}
    near |= {(b, a) for a, b in near}
    got = sorted(sorted([str(a["right_id"]), str(b["right_id"])]) for i, a in enumerate(members) for b in members[i + 1 :] if a["exact_hash"] != b["exact_hash"] and (a["left_class"] == b["left_class"] or (a["left_class"], b["left_class"]) in near))

    def shingles(text):
        w = reference_tokens(text)
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    exact = lambda t: t if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
    all_ = [(r["doc_id"], r["source"], exact(r["text"]), shingles(r["text"])) for r in rows]
    want = sorted(sorted([str(a[0]), str(b[0])]) for i, a in enumerate(all_) for b in all_[i + 1 :] if a[1] == b[1] and a[2] != b[2] and 5 * len(a[3] & b[3]) >= 4 * len(a[3] | b[3]))
    assert got == want and ["1", "2"] in want and ["8", "9"] in want and ["12", "13"] in want


def test_containment_finds_every_passage(spark):
    passages = ["one two\nthree four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue", "lone", "two words", "\tblank  runs inside\n\nof it ", "six plain words end right here", "absent from all of the texts", "a\u00a0b c"]
    texts = ["x one two\nthree four five six seven y", "see 'alpha beta gamma delta epsilon zeta, and so on", "(red green blue)", "alonely", "[two words]", "q\tblank  runs inside\n\nof it r", "q blank runs inside of it r", "six plain words end right here", "six plain words end right hereafter", "one two three four five six seven", "xa\u00a0b cd", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(passages), (99, None)], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if t is not None and p in t}
    assert {tuple(r) for r in dedup.containment(docs, items).collect()} == want and len({i for _, i in want}) == 8


def test_bm25_of_many_questions_is_bm25_of_each(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.createDataFrame([(0, " ".join(retrieval.QUERY_TERMS)), (1, "the of and"), (2, "zzzznothing"), (3, "")], "query_id long, text string")
    got = retrieval.bm25_many(docs, asked, 8).collect()
    assert {r["query_id"] for r in got} == {0, 1}
    for i, terms in ((0, retrieval.QUERY_TERMS), (1, ["the", "of", "and"])):
        found = [(r["doc_id"], round(r["score"], 5)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i]
        assert found == [(r["doc_id"], round(r["score"], 5)) for r in retrieval.bm25(docs, terms, 8).collect()]


def test_retrieval_eval_shows_ranks_and_misses(spark):
    texts = ["apple pear", "apple apple apple pear pear", "plum fig", "kiwi", *[f"filler number {i}" for i in range(20)], "xlime"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "apple pear pear"), (2, "plum fig"), (3, "lime"), (4, "pear p"), (5, "nowhere"), (6, "kiwi plum")], "item_id long, text string")
    r = retrieval.evaluate_retrieval(docs, items).first()
    # 2 is found first; 3 lies inside a word, which BM25 misses; 1 has its only document at some rank; 4 ranks pear by length.
    by = {(x["query_id"], x["doc_id"]): x["rank"] for x in retrieval.bm25_many(docs, items.withColumnRenamed("item_id", "query_id"), 8).collect()}
    ranks = [by.get(k) for k in ((1, 1), (2, 2), (3, 24), (4, 1))]
    assert ranks[1] == 1 and ranks[2] is None and ranks[3] is not None
    mrr = sum(1 / x for x in ranks if x) / 4
    assert (r["questions"], r["with_evidence"], r["answered"], r["recall_at_8"]) == (6, 4, 3, 0.75)
    assert r["mrr"] == round(mrr, 6) and r["mrr_all"] == round(mrr * 4 / 6, 6) and r["no_evidence_rejection_rate"] == 0.5


def test_chunks_respect_bounds(spark, sf_dir):
    rows = chunking.split_content(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.length("content").alias("n")).collect()
    assert rows and all(chunking.MIN_CHARS <= r["n"] <= chunking.MAX_CHARS for r in rows)


def test_order_accuracy_without_pairs(spark):
    import random

    rnd = random.Random(8)
    rows = [(g, rnd.randrange(40), rnd.randrange(9)) for g in (1, 2, None) for _ in range(60)] + [(5, 1, 1)]
    got = {r["g"]: (r["pairs"], r["right_order"]) for r in chunking.order_accuracy(spark.createDataFrame(rows, "g long, t long, f long"), "g", "t", ["f", "t"]).collect()}
    want = {}
    for g in (1, 2, None):
        x = [(t, (f, t)) for h, t, f in rows if h == g]
        pairs = [(a, b) for a in x for b in x if a[0] < b[0]]
        want[g] = (len(pairs), sum(a[1] < b[1] for a, b in pairs))
    assert got == want


def test_section_chunks_nest_and_cut(spark):
    long = " ".join(["word"] * 400) + " " + "x" * 2500
    rows = [(1, 0, "paragraph", None, "before"), (1, 1, "title", 1, "A"), (1, 2, "heading", 3, "B"), (1, 3, "paragraph", None, long), (1, 4, "heading", 2, " C "), (1, 5, "table", None, "t" * 3000), (1, 6, "picture", None, "p"), (1, 7, "heading", 2, "D"), (1, 8, "list_item", None, "  "), (1, 9, "odd", None, "?")]
    out = {(r["position"], r["part"]): r for r in chunking.hierarchy_chunks(spark.createDataFrame(rows, "doc_id long, position long, block_type string, level int, text string")).collect()}
    assert out[0, 0]["section_path"] == "" and out[3, 0]["section_path"] == "A > B" and out[5, 0]["section_path"] == "A > C" and len(out[5, 0]["content"]) == 3000
    parts = [out[3, k]["content"] for k in range(5)]
    assert "".join(parts).replace(" ", "") == long.replace(" ", "") and [len(p) for p in parts] == [1199, 799, 1200, 1200, 100]
    assert {r["position"]: r["reason"] for r in out.values() if r["reason"]} == {6: "asset_reference_only", 8: "empty_content", 9: "unknown_block_type"} and out[8, None]["section_path"] == "A > D"


def test_streams_match_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.union(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = turns.event_stream(spark, str(tmp_path / "in"))
    latest = turns.upsert_latest(stream, str(tmp_path / "state"), str(tmp_path / "cp1"))
    assert sorted(latest.collect()) == sorted(turns.latest_state(events).collect())
    again = turns.upsert_latest(turns.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp1"))  # nothing new
    assert sorted(again.collect()) == sorted(latest.collect())
    more = events.where("user_id = 1").limit(3).withColumn("event_id", F.col("event_id") + 10**9)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    again = turns.upsert_latest(turns.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp1"))
    assert sorted(again.collect()) == sorted(turns.latest_state(events.unionByName(more)).collect())
    events.union(events.limit(50)).repartition(1).write.parquet(str(tmp_path / "in2"))
    once = turns.run_available(turns.deduplicated_stream(turns.event_stream(spark, str(tmp_path / "in2"), 100)), str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert once.count() == events.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 80), (7, 7), (200, 201), (200, 201), (None, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 80, 90: 80, 80: 80, 200: 200, 201: 200}


def test_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", "below", f"n{i}") for i in range(40)], "src string, relation string, dst string")
    rows = relational.subtree(chain, "n0").collect()
    assert sorted(r["depth"] for r in rows) == list(range(41)) and max(r["path"].count(">") for r in rows) == 40
    with pytest.raises(Exception, match="cycle"):
        relational.subtree(chain.union(spark.createDataFrame([("n0", "below", "n3")], chain.schema)), "n0").collect()


def test_nearest_ranks(spark):
    import math
    import random

    rnd = random.Random(1)
    values = {"a": [rnd.random() for _ in range(1000)], "b": [rnd.choice([1.0, 2.0]) for _ in range(501)], "c": [7.0], None: [3.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"], r["n"]) for r in relational.nearest_ranks(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {g: (sorted(v)[math.ceil(len(v) * 0.5) - 1], sorted(v)[math.ceil(len(v) * 0.95) - 1], len(v)) for g, v in values.items()}


def test_observations_in_other_scripts_match_the_sql(spark, sf_dir, tmp_path):
    """Word ends, digits and white space beside letters, digits and spaces that are not ASCII."""
    from compare import connection, spark_rows, sql_rows

    from evidara.plans import catalog

    texts = ["\u00e9AS123 as\n77 AS\t8 aS 9 A\u017f44", "\u0661\u0662.1.2.3/8 1.2.3.4/24\u00fc", "\u00a0\u00a0see\u00a0\u2003AS5\u00a0 \x0b\x1c \u2028 end\x85", "\u4e2d\u65872024-01-02\u4e2d 3\u00a0March 2021 3\x0bMarch 2022 4\fMay\n2023", "10:30\u00a0UTC 11:30\nUTC\u00df BGP4MP|01/02/24\x0b10:00:01\u00e4", None, ""]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)], kinds).coalesce(1).write.parquet(f"{tmp_path}/odd")
    (tmp_path / "documents.parquet").write_bytes(next((tmp_path / "odd").glob("*.parquet")).read_bytes())
    con = connection(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("observations", "observations_by_source"):
        assert spark_rows(catalog.queries()[name](spark, str(tmp_path))) == sql_rows(con, catalog.oracle_sql()[name]), name


def test_bm25_in_small_blocks_is_bm25_at_once(spark, sf_dir, monkeypatch):
    """Blocks of rows, questions and postings that cut everywhere, some without a hit; ties by id, ids that are words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("d%05d", "doc_id").alias("doc_id"), "text").limit(120)
    docs = docs.unionByName(docs.select(F.concat("doc_id", F.lit("b")).alias("doc_id"), "text")).coalesce(1)
    asked = docs.where("doc_id LIKE '%7'").select(F.col("doc_id").alias("query_id"), "text").unionByName(spark.createDataFrame([("x", "zzzznothing"), ("y", "the of zzzznothing")], "query_id string, text string"))
    known = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in retrieval.bm25_many(docs, asked, 6).collect())
    whole = known()
    assert len({r[0] for r in whole}) > 5
    for name, value in (("TEXT_QUESTIONS", 4), ("QUESTION_BLOCK", 3), ("ROW_BLOCK", 8), ("POSTINGS", 50), ("CACHED", 7)):
        monkeypatch.setattr(retrieval, name, value)
    assert known() == whole


def test_bm25_weighs_a_posting_once_for_all_questions():
    """Rows of postings times weights, of rows without postings and of many; and runs of no values."""
    rng = retrieval.np.random.default_rng(1)
    starts, col, share, weight = retrieval.np.array([0, 0, 3, 1500, 1500]), rng.integers(0, 40, 1500), rng.random(1500), rng.random((40, 5))
    dense = retrieval.np.zeros((4, 40))
    for i in range(4):
        retrieval.np.add.at(dense[i], col[starts[i] : starts[i + 1]], share[starts[i] : starts[i + 1]])
    assert retrieval.np.allclose(retrieval._sparse_times(starts, col, share, weight), dense @ weight)
    assert [list(x) for x in retrieval._runs_of(retrieval.np.array([], int))] == [[], [], []]
    assert [list(x) for x in retrieval._runs_of(retrieval.np.array([2, 2, 5]))] == [[2, 5], [0, 2], [2, 3]]


def test_near_duplicates_are_compared_whole_only_if_they_may_be_alike(spark, monkeypatch):
    """Sets that share a first shingle but little else go no further than their sketches; none that is alike is lost."""
    made, settle = {}, dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda df, name: made.setdefault(name, settle(df, name)) if name in ("likely", "pairs") else settle(df, name))
    monkeypatch.setattr(dedup, "discard", lambda *_: None)
    sets = [(1, [f"a{i}" for i in range(100)]), (2, [f"a{i}" for i in range(95)] + ["x"]), *[(10 + j, [f"a{i}" for i in range(30)] + [f"b{j} {i}" for i in range(70)]) for j in range(20)]]
    found = dedup.alike(spark.createDataFrame([("s", i, s) for i, s in sets], "source string, doc_id long, s array<string>"), (4, 5)).collect()
    assert [(r["u"], r["v"], r["similarity"]) for r in found] == [(1, 2, round(95 / 101, 6))]
    assert made["likely"].count() == 1 < made["pairs"].count()
