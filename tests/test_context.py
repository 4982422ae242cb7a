import hashlib
import json

import pytest

from evidara.operators import context

QUESTIONS = "query string, query_type string, budget long"
HITS = "query string, chunk string, score double, place int"
CHUNKS = "chunk string, doc string, section string, chunk_order long, blocks array<string>, source_ref string, content string"
SECTIONS = "section string, parent string, doc string, path array<string>"


def chunk(name, section="s1", order=0, content=None, blocks=None, ref="ref"):
    return (name, "doc-a", section, order, [f"b-{name}"] if blocks is None else blocks, ref and f"{ref}#{name}", f"content {name}" if content is None else content)


def run(spark, kind, hits, chunks, sections=(("s1", None),), budget=6000):
    asked = spark.createDataFrame([("q", kind, budget)], QUESTIONS)
    found = spark.createDataFrame([("q", c, float(s), i) for i, (c, s) in enumerate(hits)], HITS)
    tree = spark.createDataFrame([(s, p, "doc-a", ["Root", s]) for s, p in sections], SECTIONS)
    units, events = context.assemble(asked, found, spark.createDataFrame(chunks, CHUNKS), tree)
    return units.orderBy("place").collect(), events.collect()


FIVE = [chunk(f"c{i}", order=i) for i in range(5)]


def test_a_fact_takes_one_sibling_on_either_side(spark):
    (unit,), events = run(spark, "fact", [("c2", 0.9)], FIVE)
    assert unit["mode"] == "matched_chunk" and unit["chunks"] == ["c1", "c2", "c3"] and not events
    assert unit["content"] == "content c1\n\ncontent c2\n\ncontent c3"
    assert [unit["content"][m["from"] : m["to"]] for m in unit["members"]] == ["content c1", "content c2", "content c3"]
    assert [m["source_ref"] for m in unit["members"]] == ["ref#c1", "ref#c2", "ref#c3"] and unit["blocks"] == ["b-c1", "b-c2", "b-c3"]
    payload = json.dumps({"section_id": "s1", "included_chunk_ids": unit["chunks"]}, sort_keys=True, separators=(",", ":"))
    assert unit["context_id"] == "context_unit_" + hashlib.sha256(payload.encode()).hexdigest()[:16]
    members = [{"chunk_id": c, "source_ref": f"ref#{c}", "content_hash": hashlib.sha256(f"content {c}".encode()).hexdigest()} for c in unit["chunks"]]
    payload = json.dumps({"context_id": unit["context_id"], "members": members}, sort_keys=True, separators=(",", ":"))
    assert unit["group_id"] == "context_group_v1_" + hashlib.sha256(payload.encode()).hexdigest()


def test_two_hits_make_a_span_that_fills_the_gap(spark):
    (unit,), _ = run(spark, "procedure", [("c0", 0.9), ("c4", 0.8)], FIVE)
    assert unit["mode"] == "parent_span" and unit["chunks"] == [f"c{i}" for i in range(5)] and unit["score"] == 0.9


@pytest.mark.parametrize("deep", [1, 9])
def test_a_small_section_comes_whole_with_what_is_below(spark, deep):
    chunks = [chunk("a", "s1"), *[chunk(f"x{k}", f"t{k}") for k in range(deep)], chunk("other", "s9")]
    sections = [("s1", None), ("t0", "s1"), *[(f"t{k}", f"t{k - 1}") for k in range(1, deep)], ("s9", None)]
    (unit,), _ = run(spark, "policy", [("a", 0.9)], chunks, sections)
    assert unit["mode"] == "full_section" and unit["chunks"] == ["a", *[f"x{k}" for k in range(deep)]]
    large = [*chunks, chunk("big", "t0", 1, content="x" * 9100)]
    (unit,), _ = run(spark, "policy", [("a", 0.9)], large, sections)
    assert unit["mode"] == "matched_chunk" and unit["chunks"] == ["a"]


def test_equal_block_sets_give_way_before_the_budget(spark):
    chunks = [chunk("a", order=0, blocks=["x", "y"]), chunk("b", "s2", blocks=["y", "x"]), chunk("c", "s2", 1, content="long " * 300)]
    units, events = run(spark, "fact", [("a", 0.5), ("b", 0.9)], chunks, [("s1", None), ("s2", None)], 100)
    assert [u["section"] for u in units] == ["s2"]
    assert [tuple(e) for e in events] == [("q", "dedupe_by_block_set", "a", "b")]
    # One unit always stays, though it alone is over the budget.
    assert units[0]["tokens"] > 100


def test_units_are_dropped_from_the_lowest_score_up(spark):
    chunks = [chunk(f"c{i}", f"s{i}", content="x" * 300) for i in range(4)]
    units, events = run(spark, "fact", [(f"c{i}", 1 - i / 10) for i in range(4)], chunks, [(f"s{i}", None) for i in range(4)], 250)
    assert [u["section"] for u in units] == ["s0", "s1"] and sorted(e["removed"] for e in events) == ["s2", "s3"]


def test_within_a_window_a_hit_wins_over_its_copy(spark):
    chunks = [chunk("a", order=0, blocks=["x"]), chunk("b", order=1, blocks=["x"]), chunk("c", order=2, blocks=[]), chunk("d", order=3, blocks=None, content="  ")]
    (unit,), _ = run(spark, "policy", [("b", 0.9), ("none such", 1.0)], [*chunks, chunk("big", order=9, content="y" * 20_000)])
    assert unit["chunks"] == ["b", "c", "d"] and unit["content"].endswith("content c\n\n")


def test_errors(spark):
    with pytest.raises(Exception, match="source_ref"):
        run(spark, "fact", [("a", 1)], [chunk("a", ref=None)])
    with pytest.raises(Exception, match="out of range"):
        run(spark, "fact", [("a", 1)], [chunk("a")], budget=8001)
    with pytest.raises(Exception, match="out of range"):
        run(spark, "poem", [("a", 1)], [chunk("a")])
    with pytest.raises(ValueError, match="below itself"):
        run(spark, "policy", [("a", 1)], [chunk("a")], [("s1", "s2"), ("s2", "s1")])


def test_nothing(spark):
    assert run(spark, "fact", [("none such", 1.0)], FIVE) == ([], [])
