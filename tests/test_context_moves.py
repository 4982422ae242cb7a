"""Members, tokens and the budget are found by lengths; contents are not written with them."""

import pytest
from test_context import FIVE, chunk, run

from evidara.operators import context


def test_no_content_is_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(context, "settle", lambda df, name, real=context.settle: written.append((name, df.columns)) or real(df, name))
    run(spark, "fact", [("c2", 0.9)], FIVE)
    assert {name for name, _ in written} >= {"hits", "modes", "units"} and not [x for x in written if "content" in x[1]]


@pytest.mark.parametrize("kind", ["fact", "policy"])
def test_two_chunks_at_one_place(spark, kind):
    chunks = [chunk("a", order=0), chunk("b", order=0, blocks=["x"]), chunk("c", order=1, blocks=["x"], content="一丁 ab"), chunk("far", order=9, content="z" * 9000)]
    (unit,), events = run(spark, kind, [("c", 0.9), ("a", 0.5)], chunks)
    assert unit["chunks"] == ["a", "c"] and unit["tokens"] == 7 and not events


def test_a_unit_that_is_dropped_is_checked_too(spark):
    chunks = [chunk("a", content="x" * 900), chunk("b", "s2", content="y" * 900, ref=None)]
    with pytest.raises(Exception, match="source_ref"):
        run(spark, "fact", [("a", 0.9), ("b", 0.1)], chunks, [("s1", None), ("s2", None)], 100)
