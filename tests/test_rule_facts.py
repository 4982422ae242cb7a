"""Facts of rules are counted by number and value, without sorting whole rows of text."""

from evidara.operators import rules
from evidara.operators.rules import check, refers, required, unique


def test_facts_are_hashed_and_the_least_record_is_found(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), (None, "z"), ("a", None)], "id string, ref string")
    data = {"docs": (docs, "id"), "known": (spark.createDataFrame([("y",)], "k string"), "k")}
    given = [unique("docs", "id"), refers("docs", "ref", "known.k"), required("docs", "ref")]
    plan = rules.facts(data, given)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = {(r["rule"], r["record"], r["detail"], r["n"]) for r in check(data, given).collect()}
    assert got == {("docs has one row for id", "a", None, 2), ("docs.ref is in known.k", "a", "x", 2), ("docs.ref is in known.k", None, "z", 1), ("docs.ref is there", "a", None, 1)}
