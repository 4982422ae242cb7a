import pytest

from evidara.operators import rules
from evidara.operators.rules import Rule, allowed, check, covers, holds, refers, report, required, share, unique


@pytest.fixture(scope="module")
def data(spark):
    docs = spark.createDataFrame([("a", "en", 3, ["s1", "s9"]), ("b", None, 0, ["s1", None]), ("b", "xx", 5, []), (None, " ", None, None)], "id string, lang string, n int, refs array<string>")
    sources = spark.createDataFrame([("s1",), ("s2",), (None,)], "sid string")
    return {"docs": (docs, "id"), "sources": (sources, "sid")}


def found(data, *given):
    return sorted((tuple(r)[2:] for r in check(data, list(given)).collect()), key=str)


def test_each_kind(data):
    assert found(data, required("docs", "lang")) == sorted([("b", None, 1), (None, None, 1)], key=str)
    assert found(data, holds("docs", "n >= 3")) == sorted([("b", None, 1), (None, None, 1)], key=str)
    assert found(data, unique("docs", "id")) == [("b", None, 2)]
    assert found(data, refers("docs", "refs", "sources.sid")) == [("a", "s9", 1)]
    assert found(data, covers("docs.id", "sources.sid")) == [("s1", "s1", 1), ("s2", "s2", 1)]
    assert found(data, share("docs", "n > 2", 0.75)) == [(None, "0.5", 2)] and found(data, share("docs", "n > 2", 0.5)) == []


def test_values_and_nulls(data):
    bad = check(data, [allowed("docs", "lang", "en")]).collect()
    assert sorted(((r["record"], r["detail"]) for r in bad), key=str) == sorted([("b", None), ("b", "xx"), (None, " ")], key=str)
    assert {r["record"] for r in check(data, [holds("docs", "n >= 0")]).collect()} == {None}


def test_report_names_every_rule(data):
    given = [unique("docs", "id"), unique("sources", "sid"), required("docs", "lang")]
    got = {r["rule"]: (r["passed"], r["n"], r["samples"]) for r in report(check(data, given), given).collect()}
    assert got == {"docs has one row for id": (False, 2, "b"), "sources has one row for sid": (True, 0, ""), "docs.lang is there": (False, 2, "b")}


def test_each_dataset_is_read_once(spark, data):
    plan = rules.facts(data, [unique("docs", "id"), refers("docs", "refs", "sources.sid"), holds("docs", "n > 1"), required("docs", "lang")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_errors_and_nothing(spark, data):
    with pytest.raises(ValueError, match="no such dataset: none"):
        check(data, [unique("none", "x")])
    with pytest.raises(ValueError, match="no such dataset: other"):
        check(data, [Rule("r", "docs", "refers", "id", target="other.id")])
    empty = {k: (df.where("false"), r) for k, (df, r) in data.items()}
    assert check(empty, [unique("docs", "id"), share("docs", "n > 2", 0.9), refers("docs", "refs", "sources.sid")]).count() == 0


def test_there_are_enough_rules():
    assert len(rules.RULES) >= 45 and len({r.name for r in rules.RULES}) == len(rules.RULES)
