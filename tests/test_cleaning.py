import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidara.operators import cleaning
from evidara.operators.cleaning import RULES, Rule, clean_text


def applied(text, edits):
    for e in reversed(edits):
        text = text[: e["start"]] + e["after"] + text[e["end"] :]
    return text


def normalised(text):
    text = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = [re.sub(r"[ \t]+", " ", line).strip(" ") for line in text.split("\n")]
    return "\n".join(x for x in lines if x)


def made(rng, n):
    return "".join(rng.choice(["a", "B", "b", "-\n", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "é", "é", "ﬁ", "…", "①", "　", "x", "1", "HEAD\n", "\nHEAD"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_edits_lead_from_source_to_result(seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = made(rng, rng.randint(0, 40))
        result, log, net = clean_text(text, RULES, {"HEAD", "B"})
        assert applied(text, net) == result
        # Rule by rule: what each says it found is there, and all of it in order gives the result.
        now, spans = text, []
        for name in dict.fromkeys(e["rule"] for e in log):
            own = [e for e in log if e["rule"] == name]
            assert all(now[e["start"] : e["end"]] == e["before"] for e in own)
            now = applied(now, own)
        assert now == result
        assert all(0 <= e["source_start"] <= e["source_end"] <= len(text) for e in log)
        assert all(a["end"] < b["start"] or a["end"] <= b["start"] for a, b in zip(net, net[1:], strict=False))
        # Every edit of a rule lies within one of the net edits, unless a later rule undid nothing of it.
        spans = [(e["start"], e["end"]) for e in net]
        assert all(any(a <= e["source_start"] and e["source_end"] <= b for a, b in spans) for e in log)


def test_source_spans_survive_later_rules():
    result, log, _ = clean_text("one\t\ttwo   ﬁn-\r\nish\r\n\r\n", RULES)
    assert result == "one two finish"
    by = {e["rule"]: e for e in log}
    assert (by["nfkc"]["source_start"], by["nfkc"]["source_end"], by["nfkc"]["before"], by["nfkc"]["after"]) == (10, 12, " ﬁ", " fi")
    hyphen = by["hyphens"]
    assert "one\t\ttwo   ﬁn-\r\nish"[hyphen["source_start"] : hyphen["source_end"]] == "-\r\n" and hyphen["before"] == "-\n"


def test_the_lossless_rules_are_the_normal_form():
    rng = random.Random(3)
    for _ in range(400):
        text = made(rng, rng.randint(0, 30)).replace("HEAD", "h")
        assert clean_text(text, RULES[:5])[0] == normalised(text)


def test_documents(spark):
    rows = [(i, "s", f"Page header\nbody {i}  text\nfooter {i}") for i in range(3)] + [(9, "t", "Page header\nother"), (10, None, "Page header"), (11, "s", None)]
    df = spark.createDataFrame(rows, "doc long, source string, text string").withColumn("log", F.lit(1))
    done = cleaning.clean(df)
    got = {r["doc"]: r["cleaned"] for r in done.collect()}
    assert got == {0: "body 0 text\nfooter 0", 1: "body 1 text\nfooter 1", 2: "body 2 text\nfooter 2", 9: "Page header\nother", 10: "Page header", 11: ""}
    audit = cleaning.audit(done).where("doc = 1").orderBy("seq").collect()
    assert [(e["rule"], e["before"], e["review_status"]) for e in audit] == [("spaces", "  ", "auto_approved"), ("repeated_lines", "Page header\n", "pending_review")]
    assert all(r["same"] for r in done.select((cleaning.apply_edits(F.col("text"), F.col("net")) == F.col("cleaned")).alias("same")).collect())
    assert cleaning.clean(df.where("false")).count() == 0


def test_semantic_rules_are_refused_and_unknown_levels_fail(spark):
    assert cleaning.refused(RULES) == [{"rule": "summarise", "review_status": "pending_review", "reason": "semantic_change_forbidden"}]
    with pytest.raises(ValueError, match="unknown rule level"):
        cleaning.clean(spark.createDataFrame([], "doc long, source string, text string"), (Rule("x", "magic"),))
