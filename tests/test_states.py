import random

import pytest

from evidara.streaming import states
from evidara.streaming.turns import run_available

SCHEMA = "doc string, seq long, kind string, stage string, error string, fingerprint string"


def run(*events, most=2):
    document = states.Document()
    for seq, (kind, what) in enumerate(events):
        document.step(seq, kind, what if kind == "done" else None, what if kind == "failed" else None, what if kind == "start" else None, most)
    return document


DONE = ("done", None)


def test_stages_in_order():
    d = run(("start", "f"), *[DONE] * 5)
    assert (d.state, d.transitions, d.errors) == ("approved", 5, 0)
    d = run(("start", "f"), ("done", "parsed"), ("done", "preflighted"), ("done", "approved"))
    assert (d.state, d.illegal, d.transitions) == ("preflighted", 2, 1)


@pytest.mark.parametrize("error", states.TRANSIENT)
def test_transient_errors_are_tried_again(error):
    d = run(("start", "f"), ("failed", error), DONE, ("failed", error), DONE)
    assert (d.state, d.retries, d.errors, d.attempts) == ("parsed", 2, 2, 0)
    d = run(("start", "f"), ("failed", error), ("failed", error), DONE)
    assert (d.state, d.retries, d.ignored, d.transitions) == ("quarantined", 1, 1, 1)
    assert run(("start", "f"), ("failed", error), ("failed", error), most=3).retries == 2


def test_fatal_and_unexpected_errors():
    assert run(("start", "f"), DONE, ("failed", "schema_error")).state == "quarantined"
    d = run(("start", "f"), DONE, ("failed", "disk on fire"), DONE, ("start", "f"), DONE)
    assert (d.state, d.interrupted, d.ignored, d.errors) == ("parsed", False, 1, 1)


def test_resumption_by_fingerprint():
    over = [("start", "f"), *[DONE] * 5]
    assert run(*over, ("start", "f")).skipped == 1
    again = run(*over, ("start", "g"), DONE)
    assert (again.state, again.fingerprint, again.skipped, again.transitions) == ("preflighted", "g", 0, 1)


def made(seed, documents=12, n=600):
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choices(["start", "done", "failed"], [1, 6, 2])[0]
        out.append((f"d{min(rng.randrange(documents), rng.randrange(documents))}", seq, kind, rng.choice([None, None, *states.STATES[1:]]) if kind == "done" else None, rng.choice([*states.TRANSIENT, "schema_error", "odd"]) if kind == "failed" else None, rng.choice("fg") if kind == "start" else None))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch_equals_stream_and_a_plain_loop(spark, tmp_path):
    data = made(4)
    plain = {}
    for doc, seq, *rest in data:
        plain.setdefault(doc, states.Document()).step(seq, *rest)
    want = sorted((d, *states.astuple(s)) for d, s in plain.items())
    df = spark.createDataFrame([*data, *data[:50], (None, 1, "done", None, None, None), ("d0", None, "done", None, None, None)], SCHEMA).repartition(3)
    assert rows(states.fold(df)) == want
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(3):
        # Each delivery repeats some of the one before.
        part = data[max(k * 200 - 30, 0) : (k + 1) * 200]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = run_available(states.follow(stream), target, checkpoint)
    assert rows(states.latest(found)) == want


def test_summary_and_nothing(spark):
    df = states.fold(spark.createDataFrame(made(5), SCHEMA))
    found = {r["state"]: r for r in states.summary(df).collect()}
    assert found["all"]["n"] == df.count() == sum(r["n"] for s, r in found.items() if s != "all")
    empty = states.fold(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and [(r["n"], r["failed"]) for r in states.summary(empty).collect()] == [(0, 0.0)]
