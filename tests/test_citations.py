import random

import pytest
from pyspark.sql import functions as F

from evidara.streaming import citations
from evidara.streaming.turns import run_available

SCHEMA = "message string, text string, allowed array<string>"
DELTAS = "message string, seq long, delta string, final boolean, allowed array<string>"
TEXTS = {
    "split": "前缀🙂[[cite:ev_1]]后缀",
    "unknown": "legal [[cite:ev_99]] and [[cite:ev_1",
    "plain": "no marker at all",
    "brackets": "a [b] [[c]] [[cite:ev_1, ev_2]][[cite:ev_2]]!",
    "no ids": "x [[cite: , ]] y",
    "nested": "a [[cite:a [[cite:ev_1]] b",
    "too long": "a [[cite:" + "x" * 200 + " b [[cite:ev_1]] [",
    "just fits": "a [[cite:" + " " * 148 + "ev_1]] b",
    "one too many": "a [[cite:" + " " * 149 + "ev_1]] b",
    "tail": "z [[ci",
    "empty": "",
}


def rows(df):
    return sorted((r["message"], r["part"] or 0, r["kind"], r["text"], tuple(r["citation_ids"] or ())) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark):
    return rows(citations.parse(spark.createDataFrame([(k, t, ["ev_1", "ev_2"]) for k, t in TEXTS.items()], SCHEMA)))


def test_known_cases(whole):
    of = lambda m: [r[2:] for r in whole if r[0] == m]
    assert of("split") == [("status", "complete", ()), ("text", "前缀🙂", ()), ("citation", None, ("ev_1",)), ("text", "后缀", ())]
    assert of("unknown") == [("status", "incomplete", ()), ("text", "legal  and ", ())]
    assert of("plain")[0] == ("status", "missing", ()) and of("empty") == [("status", "missing", ())]
    assert of("no ids") == [("status", "invalid", ()), ("text", "x  y", ())]
    assert of("nested") == [("status", "invalid", ()), ("text", "a  b", ())]
    assert of("too long")[0][1] == "incomplete" and of("too long")[1][1] == "a " + "x" * 200 + " b "
    assert of("just fits")[0][1] == "complete" and of("one too many")[0][1] == "invalid"


@pytest.mark.parametrize("seed", range(20))
def test_any_split_gives_the_pieces_of_the_whole(seed):
    rng = random.Random(seed)
    for text in TEXTS.values():
        held, pieces, at = "", [], 0
        while at < len(text):
            step = rng.choice([1, 2, 7, 40])
            found, held = citations.take(held + text[at : at + step], at + step >= len(text))
            assert len(held) <= citations.LONGEST
            pieces += found
            at += step
        joined, want = [], citations.take(text, True)[0]
        for p in pieces:
            if joined and not p.startswith(citations.PREFIX) and not joined[-1].startswith(citations.PREFIX):
                joined[-1] += p
            else:
                joined.append(p)
        again = []
        for p in want:
            if again and not p.startswith(citations.PREFIX) and not again[-1].startswith(citations.PREFIX):
                again[-1] += p
            else:
                again.append(p)
        assert joined == again


def _dealt(seed):
    """Deltas of one to nine characters, shuffled in a window, some sent twice."""
    rng, out = random.Random(seed), []
    for key, text in TEXTS.items():
        at, seq = 0, 0
        while at < len(text) or not seq:
            step = rng.randint(1, 9)
            out.append((key, seq, text[at : at + step], at + step >= len(text), ["ev_1", "ev_2"]))
            at, seq = at + step, seq + 1
    out = [x for x in out for _ in range(rng.choice([1, 1, 2]))]
    return [x for _, x in sorted((i + rng.randint(0, 12), x) for i, x in enumerate(out))]


def test_stream_restarts_from_its_checkpoint(spark, whole, tmp_path):
    deltas = _dealt(3)
    cut = len(deltas) // 3
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", 2).parquet(source)
        return run_available(citations.parse_stream(stream), target, checkpoint)

    for k in range(3):
        part = deltas[k * cut : (k + 1) * cut] if k < 2 else deltas[2 * cut :]
        spark.createDataFrame(part, DELTAS).repartition(2).write.mode("append").parquet(source)
        found = run()
    assert rows(citations.merged(found)) == whole
    # What was processed before is sent once more: nothing new comes out.
    spark.createDataFrame(deltas[:cut], DELTAS).write.mode("append").parquet(source)
    assert rows(citations.merged(run())) == whole


def test_null_texts_and_offers(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "x [[cite:ev_1]]", None)], SCHEMA)
    assert rows(citations.parse(df)) == [("a", 0, "status", "complete", ()), ("b", 0, "status", "invalid", ()), ("b", 1, "text", "x ", ())]
    assert citations.parse(df.where("false")).count() == 0


def test_complete_sentence(spark):
    full = "Intro text here. The mechanism is called Route Origin Validation (ROV).  It uses ROAs! 第一句。第二句 ends."
    asked = [("The mechanism is called Rou…", "The mechanism is called Route Origin Validation (ROV)."), ("第二句", "第二句 ends."), ("nowhere", "Intro text here."), ("", "Intro text here."), (None, "Intro text here.")]
    df = spark.createDataFrame([(full, p, w) for p, w in asked] + [(None, " a  b…", "a b…")], "full string, preview string, want string")
    got = df.select("want", citations.complete_sentence(F.col("full"), F.col("preview")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
