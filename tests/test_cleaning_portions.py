"""Edits leave Python in portions of bounded size."""

import pyarrow as pa

from evidara.operators import cleaning


def test_portions_are_cut_by_characters():
    texts = ["a" * 4, "é" * 4, "", "b" * 50, "c", "d" * 9, "e"]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(7)), "text": texts})
    parts = [p.column("text").to_pylist() for p in cleaning._portions(batch, 10)]
    assert sum(parts, []) == texts and all(sum(map(len, p)) <= 10 or len(p) == 1 for p in parts)
    assert [p.num_rows for p in cleaning._portions(batch.slice(0, 0), 10)] in ([], [0])


def test_portions_do_not_change_rows(spark, monkeypatch):
    rows = [(2**60 + 1, "s", "a  b\r\nHEAD\n\n c "), (None, "s", "HEAD\nx"), (3, "s", None), (4, "s", "HEAD"), (5, None, "e\u0301 \tﬁ")]
    docs = spark.createDataFrame(rows, "doc long, source string, text string").coalesce(1)
    whole = sorted(map(str, cleaning.clean(docs).collect()))
    monkeypatch.setattr(cleaning, "HELD", 3)
    assert sorted(map(str, cleaning.clean(docs).collect())) == whole
    assert {r["doc"]: r["cleaned"] for r in cleaning.clean(docs).collect()} == {2**60 + 1: "a b\nc", None: "HEAD\nx", 3: "", 4: "", 5: "\u00e9 fi"}
