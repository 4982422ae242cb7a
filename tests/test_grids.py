import random

import pytest

from evidara.operators import grids

CELLS = "table long, row int, col int, text string, row_span int, col_span int"


def plain_groups(rows, caption, most, headers=1):
    line = lambda r: "| " + " | ".join(r) + " |"
    top = [line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:headers])]
    head = (f"{caption}\n\n" if caption else "") + "\n".join(top)
    groups, now = [], []
    for r in rows[headers:]:
        if now and (len("\n".join([head, *now, line(r)])) + 3) // 4 > most:
            groups.append(now)
            now = []
        now.append(line(r))
    return ["\n".join([head, *g]) for g in [*groups, now]]


def made(seed):
    rng = random.Random(seed)
    tables = [(t, rng.randint(1, 9), rng.randint(1, 4)) for t in range(20)]
    cells = [(t, rng.randint(-1, r), rng.randint(-1, c), rng.choice(["a", "two  words", "x|y", "line\nend", None, "word " * 9]), rng.choice([None, 1, 2, 3]), rng.choice([1, 1, 2])) for t, r, c in tables for _ in range(rng.randint(0, 12))]
    return tables, cells


def plain_grid(tables, cells, fill):
    out = {t: [[None] * c for _ in range(r)] for t, r, c in tables}
    for t, row, col, text, down, right in cells:
        said = " ".join((text or "").split()).replace("|", "\\|")
        for i in range(row, row + (max(down or 1, 1) if fill else 1)):
            for j in range(col, col + (max(right, 1) if fill else 1)):
                if 0 <= i < len(out[t]) and 0 <= j < len(out[t][0]):
                    out[t][i][j] = max(out[t][i][j] or "", said)
    return {t: [[x or "" for x in r] for r in g] for t, g in out.items()}


@pytest.mark.parametrize("fill", [False, True])
def test_grids_and_groups_against_plain_loops(spark, fill):
    tables, cells = made(int(fill))
    known = spark.createDataFrame(tables, "table long, rows int, columns int")
    rows = grids.grid(known, spark.createDataFrame(cells, CELLS), fill).cache()
    want = plain_grid(tables, cells, fill)
    got = {}
    for r in rows.orderBy("table", "row").collect():
        got.setdefault(r["table"], []).append(list(r["columns"]))
    assert got == want
    captions = {t: ("" if t % 3 == 0 else f"Table {t}") for t, _, _ in tables}
    for most, headers in ((30, 1), (25, 2), (1000, 1)):
        groups = grids.row_groups(rows, spark.createDataFrame([(t, c or None) for t, c in captions.items()], "table long, caption string"), most, headers)
        found = {}
        for r in groups.orderBy("table", "k").collect():
            found.setdefault(r["table"], []).append(r["content"])
            assert r["tokens"] == max(1, (len(r["content"]) + 3) // 4)
        assert found == {t: plain_groups(g, captions[t], most, headers) for t, g in want.items()}


def test_nothing(spark):
    known = spark.createDataFrame([(1, 0, 3)], "table long, rows int, columns int")
    assert grids.grid(known, spark.createDataFrame([], CELLS)).count() == 0
