import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from evidara.llm import conversation_repair
from evidara.llm.conversation_repair import LAST, costs_to_go, repair, walk

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x)) for c, r in out.items()}


def cheapest(symbols):
    """(cost, audit, initials added) of the cheapest edits by a search over every string of edits, best first."""
    import heapq

    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, initials, added = heapq.heappop(heap)
        state = initials[-1:]
        if (i, state) in done:
            continue
        # The heap is in order of cost, then of letters: the first to reach a place is the best way there.
        done.add((i, state))
        if i == len(symbols) and GRAMMAR.fullmatch(initials):
            return cost, audit, added
        steps = [("I", x, 5, i, x) for x in "ua"]
        if i < len(symbols):
            steps.append(("D", "", 2, i + 1, "-"))
            if not symbols[i].isdigit():
                extra = 5 * symbols[i].isupper()
                steps.append(("K", symbols[i].lower(), extra, i + 1, "="))
                steps += [("R", x, 1 + extra, i + 1, x) for x in "ua"]
        for letter, x, more, at, mark in steps:
            then = initials + x
            # Anything that can still be made whole: it is a prefix of the grammar.
            if re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(heap, (cost + more, audit + letter, at, then, added + mark))


def brute(rows):
    out = []
    for conv, turns in damaged(rows).items():
        seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            end = text.rstrip(BLANK)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += {"blank": "1", "duplicate": "1", "truncated": initial.upper()}.get(fault, initial)
        cost, audit, added = cheapest(symbols)
        lines, i = [], 0
        for letter, mark in zip(audit, added, strict=True):
            name = {"u": "user", "a": "assistant"}.get(mark)
            if letter == "I":
                lines.append(f"{name}:")
                continue
            if letter != "D":
                lines.append(f"{name or turns[i][1]}:{turns[i][2]}")
            i += 1
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_walk_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(400):
        symbols = "".join(rng.choice("suaoSUAO1") for _ in range(rng.randint(0, 9)))
        to_go = costs_to_go(symbols, LAST)
        edits, _ = walk(symbols, to_go, 0, True)
        audit = "".join("I" * len(e["before"]) + e["letter"] + "I" * len(e["after"]) for e in edits)
        assert (to_go[0][0], audit) == cheapest(symbols)[:2], symbols


def made(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        conv = rng.choice([1, 1, 2, 3, None, 9_007_199_254_740_993])
        role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "User"])
        out.append((conv, rng.choice([None, *range(60)]), role, rng.choice([None, "", " \n", "Yes.", "no", "é!", "a b?  ", f"t{rng.randint(0, 99)}."])))
    return out


@pytest.mark.parametrize(("block", "fan"), [(4096, 1024), (7, 3), (2, 2)])
def test_repair_against_brute_force(spark, block, fan):
    data = made(block)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    assert rows(repair(df, block, fan)) == brute(data)


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows(repair(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_nothing_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made(1, 30), "conv_id long, turn long, role string, text string")
    more = df.withColumns({c: F.lit("other") for c in ("at", "pos", "block", "symbol", "conv", "cost", "copy")})
    assert rows(repair(more)) == brute(made(1, 30))
    assert repair(df.where("false")).collect() == []
    gone = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows(repair(alone)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_texts_and_many_turns(spark):
    data = [(7, t, "user" if t % 2 == 0 else "assistant", ("x" * 300_000 if t == 3 else f"line {t}") + ".") for t in range(9000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(repair(df)) == brute(data)
    assert conversation_repair.BLOCK < 9000
