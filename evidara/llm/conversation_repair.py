"""Repair of conversation structure: backward cost-to-go over turns and grammar states, then a greedy walk forward.

Rows are put in order once, by one global sort; faults are found by joins and counts over positions. What the programme
reads is one symbol a row: its role's initial and its fault. Symbols are gathered in blocks of ``BLOCK`` rows. For each
block and state in front of it the costs to each state behind it form a small matrix; the cost-to-go behind every block
comes from products of these (least sums), ``FAN`` blocks at a time and level by level, so that a conversation of any
length is spread over tasks. Given the cost-to-go behind a block, the walk through it depends on the state in front only;
these maps are composed the same way. Then each block is walked once, taking among transitions that lose nothing the one
with the least letter, and the edits are joined back to the rows. The digest of a repaired conversation reads its lines
in order in one task, a batch at a time, since SHA-256 is a chain.

Null conv_id, turn, role and text are one space where text is made of them; rows of one null conv_id are one
conversation, whose id stays null. Rows of one turn are ordered by role and text, as damaged; repeated rows come one
after the other. A role without a first letter, or with another than s, u and a, cannot be kept. Empty tables give no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, settle

KINDS = 20
BLOCK, FAN = 4_096, 1_024
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What may follow each, and the state then.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted or relabelled row gets in each state.
ADDED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED, NEVER = 1, 2, 5, 5, 1 << 60
INITIALS = "suao"
EDITS = "array<struct<before:string,letter:string,role:string,after:string>>"


def _key(conv_id: Column) -> Column:
    """A conversation's id as text that is never null, as the tasks' tables have no whole numbers with nulls."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and copy of the rows as they are after the damage that their ids' hash deals."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % KINDS
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hurt = rows.select(_key(F.col("conv_id")).alias("conv"), "turn", said("role").alias("_role"), said("text").alias("_text"), kind.alias("_kind")).where("_kind <> 0")
    return hurt.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def in_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a unique number "at", sorted and settled, and conv, at, pos: places in each conversation from 0.

    Sorted files hold a conversation in a run of partitions. Only one that several partitions share needs an offset; there
    are fewer of those than two a partition.
    """
    kept = settle(rows.orderBy("conv", "turn", "role", "text", "copy").withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33)
    counts = kept.groupBy("conv", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    every = Window.partitionBy("conv")
    before = F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shared = counts.withColumn("_parts", F.count("*").over(every)).withColumn("offset", F.coalesce(before, F.lit(0))).where("_parts > 1")
    offsets = settle(shared.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), "offset"), "offsets")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at")) - 1
    numbered = kept.select("conv", "at", part.alias("part")).withColumn("_k", place)
    found = numbered.join(offsets, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    return kept, found.select("conv", "at", (F.col("_k") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"))


def faults(kept: DataFrame, places: DataFrame) -> DataFrame:
    """conv, pos, at, turn, fault and symbol of every row.

    symbol: the role's initial, o for any other; a capital if the row is truncated; a digit if it has to go.
    """
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    looked = kept.select("conv", "at", "turn", "role", F.sha2("text", 256).alias("_h"), F.substring("role", 1, 1).alias("_i"), end.alias("_end"))
    placed = settle(looked.join(places.select("at", "pos"), "at"), "looked")
    again = placed.groupBy("conv", "role", "_h").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = settle(again.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("_h").alias("_g"), "_first"), "again")
    known = placed.join(first, (F.col("conv") == F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_h") == F.col("_g")), "left")
    fault = F.when(F.col("_end") == "", "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("_i").isin("s", "u", "a"), F.col("_i")).otherwise("o")
    gone = F.translate("_initial", INITIALS, "1234")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), gone).when(F.col("fault") == "truncated", F.upper("_initial")).otherwise(F.col("_initial"))
    return known.select("conv", "pos", "at", "turn", fault.alias("fault"), initial.alias("_initial")).select("conv", "pos", "at", "turn", "fault", symbol.alias("symbol"))


def transitions(symbol: str, state: int) -> Iterator[tuple[str, int, int, str]]:
    """letter, cost, next state and new role ("" for the row's own) of the edits that pass over a row in a state."""
    yield "D", DELETE, state, ""
    if symbol.isdigit():
        return
    extra = TRUNCATED if symbol.isupper() else 0
    then = FOLLOWS[state].get(symbol.lower())
    if then is not None:
        yield "K", extra, then, ""
    yield "R", REROLE + extra, FOLLOWS[state][ADDED[state]], ADDED[state]


def inserted(costs: list[int]) -> list[int]:
    """Costs of each state if turns may be inserted first; three insertions pass through every state that can follow."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[FOLLOWS[q][ADDED[q]]], NEVER) for q, c in enumerate(costs)]
    return costs


#: Cost-to-go behind the last row: nothing more, or what completes the grammar.
LAST = inserted([0, NEVER, NEVER, 0])


def costs_to_go(symbols: str, behind: list[int]) -> list[list[int]]:
    """For each row and the end of the symbols, the least cost from each state in front of it."""
    out = [behind]
    for symbol in reversed(symbols):
        out.append(inserted([min(cost + out[-1][then] for _, cost, then, _ in transitions(symbol, q)) for q in range(4)]))
    return out[::-1]


def walk(symbols: str, to_go: list[list[int]], state: int, last: bool) -> tuple[list[dict[str, str]], int]:
    """before (roles inserted in front), letter, new role and after (roles inserted behind) of each row, and the state behind.

    Of the transitions on which cost and cost-to-go add up to the cost-to-go here, the one with the least letter; letters
    are D, I, K, R in ASCII. Only the last block inserts behind its last row.
    """
    edits, i, before = [], 0, ""
    while i < len(symbols) or last and to_go[i][state]:
        here, best = to_go[i][state], ("", 0, "")
        for letter, cost, then, role in transitions(symbols[i], state) if i < len(symbols) else ():
            if cost + to_go[i + 1][then] == here and (not best[0] or letter < best[0]):
                best = (letter, then, role)
        then = FOLLOWS[state][ADDED[state]]
        if INSERT + to_go[i][then] == here and (not best[0] or best[0] > "I"):
            best = ("I", then, ADDED[state])
        if best[0] == "I":
            before += best[2]
        else:
            edits.append({"before": before, "letter": best[0], "role": best[2], "after": ""})
            before, i = "", i + 1
        state = best[1]
    if before:
        edits[-1]["after"] = before
    return edits, state


def _matrix(symbols: str) -> list[int]:
    """Least costs from each state in front of a block to each behind it, row by row."""
    columns = [costs_to_go(symbols, [0 if q == end else NEVER for q in range(4)])[0] for end in range(4)]
    return [min(columns[end][q], NEVER) for q in range(4) for end in range(4)]


def _times(a: list[int], b: list[int]) -> list[int]:
    return [min(min(a[4 * q + k] + b[4 * k + end] for k in range(4)), NEVER) for q in range(4) for end in range(4)]


def _onto(a: list[int], costs: list[int]) -> list[int]:
    return [min(min(a[4 * q + k] + costs[k] for k in range(4)), NEVER) for q in range(4)]


def _scan(items: DataFrame, product: Callable, act: Callable, initial: list[int], backward: bool, fan: int) -> DataFrame:
    """conv, block, state: what the items after (backward) or before each block make of the initial state.

    items: conv, block, item. Products of ``fan`` blocks at a time stand for them one level up, where the same is done;
    the state at each product then goes down through its blocks. No task holds more than ``fan`` items of a conversation.
    """
    if not items.where("block > 0").take(1):
        return items.select("conv", "block", F.lit(initial).cast("array<long>").alias("state"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for item in group.sort_values("block")["item"]:
            total = list(item) if total is None else product(total, list(item))
        return pd.DataFrame({"conv": group["conv"].iloc[:1].array, "block": [int(group["block"].iloc[0]) // fan], "item": [total]})

    def passed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ascending=not backward)
        state, states = list(group["state"].iloc[0]), []
        for item in group["item"]:
            states.append(state)
            state = act(list(item), state)
        return pd.DataFrame({"conv": group["conv"].array, "block": group["block"].array, "state": states})

    above = F.floor(F.col("block") / fan)
    parents = settle(items.groupBy("conv", above.alias("_up")).applyInPandas(joined, "conv string, block long, item array<long>"), "blocks")
    states = settle(_scan(parents, product, act, initial, backward, fan), "states").select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "state")
    down = items.withColumn("_up", above).join(states, (F.col("conv") == F.col("_c")) & (F.col("_up") == F.col("_b")))
    return down.groupBy("conv", "_up").applyInPandas(passed, "conv string, block long, state array<long>")


def _with_states(blocks: DataFrame, states: DataFrame, name: str) -> DataFrame:
    found = states.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.col("state").alias(name))
    return blocks.join(found, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")


def plan_edits(symbols: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv, block, edits (one a row of the block), cost and illegal: the cheapest repair of least letters.

    symbols: conv, pos, symbol. Conversations of one block need no scan; the others' blocks go through two.
    """
    of = F.floor(F.col("pos") / block).alias("block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    blocks = settle(symbols.groupBy("conv", of).agg(text.alias("symbols")), "symbols")
    several = blocks.where("block > 0").select("conv").distinct()
    split = blocks.join(several, "conv", "left_semi")
    longs = "array<long>"
    whole = blocks.join(several, "conv", "left_anti").withColumns({"behind": F.lit(LAST).cast(longs), "front": F.lit([START]).cast(longs), "last": F.lit(True), "prior": F.lit("")})
    if split.take(1):
        in_series = lambda f: F.pandas_udf(lambda s: s.map(f), longs)
        split = settle(split, "split")
        costs = _scan(split.select("conv", "block", in_series(_matrix)("symbols").alias("item")), _times, _onto, LAST, True, fan)
        split = settle(_with_states(split, costs, "behind"), "split")
        ends = lambda symbols, behind: pd.Series([[walk(s, costs_to_go(s, list(b)), q, False)[1] for q in range(4)] for s, b in zip(symbols, behind, strict=True)])
        maps = split.select("conv", "block", F.pandas_udf(ends, longs)("symbols", "behind").alias("item"))
        fronts = _scan(maps, lambda a, b: [b[q] for q in a], lambda a, q: [a[q[0]]], [START], False, fan)
        order = Window.partitionBy("conv").orderBy("block")
        ended = {"last": F.lead("block").over(order).isNull(), "prior": F.coalesce(F.substring(F.lag("symbols").over(order), -1, 1), F.lit(""))}
        whole = whole.unionByName(_with_states(split, fronts, "front").withColumns(ended))

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, behind, front, last, prior in zip(b["symbols"], b["behind"], b["front"], b["last"], b["prior"], strict=True):
                to_go = costs_to_go(s, list(behind))
                edits, state = walk(s, to_go, front[0], last)
                # The cost of a block is what the cost-to-go loses over it.
                paid = to_go[0][front[0]] - (0 if last else behind[state])
                initials = (prior + s).lower().translate(str.maketrans("1234", INITIALS))
                out.append((edits, paid, sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))))
            yield pd.DataFrame({"conv": b["conv"], "block": b["block"]} | dict(zip(("edits", "cost", "illegal"), zip(*out, strict=True), strict=True))) if out else pd.DataFrame()

    return whole.mapInPandas(repaired, f"conv string, block long, edits {EDITS}, cost long, illegal long")


def _turns(roles: Column) -> Column:
    """Lines of inserted empty turns, by the initials of their roles."""
    return F.transform(F.filter(F.split(roles, ""), lambda x: x != ""), lambda x: F.concat(F.when(x == "u", NAMES["u"]).otherwise(NAMES["a"]), F.lit(":")))


def repaired_lines(kept: DataFrame, planned: DataFrame, places: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, at, letters and lines (an array) of every row after its edits."""
    own = F.col("_e.letter")
    edits = planned.select("conv", "block", F.posexplode("edits").alias("_k", "_e")).select(F.col("conv").alias("_c"), (F.col("block") * block + F.col("_k")).alias("_pos"), F.repeat(F.lit("I"), F.length("_e.before")).alias("_in"), own.alias("_own"), "_e")
    numbered = places.join(edits, (F.col("conv") == F.col("_c")) & (F.col("pos") == F.col("_pos"))).select("at", F.concat("_in", "_own", F.repeat(F.lit("I"), F.length("_e.after"))).alias("letters"), "_e")
    role = F.when(F.col("_e.role") == "", F.col("role")).when(F.col("_e.role") == "u", NAMES["u"]).otherwise(NAMES["a"])
    line = F.when(F.col("_e.letter") == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(":", role, "text")))
    return kept.join(numbered, "at").select("conv", "at", "letters", F.concat(_turns(F.col("_e.before")), line, _turns(F.col("_e.after"))).alias("lines"))


def digests(lines: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256: a conversation's lines in order, read a batch at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, audit, digest, empty = "", [], hashlib.sha256(), True
        for batch in batches:
            done = []
            for key, letters, text in zip(batch["conv"], batch["letters"], batch["lines"], strict=True):
                if audit and key != now:
                    done.append((now, "".join(audit), digest.hexdigest()))
                    audit, digest, empty = [], hashlib.sha256(), True
                now = key
                audit.append(letters)
                for line in text:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
            if done:
                yield pd.DataFrame(done, columns=["conv", "audit", "repaired_sha256"])
        if audit:
            yield pd.DataFrame([(now, "".join(audit), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(work, "conv string, audit string, repaired_sha256 string")


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    kept, places = in_order(damage(rows))
    places = settle(places, "places")
    found = settle(faults(kept, places), "faults")
    planned = settle(plan_edits(found.select("conv", "pos", "symbol"), block, fan), "edits")
    kinds = ("blank", "duplicate", "truncated")
    turns = found.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    costs = planned.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    last = digests(repaired_lines(kept, planned, places, block))
    every = rows.select("conv_id", _key(F.col("conv_id")).alias("conv")).distinct()
    whole = every.join(sums, "conv", "left").join(costs, "conv", "left").join(last, "conv", "left")
    numbers = ("gaps", *kinds, "illegal", "cost")
    return whole.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
