"""Resharding by minimum-cost flow.

Rows lie in old shards and are to lie in new ones whose row counts differ by one at most (law ``rows``). Blocks are the
rows of one old shard and one size class (eight to an octave); there are a few thousand at most, however many rows. A
flow from blocks to shards costs nothing where a block stays and its mean bytes a row where it moves; the cheapest flow
that fills the capacities moves the fewest bytes. Blocks go whole or up to a cut, of which there are two a shard or so.
Within a block rows are ordered by size and then by a hash of the row, smallest first to move; the key at each cut is
found by counting ranges, so a row's new shard follows from its own block and key, without a shuffle. Affected shards
are then written, with one shuffle of their rows, and a row's slot is its place in the files of its shard.

Null texts have size 1. Rows alike in every column are interchangeable; where a cut falls among them they are counted,
and the counts dealt out. Rows with a null doc_id lie in old shard 0. Tables smaller than the number of shards leave
shards empty. Columns of any name are carried along.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir

OLD_SHARDS, SHARDS, LAW = 6, 8, "rows"
PER_OCTAVE, HASH_BITS = 8, 31
#: Ranges counted at once in the search for the cuts, over all of them.
RANGES = 65_536


def cheapest_flow(supply: dict[tuple[int, int], tuple[int, float]], floor: int, extra: int, shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """supply: rows and bytes a row of each block (old shard, class). Returns each block's (shard, rows), stays first.

    Successive shortest paths over source, blocks, shards and sink. A shard holds floor rows and, for extra of them
    in all, one more.
    """
    blocks = sorted(supply)
    source, pool, bonus, sink = range(4)
    block_node = {b: 4 + i for i, b in enumerate(blocks)}
    shard_node = [4 + len(blocks) + j for j in range(shards)]
    graph: list[list[list]] = [[] for _ in range(4 + len(blocks) + shards)]  # arcs: to, capacity, cost, index of the reverse

    def arc(a: int, b: int, capacity: int, cost: float) -> list:
        forth, back = [b, capacity, cost, len(graph[b])], [a, 0, -cost, len(graph[a])]
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    stay, move = {}, {}
    for b, (rows, cost) in supply.items():
        arc(source, block_node[b], rows, 0.0)
        if b[0] < shards:
            stay[b] = arc(block_node[b], shard_node[b[0]], rows, 0.0)
        move[b] = arc(block_node[b], pool, rows, cost)
    into = [arc(pool, shard_node[j], 1 << 62, 0.0) for j in range(shards)]
    for j in range(shards):
        arc(shard_node[j], sink, floor, 0.0)
        arc(shard_node[j], bonus, 1, 0.0)
    arc(bonus, sink, extra, 0.0)
    height = [0.0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [None] * len(graph)
        far[source], heap = 0.0, [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u] + 1e-9:
                continue
            for a in graph[u]:
                if a[1] and (e := d + max(0.0, a[2] + height[u] - height[a[0]])) < far[a[0]] - 1e-9:
                    far[a[0]], via[a[0]] = e, (u, a)
                    heapq.heappush(heap, (e, a[0]))
        if via[sink] is None:
            break
        height = [h + (f if f < float("inf") else 0.0) for h, f in zip(height, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(via[at][1])
            at = via[at][0]
        flow = min(a[1] for a in path)
        for a in path:
            a[1] -= flow
            graph[a[0]][a[3]][1] += flow
    room = [(1 << 62) - a[1] for a in into]  # rows that come to each shard from the pool
    out = {}
    j = 0
    for b in blocks:
        rows = supply[b][0]
        kept = rows - stay[b][1] if b in stay else 0
        parts, left = [(b[0], kept)] if kept else [], rows - kept
        while left:
            while not room[j]:
                j += 1
            n = min(left, room[j])
            parts.append((j, n))
            room[j], left = room[j] - n, left - n
        out[b] = parts
    return out


def by_id(shards: int) -> Column:
    """Old shard by doc_id."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(shards)).cast("int")


def _bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def size_of() -> Column:
    return (F.octet_length(_bytes()) + 1).cast("long")


@dataclass
class Moves:
    """Which rows go where: ranges of keys of each block, and shares of those rows that are alike at a cut."""

    old_shard: Column
    pieces: list[tuple] = field(default_factory=list)  # old, class, low key, high key (exclusive), shard
    ties: list[tuple] = field(default_factory=list)  # old, class, key, first and last + 1 of the rows with it, shard
    affected: set[int] = field(default_factory=set)
    filled: set[int] = field(default_factory=set)
    moved_bytes: float = 0.0


def _keyed(docs: DataFrame, old: Column) -> DataFrame:
    """docs as _row, with the block and the key of each row."""
    hashed = [docs[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    key = F.shiftleft(size_of(), HASH_BITS).bitwiseOR(F.xxhash64(*hashed).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), old.alias("_old"), F.floor(F.log2(size_of()) * PER_OCTAVE).cast("int").alias("_class"), key.alias("_key"))


def _keys_at(rows: DataFrame, cuts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """For each cut (old, class, ordinal, low, high): the key of the row at the ordinal, how many rows of the block lie
    below that key, and how many have it. Each round counts the ranges of what is left of every block."""
    spark = rows.sparkSession
    state = {i: (low, high, 0, 0) for i, (*_, low, high) in enumerate(cuts)}  # the key lies in [low, high); rows below, rows in it
    ranges = max(16, RANGES // max(1, len(cuts)))
    while todo := [(i, *cuts[i][:2], low, high, -(-(high - low) // ranges)) for i, (low, high, _, n) in state.items() if high - low > 1 or not n]:
        near = spark.createDataFrame(todo, "_cut int, _o int, _c int, low long, high long, width long")
        inside = (F.col("_old") == F.col("_o")) & (F.col("_class") == F.col("_c")) & (F.col("_key") >= F.col("low")) & (F.col("_key") < F.col("high"))
        ranged = rows.join(F.broadcast(near), inside).groupBy("_cut", F.expr("(_key - low) div width").alias("range")).agg(F.count("*").alias("n"))
        counts = defaultdict(dict)
        for r in ranged.collect():
            counts[r["_cut"]][r["range"]] = r["n"]
        for i, _, _, low, high, width in todo:
            below, at = state[i][2], -1
            for at, n in sorted(counts[i].items()):
                if below + n > cuts[i][2]:
                    state[i] = (low + at * width, min(high, low + (at + 1) * width), below, n)
                    break
                below += n
    return [(low, below, n) for low, _, below, n in state.values()]


def plan(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS) -> Moves:
    """old_shard: an int from 0 for every row; by default doc_id over six shards."""
    out = Moves(by_id(OLD_SHARDS) if old_shard is None else old_shard)
    rows = settle(_keyed(docs, out.old_shard).drop("_row"), "keys")
    found = rows.groupBy("_old", "_class").agg(F.count("*").alias("n"), F.sum(F.shiftright("_key", HASH_BITS)).alias("bytes"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
    blocks = {(r["_old"], r["_class"]): r for r in found}
    total = sum(r["n"] for r in found)
    flow = cheapest_flow({b: (r["n"], r["bytes"] / r["n"]) for b, r in blocks.items()}, total // shards, total % shards, shards)
    cuts, parts_of = [], {}
    for b, parts in sorted(flow.items()):
        # Stays are taken from a block's large end, so what moves comes first.
        parts_of[b] = [*parts[1:], parts[0]] if parts[0][0] == b[0] else parts
        at = 0
        for shard, n in parts_of[b]:
            out.filled.add(shard)
            if shard != b[0]:
                out.affected |= {shard, b[0]}
            if (at := at + n) < blocks[b]["n"]:
                cuts.append((*b, at, blocks[b]["low"], blocks[b]["high"] + 1))
    keys = iter(_keys_at(rows, cuts))
    for (o, c), parts in parts_of.items():
        low, at, tie = blocks[o, c]["low"], 0, None  # tie: key, rows below it and with it, if a cut fell among these
        for shard, n in parts:
            at += n
            last = at == blocks[o, c]["n"]
            key, below, alike = (blocks[o, c]["high"] + 1, at, 0) if last else next(keys)
            if tie and tie[0] != key:
                out.ties.append((o, c, tie[0], at - n - tie[1], tie[2], shard))
                low, tie = tie[0] + 1, None
            if tie:
                out.ties.append((o, c, key, at - n - below, at - below, shard))
                continue
            if low < key:
                out.pieces.append((o, c, low, key, shard))
            low = key
            if at > below:
                out.ties.append((o, c, key, 0, at - below, shard))
                tie = (key, below, alike)
    return out


def assign(docs: DataFrame, moves: Moves) -> DataFrame:
    """docs as _row, with its new _shard."""
    spark = docs.sparkSession
    keyed = _keyed(docs, moves.old_shard)
    same = (F.col("_old") == F.col("_o")) & (F.col("_class") == F.col("_c"))
    pieces = spark.createDataFrame(moves.pieces, "_o int, _c int, low long, high long, _shard int")
    placed = keyed.join(F.broadcast(pieces), same & (F.col("_key") >= F.col("low")) & (F.col("_key") < F.col("high"))).select("_row", "_shard")
    if not moves.ties:
        return placed
    ties = spark.createDataFrame(moves.ties, "_o int, _c int, _k long, first long, stop long, _shard int")
    same = same & (F.col("_key") == F.col("_k"))
    # Counted in 64 parts each, so that no task deals out all copies of one row.
    alike = keyed.join(F.broadcast(ties.select("_o", "_c", "_k").distinct()), same, "left_semi").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    counted = settle(alike.groupBy("_old", "_class", "_key", "_part", "_row").agg(F.count("*").alias("_n")), "alike")
    before = F.sum("_n").over(Window.partitionBy("_old", "_class", "_key").orderBy(F.xxhash64("_row"), "_part").rowsBetween(Window.unboundedPreceding, -1))
    ranged = settle(counted.withColumn("_from", F.coalesce(before, F.lit(0))), "ranged")
    overlap = F.least(F.col("_from") + F.col("_n"), F.col("stop")) - F.greatest("_from", "first")
    shares = ranged.join(F.broadcast(ties), same).withColumn("_take", overlap).where("_take > 0")
    return placed.union(shares.select("_row", "_shard", F.explode(F.sequence(F.lit(1).cast("long"), "_take")).alias("_i")).select("_row", "_shard"))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def rewrite(docs: DataFrame, moves: Moves, path: str) -> list[int]:
    """Write the shards that gain or lose rows, and those not yet there, under path/_shard=N; their numbers.

    Other shards keep their files. Folders of shards that became empty go. A rerun after a failure writes the same rows.
    """
    spark = docs.sparkSession
    files, _ = _folder(spark, path)
    there = lambda shard: files.exists(_folder(spark, f"{path}/_shard={shard}")[1])
    todo = sorted(moves.affected | {s for s in moves.filled if not there(s)})
    rows = assign(docs, moves).where(F.col("_shard").isin(todo)).hint("rebalance", F.col("_shard"))
    rows.select("_row.*", "_shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard").parquet(path)
    for shard in set(todo) - moves.filled:
        files.delete(_folder(spark, f"{path}/_shard={shard}")[1], True)
    return todo


def located(docs: DataFrame, path: str) -> DataFrame:
    """The rows written under path, with _shard and _slot: their place in the shard, by file and by row of the file.

    docs: anything with the columns that were written.
    """
    written = docs.sparkSession.read.schema(docs.withColumn("_shard", F.lit(0)).schema).parquet(path)
    at = F.col("_metadata.file_path")
    files = written.select("_shard", at.alias("_file")).groupBy("_shard", "_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = settle(files.select(F.col("_file").alias("_in"), F.coalesce(before, F.lit(0)).alias("_before")), "files")
    rows = written.select("*", at.alias("_file"), F.col("_metadata.row_index").alias("_index"))
    return rows.join(files, F.col("_file") == F.col("_in")).withColumn("_slot", F.col("_before") + F.col("_index")).drop("_file", "_in", "_before", "_index")


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot and moved for every row of docs, read from the new shards."""
    spark = docs.sparkSession
    moves = plan(docs, old_shard, shards)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rewrite(docs, moves, path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    return located(docs, path).select(
        "doc_id", size_of().alias("size"), F.crc32(_bytes()).cast("long").alias("text_crc32"), F.lit(LAW).alias("law"), moves.old_shard.alias("old_shard"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), (moves.old_shard != F.col("_shard")).alias("moved"),
    )
