"""Chunks and section structure of documents, and how well they hold together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import spread, table
from .evidence import sequential

MAX_CHARS, MIN_CHARS = 1_800, 220


@query()
def split_content_chunks(spark, d):
    """Chunks of up to 1800 characters: paragraphs are packed, long ones cut at sentences; under 220 they go."""
    return split_content(table(spark, d, "documents"))


def split_content(docs: DataFrame, longest: int = MAX_CHARS, shortest: int = MIN_CHARS) -> DataFrame:
    """Greedy packing as a fold over each text's pieces, inside the JVM."""
    sentences = F.flatten(F.transform(F.split("text", "\n+"), lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(F.split(p, r"(?<=[.!?])\s+"))))
    hard = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(s) - 1, F.lit(0)) / longest).cast("int")), lambda i: F.substring(s, i * longest + 1, F.lit(longest)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a, piece):
        fits = F.length(a["open"]) + F.length(piece) + 1 <= longest
        more = F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit("\n"), piece).alias("open"))
        cut = F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), piece.alias("open"))
        return F.when(a["open"] == "", F.struct(a["done"].alias("done"), piece.alias("open"))).when(fits, more).otherwise(cut)

    packed = F.aggregate(F.filter(hard, lambda x: F.btrim(x) != ""), start, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    rows = docs.select("doc_id", F.posexplode(F.filter(packed, lambda c: F.length(c) >= shortest)).alias("k", "content"))
    return rows.select("doc_id", F.format_string("%s_s001_sec_%03d", F.col("doc_id").cast("string"), F.col("k") + 1).alias("chunk_id"), "content")


def _paragraph_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs merge up to 800 estimated tokens; a heading begins a new chunk and stays on its path."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            section, held, size, n = "", [], 0, 0
            for block in [*(x.strip() for x in (text or "").split("\n")), None]:
                heading = block is not None and 0 < len(block) <= 60 and not block.endswith((".", "!", "?", ","))
                cost = -(-len(block or "") // 4)
                if held and (block is None or heading or size + cost > 800):
                    rows.append((doc_id, n, section, "\n".join(held), size))
                    n, held, size = n + 1, [], 0
                if heading:
                    section = block
                if block:
                    held.append(block)
                    size += max(1, cost)
        yield pd.DataFrame(rows, columns=["doc_id", "position", "section", "content", "tokens"])


@query()
def semantic_chunks_plain(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.mapInPandas(_paragraph_chunks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, position int, section string, content string, tokens int")


MAX_CHUNK, LEVELS = 1_200, 6


def hierarchy_chunks(blocks: DataFrame, longest: int = MAX_CHUNK) -> DataFrame:
    """Section and chunks of each block (doc_id, position, block_type, level, text).

    Headings nest by level: a section's path is its own heading under the last ones of smaller levels. Paragraphs, list
    items and code are cut at the last space within longest characters; tables and formulas stay whole. Blocks of other
    kinds, and blank ones, come back with a reason and without content. One window a document finds the headings above.
    """
    text = F.btrim("text", F.lit(" \t\n"))
    heads = F.col("block_type").isin("title", "heading") & (text != "")
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_l{k}": F.max(F.when(heads & (F.col("level") == k), F.struct("position", text.alias("heading")))).over(w) for k in range(1, LEVELS + 1)}
    blocks = blocks.withColumns(last)
    # The last heading of a level holds if none of a smaller level came after it.
    place = lambda k: F.coalesce(F.col(f"_l{k}.position"), F.lit(-1))
    holds = [place(k) > F.greatest(F.lit(-1), F.lit(-1), *[place(j) for j in range(1, k)]) for k in range(1, LEVELS + 1)]
    path = F.array_compact(F.array(*[F.when(h, F.col(f"_l{k}.heading")) for k, h in enumerate(holds, 1)]))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?=\S)(?:.{{1,{longest}}}(?= |\z)|.{{1,{longest}}})"), F.lit(0))
    splits, whole = F.col("block_type").isin("paragraph", "list_item", "code"), F.col("block_type").isin("table", "formula")
    parts = F.when(splits & (text != ""), F.transform(cut, lambda x: F.btrim(x, F.lit(" \t\n")))).when(whole & (text != ""), F.array(text))
    reason = F.when(heads, F.lit(None)).when((splits | whole) & (text == ""), "empty_content").when(F.col("block_type") == "picture", "asset_reference_only").when(~splits & ~whole, "unknown_block_type")
    rows = X.fixed(blocks, "doc_id", "position", path=path, parts=parts, reason=reason, head=heads)
    return rows.where("NOT head").select("doc_id", "position", F.array_join("path", " > ").alias("section_path"), "reason", F.posexplode_outer("parts").alias("part", "content"))


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents),
k AS (SELECT doc_id, position, trim(text, ' ' || chr(9) || chr(10)) AS t, CASE WHEN length(trim(text)) BETWEEN 1 AND 60 THEN 'heading' WHEN text LIKE '|%' THEN 'table' ELSE 'paragraph' END AS kind FROM b),
c(doc_id, position, part, content, rest) AS (SELECT doc_id, position, -1, '', t FROM k WHERE kind = 'paragraph' AND t <> '' UNION ALL
 SELECT doc_id, position, part + 1, trim(left(rest, x), ' ' || chr(9) || chr(10)), trim(substring(rest, x + 1), ' ' || chr(9) || chr(10)) FROM (SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest) WHEN instr(reverse(left(rest, 1201)), ' ') BETWEEN 1 AND 1200 THEN 1201 - instr(reverse(left(rest, 1201)), ' ') ELSE 1200 END::INT AS x FROM c WHERE rest <> '')),
h AS (SELECT k.doc_id, k.position, (SELECT arg_max(x.t, x.position) FROM k x WHERE x.doc_id = k.doc_id AND x.kind = 'heading' AND x.position < k.position) AS section FROM k)
SELECT k.doc_id, k.position, coalesce(h.section, '') AS section_path, CASE WHEN k.t = '' THEN 'empty_content' END AS reason, c.part, c.content FROM k JOIN h ON h.doc_id = k.doc_id AND h.position = k.position LEFT JOIN (SELECT doc_id, position, part, content FROM c WHERE part >= 0 UNION ALL SELECT doc_id, position, 0, t FROM k WHERE kind = 'table' AND t <> '') c ON c.doc_id = k.doc_id AND c.position = k.position WHERE k.kind <> 'heading'""")
def section_chunks(spark, d):
    """Lines of documents as blocks, short ones as headings of one level, in chunks of 1200 characters at most."""
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    kind = F.when(F.length(F.trim("text")).between(1, 60), "heading").when(F.col("text").startswith("|"), "table").otherwise("paragraph")
    return hierarchy_chunks(lines.select("doc_id", F.col("position").cast("long").alias("position"), kind.alias("block_type"), F.lit(1).alias("level"), "text")).withColumn("part", F.col("part").cast("long"))


@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents), h AS (SELECT doc_id, p, 1 + length(line) % 4 AS level FROM b WHERE length(line) BETWEEN 1 AND 80)
SELECT a.doc_id, a.p, a.level, (SELECT max(x.p) FROM h x WHERE x.doc_id = a.doc_id AND x.p < a.p AND x.level < a.level) AS parent FROM h a""")
def heading_parents(spark, d):
    """Each heading's parent: the last heading before it of a smaller level. Levels here come of line lengths."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.length("line").between(1, 80))
    return parents(lines.select("doc_id", (F.col("k") + 1).cast("long").alias("p"), (1 + F.length("line") % 4).cast("long").alias("level")), 4)


def parents(headings: DataFrame, levels: int) -> DataFrame:
    """headings: doc_id, p, level from 1. One window keeps the last position of every level."""
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("p"))).over(w).alias(f"_l{k}") for k in range(1, levels)]
    found = F.array_max(F.array(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, levels)]))
    return headings.select("*", *last).select("doc_id", "p", "level", found.alias("parent"))


@query("""WITH c AS (SELECT conv_id, turn, lead(turn) OVER w AS nxt, lag(turn) OVER w AS prv, length(text) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT count(*) AS chunks, count(*) FILTER (prv IS NULL) AS roots, round(avg(CASE WHEN nxt IS NULL OR nxt = turn + 1 THEN 1.0 ELSE 0.0 END), 6) AS adjacency_correct, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS resolved FROM c""")
def chunk_structure_metrics(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("turn", F.lead("turn").over(w).alias("nxt"), F.lag("turn").over(w).alias("prv"), F.length("text").alias("n"))
    right = F.when(F.col("nxt").isNull() | (F.col("nxt") == F.col("turn") + 1), 1.0).otherwise(0.0)
    return c.agg(F.count("*").alias("chunks"), F.count_if(F.col("prv").isNull()).alias("roots"), F.round(F.avg(right), 6).alias("adjacency_correct"), F.round(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 6).alias("resolved"))


@query("""WITH g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM conversations), p AS (SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (a.r < b.r) AS right_order FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1) SELECT conv_id, pairs, right_order, round(right_order::DOUBLE / pairs, 6) AS accuracy FROM p""")
def reading_order_accuracy(spark, d):
    """Share of block pairs in the right order, of an order by length against the true one."""
    blocks = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return order_accuracy(blocks, "conv_id", "turn", ["size", "turn"])


def order_accuracy(rows: DataFrame, group: str, true: str, found: list[str]) -> DataFrame:
    """group, pairs, right_order and accuracy of an order by the columns found against the true one.

    No pairs are made. A row's rank in the found order is split bit by bit: two rows whose ranks first differ at a bit
    are in the right order if the one without it comes first, and how many such there are follows from the sum of places
    of the rows with it. Each bit takes one sort of all rows over all tasks, and there are as many as the longest group
    needs. Rows with one true place are no pair.
    """
    keyed = sequential(rows.select(group, F.col(true).alias("_t"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(found)]), group, *[f"_f{i}" for i in range(len(found))])
    first = keyed.groupBy(group).agg(F.min("seq").alias("_s"), F.count("*").alias("_n"))
    ties = keyed.groupBy(group, "_t").agg(F.count("*").alias("_c")).groupBy(group).agg(F.sum(F.expr("_c * (_c - 1) div 2")).alias("_same"))
    sizes = settle(first.join(ties, first[group].eqNullSafe(ties[group])).select(first[group].alias("_g"), "_s", (F.expr("_n * (_n - 1) div 2") - F.col("_same")).alias("pairs"), "_n"), "sizes")
    ranked = settle(keyed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select("_g", "_t", (F.col("seq") - F.col("_s")).alias("_r")), "ranked")
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    right = []
    for bit in range(max(1, (longest - 1).bit_length())):
        cell = ranked.withColumns({"_cell": F.shiftright("_r", bit + 1), "_down": -F.col("_r")})
        placed = sequential(cell, "_g", "_cell", "_t", "_down")
        one = F.shiftright("_r", bit).bitwiseAND(F.lit(1)) == 1
        by = placed.groupBy("_g", "_cell").agg(F.min("seq").alias("low"), F.count_if(one).alias("k"), F.sum(F.when(one, F.col("seq"))).alias("places"))
        right.append(by.select("_g", F.expr("coalesce(places, 0) - k * low - k * (k - 1) div 2").alias("x")))
    total = reduce(DataFrame.unionByName, right).groupBy(F.col("_g").alias("_h")).agg(F.sum("x").alias("right_order"))
    out = sizes.where("pairs > 0").join(total, F.col("_g").eqNullSafe(F.col("_h")))
    return out.select(F.col("_g").alias(group), "pairs", "right_order", F.round(F.col("right_order") / F.col("pairs"), 6).alias("accuracy"))


@query("""WITH g AS (SELECT DISTINCT p_type AS doc, p_name AS h FROM part WHERE p_size <= 30), f AS (SELECT DISTINCT p_type AS doc, p_name AS h FROM part WHERE p_size >= 10), j AS (SELECT coalesce(g.doc, f.doc) AS doc, count(g.h) AS gold, count(f.h) AS found, count(*) FILTER (g.h IS NOT NULL AND f.h IS NOT NULL) AS hits FROM g FULL JOIN f ON g.doc = f.doc AND g.h = f.h GROUP BY 1) SELECT doc, gold, found, hits, round(2.0::DOUBLE * hits / (gold + found), 6) AS f1 FROM j""")
def heading_f1(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("doc"), "p_name").agg(F.max(F.when(F.col("p_size") <= 30, 1).otherwise(0)).alias("g"), F.max(F.when(F.col("p_size") >= 10, 1).otherwise(0)).alias("f"))
    j = p.groupBy("doc").agg(F.sum("g").alias("gold"), F.sum("f").alias("found"), F.sum(F.col("g") * F.col("f")).alias("hits"))
    return j.withColumn("f1", F.round(2.0 * F.col("hits") / (F.col("gold") + F.col("found")), 6))
