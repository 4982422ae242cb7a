"""Tables of documents as grids: spans filled or blank, row groups under a token limit that repeat caption and header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..sources.tables import table
from .openapi import pack, tokens


def grid(tables: DataFrame, cells: DataFrame, fill: bool = False) -> DataFrame:
    """table, row, columns: every row of every table, cells in place and "" where there is none.

    tables: table, rows, columns. cells: table, row, col, text, and row_span, col_span if fill, which then puts the text into
    every place of the span. Cells outside the grid are left out; of several in one place the last one by text counts. Line
    ends and runs of blanks in a cell are one blank, pipes are escaped.
    """
    said = F.replace(F.btrim(X.collapse(F.coalesce("text", F.lit("")))), F.lit("|"), F.lit("\\|"))
    placed = cells.select("table", "row", "col", said.alias("text"), *(["row_span", "col_span"] if fill else []))
    if fill:
        upto = lambda at, span: F.sequence(F.col(at).cast("int"), (F.col(at) + F.greatest(F.coalesce(span, F.lit(1)), F.lit(1)) - 1).cast("int"))
        placed = placed.select("table", F.explode(upto("row", "row_span")).alias("row"), "col", "col_span", "text").select("table", "row", F.explode(upto("col", "col_span")).alias("col"), "text")
    known = placed.join(tables, "table").where(F.col("row").between(0, F.col("rows") - 1) & F.col("col").between(0, F.col("columns") - 1))
    held = known.groupBy("table", "row", F.col("col").cast("int").alias("col")).agg(F.max("text").alias("text")).groupBy("table", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("held"))
    every = tables.where("rows > 0 AND columns > 0").select("table", "columns", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int"))).alias("row"))
    full = every.join(held.withColumn("row", F.col("row").cast("int")), ["table", "row"], "left")
    return full.select("table", "row", F.transform(F.sequence(F.lit(0), (F.col("columns") - 1).cast("int")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(""))).alias("columns"))


def row_groups(rows: DataFrame, captions: DataFrame, most: int, headers: int = 1) -> DataFrame:
    """table, k, content, tokens: Markdown of row groups in order, each with the caption and the header rows.

    rows: table, row, columns. captions: table, caption. The first header row is the table's; further ones stand under it
    in every group. A group grows while it stays under so many tokens, and holds one row at least. A table of header rows
    only is one group. The rows of one table meet in a row, as they lie in one block of a document.
    """
    line = F.concat(F.lit("| "), F.array_join("columns", " | "), F.lit(" |"))
    lines = rows.select("table", "row", line.alias("text"), F.size("columns").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.max("n")))
    top = lines.where(F.col("row") < headers).groupBy("table").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("h"), rule.alias("rule"))
    own = F.concat_ws("\n", F.get("h", F.lit(0))["text"], "rule", F.array_join(F.transform(F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda x: x["text"]), "\n"))
    head = F.concat(F.when(F.coalesce("caption", F.lit("")) != "", F.concat("caption", F.lit("\n\n"))).otherwise(""), F.rtrim(own, F.lit("\n")))
    heads = top.join(captions, "table", "left").select("table", head.alias("head"))
    body = lines.where(F.col("row") >= headers).select("table", F.col("row").alias("n"), "text")
    packed = pack(body.join(heads, "table"), ["table"], most)
    alone = heads.join(body.select("table").distinct(), "table", "left_anti").select("table", F.lit(0).alias("k"), F.col("head").alias("content"))
    return packed.unionByName(alone).withColumn("tokens", tokens(F.col("content")))


@query(r"""WITH RECURSIVE r AS (SELECT c_custkey AS t, c_name, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS i FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT c_custkey AS t, 'Orders of ' || c_name || chr(10) || chr(10) || '| order | status | priority |' || chr(10) || '| --- | --- | --- |' AS head FROM customer),
g AS (SELECT t, i, 0 AS k, length(line) + 1 AS size, line FROM r WHERE i = 1 UNION ALL SELECT r.t, r.i, CASE WHEN (length(head) + g.size + length(r.line) + 4) // 4 <= 60 THEN k ELSE k + 1 END, CASE WHEN (length(head) + g.size + length(r.line) + 4) // 4 <= 60 THEN g.size ELSE 0 END + length(r.line) + 1, r.line
  FROM g JOIN r ON r.t = g.t AND r.i = g.i + 1 JOIN h ON h.t = g.t),
c AS (SELECT t, k, head || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM g JOIN h USING (t) GROUP BY t, k, head UNION ALL SELECT t, 0, head FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.t = h.t))
SELECT t AS "table", k, content, greatest(1, (length(content) + 3) // 4) AS tokens FROM c""")
def table_groups(spark, d):
    """Each customer's orders as a table, from cells, in row groups of at most 60 tokens."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("table"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    listed = orders.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("o"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("table"), "c_name").join(listed, "table", "left")
    tables = customers.select("table", (F.coalesce(F.size("o"), F.lit(0)) + 1).alias("rows"), F.lit(3).alias("columns"))
    cell = lambda r, c, text: F.struct(r.alias("row"), F.lit(c).alias("col"), text.cast("string").alias("text"))
    top = F.array(*[cell(F.lit(0), c, F.lit(name)) for c, name in enumerate(("order", "status", "priority"))])
    body = F.flatten(F.transform(F.coalesce("o", F.slice(F.array(F.struct(F.lit(0).cast("long").alias("o_orderkey"), F.lit("").alias("o_orderstatus"), F.lit("").alias("o_orderpriority"))), 1, 0)), lambda x, i: F.array(cell(i + 1, 0, x["o_orderkey"]), cell(i + 1, 1, x["o_orderstatus"]), cell(i + 1, 2, x["o_orderpriority"]))))
    cells = customers.select("table", F.explode(F.concat(top, body)).alias("x")).select("table", "x.*")
    return row_groups(grid(tables, cells), customers.select("table", F.concat(F.lit("Orders of "), "c_name").alias("caption")), 60)
