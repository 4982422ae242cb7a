"""Lookups, joins, aggregations, windows, ordering and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table


def list_query(df: DataFrame, filters: dict[str, object], order: list[Column], limit: int) -> DataFrame:
    """Conjunction of the filters that are given, ordered, at most limit rows (1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    given = [F.col(k) == v for k, v in filters.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, given, F.lit(True))).orderBy(*order).limit(limit)


def pick_by_key(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first or last row of each key, combined before the shuffle."""
    at = F.struct(*order)
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg((F.max_by if last else F.min_by)(row, at).alias("_r")).select(key, "_r.*")


def anti_join(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(F.col(other or key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """edges: src, relation, dst. Per node its sorted outgoing and incoming neighbours as text."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set(F.concat("relation", F.lit(":"), "dst"))), ",").alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_set(F.concat("relation", F.lit(":"), "src"))), ",").alias("incoming"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("outgoing", F.lit("")).alias("outgoing"), F.coalesce("incoming", F.lit("")).alias("incoming"))


def place_edges(spark: SparkSession, d: str) -> DataFrame:
    """supplier in nation in region, as typed edges."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = s.select(name("supplier:", "s_suppkey").alias("src"), F.lit("located_in").alias("relation"), name("nation:", "s_nationkey").alias("dst"))
    b = n.select(name("nation:", "n_nationkey").alias("src"), F.lit("part_of").alias("relation"), name("region:", "n_regionkey").alias("dst"))
    return a.unionByName(b)


EDGES_SQL = """SELECT 'supplier:' || s_suppkey AS src, 'located_in' AS relation, 'nation:' || s_nationkey AS dst FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey FROM nation"""


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 7")
def kb_source_detail(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey = 7")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT doc_id, source, CAST(0 AS DOUBLE) AS score FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%' OR lower(lang) LIKE '%license%'")
def like_search_documents(spark, d):
    like = lambda c: F.lower(c).like("%license%")
    return table(spark, d, "documents").where(like("text") | like("source") | like("lang")).select("doc_id", "source", F.lit(0.0).alias("score"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def filtered_list(spark, d):
    return list_query(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_name, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def bridge_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_suppkey").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.count("*").alias("n_lines")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "n_orders", "n_lines")


@query("""SELECT s_suppkey, s_name, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity, CASE WHEN n IS NULL THEN 'missing' WHEN n >= 600 THEN 'rich' ELSE 'present' END AS status
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def source_catalog(spark, d):
    agg = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") >= 600, "rich").otherwise("present")
    return table(spark, d, "supplier").join(agg, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("q", F.lit(0.0)).alias("quantity"), status.alias("status"))


@query("""SELECT p_partkey, p_name, p_type, coalesce(n, 0) AS n_suppliers, coalesce(m, 0) AS n_lines FROM part
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, count(*) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def entity_catalog(spark, d):
    agg = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"), F.count("*").alias("m"))
    return table(spark, d, "part").join(agg, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_name", "p_type", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.coalesce("m", F.lit(0)).alias("n_lines"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_by_key(spark, d):
    return pick_by_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_by_key(spark, d):
    return pick_by_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], last=True).select("user_id", "event_id", "event_type", "value")


@query("""SELECT coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id, a.doc_id IS NOT NULL AS has_text, b.doc_id IS NOT NULL AS has_label, c.doc_id IS NOT NULL AS has_vector
FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id FULL JOIN (SELECT vec_id AS doc_id FROM embeddings) c ON c.doc_id = coalesce(a.doc_id, b.doc_id)""")
def layer_presence(spark, d):
    layers = [("has_text", table(spark, d, "documents").select("doc_id")), ("has_label", table(spark, d, "labels").select("doc_id")), ("has_vector", table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))]
    out = reduce(lambda a, b: a.join(b, "doc_id", "full_outer"), [df.distinct().withColumn(name, F.lit(True)) for name, df in layers])
    return out.select("doc_id", *[F.coalesce(name, F.lit(False)).alias(name) for name, _ in layers])


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def semi_join_eligible(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("SELECT o_orderkey AS order_key, o_custkey AS cust_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_edges(spark, d):
    return anti_join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"))


@query("""SELECT 'customer_without_order' AS rule, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order_without_line', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'part_without_line', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'label_without_document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def ref_closure_violations(spark, d):
    rules = [("customer_without_order", "customer", "c_custkey", "orders", "o_custkey"), ("order_without_line", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("part_without_line", "part", "p_partkey", "lineitem", "l_partkey"), ("label_without_document", "labels", "doc_id", "documents", "doc_id")]
    return reduce(DataFrame.unionByName, [anti_join(table(spark, d, a), table(spark, d, b), k, o).select(F.lit(rule).alias("rule"), F.col(k).alias("id")) for rule, a, k, b, o in rules])


@query("""WITH h AS (SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1)
SELECT c.conv_id, h.turn AS hit, c.turn, abs(c.turn - h.turn) AS distance FROM conversations c JOIN h ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) <= 1""")
def sibling_window(spark, d):
    c = table(spark, d, "conversations")
    hits = c.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("hit"))
    return c.join(hits, "conv_id").where(F.abs(F.col("turn") - F.col("hit")) <= 1).select("conv_id", "hit", "turn", F.abs(F.col("turn") - F.col("hit")).alias("distance"))


@query("""SELECT event_id, user_id, value FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 25""")
def keyset_page(spark, d):
    """The page of 25 rows behind a cursor (time, id), newest first."""
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").where((ts < at) | ((ts == at) & (F.col("event_id") < 5000))).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "value")


STATS_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in STATS_TABLES))
def kb_stats(spark, d):
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in STATS_TABLES])


@query("SELECT p_type AS entity_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def entity_type_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("entity_type")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def status_pairs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS scope_type, coalesce(lang, source, 'all') AS scope_value,
count(*) AS total, sum(done)::BIGINT AS done, round(sum(done) * 100.0::DOUBLE / count(*), 2) AS percent
FROM (SELECT lang, source, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS done FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((), (lang), (source))""")
def progress_grouping_sets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    done = F.when(F.col("quality").isNull(), 0).otherwise(1)
    by = rows.select("lang", "source", done.alias("done")).groupingSets([(), ("lang",), ("source",)], "lang", "source")
    out = by.agg(F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.count("*").alias("total"), F.sum("done").alias("done"))
    scope = F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("overall")
    return out.select(scope.alias("scope_type"), F.coalesce("lang", "source", F.lit("all")).alias("scope_value"), "total", "done", F.round(F.col("done") * 100.0 / F.col("total"), 2).alias("percent"))


@query("""WITH g AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_brand) AS r FROM g)
SELECT g.l_suppkey AS supplier, sum(n)::BIGINT AS n_lines, count(*) AS n_brands, (SELECT string_agg(p_brand, ',' ORDER BY p_brand) FROM b WHERE b.l_suppkey = g.l_suppkey AND r <= 12) AS brands FROM g GROUP BY 1""")
def source_matrix(spark, d):
    g = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = F.sort_array(F.collect_set("p_brand"))
    return g.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n_lines"), F.countDistinct("p_brand").alias("n_brands"), F.array_join(F.slice(brands, 1, 12), ",").alias("brands"))


@query(f"""WITH e AS ({EDGES_SQL}), o AS (SELECT src AS node, string_agg(relation || ':' || dst, ',' ORDER BY relation || ':' || dst) AS outgoing FROM e GROUP BY 1),
i AS (SELECT dst AS node, string_agg(relation || ':' || src, ',' ORDER BY relation || ':' || src) AS incoming FROM e GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming FROM o FULL JOIN i ON o.node = i.node""")
def adjacency(spark, d):
    return adjacency_lists(place_edges(spark, d))


@query(f"WITH e AS ({EDGES_SQL}) SELECT 'out' AS direction, relation, dst AS peer FROM e WHERE src = 'nation:3' UNION ALL SELECT 'in', relation, src FROM e WHERE dst = 'nation:3'")
def graph_neighbors(spark, d):
    e = place_edges(spark, d)
    out = e.where("src = 'nation:3'").select(F.lit("out").alias("direction"), "relation", F.col("dst").alias("peer"))
    return out.unionByName(e.where("dst = 'nation:3'").select(F.lit("in").alias("direction"), "relation", F.col("src").alias("peer")))


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = 7) AS n_lines, (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 7)) AS brands,
(SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = 7) AS n_orders FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey = 7""")
def entity_360(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey = 7").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, d, "lineitem").where("l_suppkey = 7").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    agg = lines.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"), F.countDistinct("l_orderkey").alias("n_orders"))
    return s.join(agg, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "n_name", "n_lines", "brands", "n_orders")


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) AS n FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    """Nearest-rank percentiles, exact."""
    return nearest_ranks(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """group, a column for each share of the value at that nearest rank, and n, the number of values.

    Equal values are counted first. Counts of ranges of values, whose bounds come of a sketch, are summed before those
    inside a range, so a hot group is sorted in many tasks. Nulls do not count.
    """
    counts = settle(df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n")), "values")
    cuts = [F.lit(i / parts) for i in range(1, parts)]
    bounds = settle(counts.groupBy("g").agg(F.percentile_approx("v", F.array(*cuts), 1000).alias("cuts")), "bounds")
    dealt = counts.join(bounds.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    dealt = settle(dealt.select("g", "v", "n", "part"), "dealt")
    upto = lambda *order: Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("g", "part").agg(F.sum("n").alias("m")).withColumns({"before": F.coalesce(F.sum("m").over(upto("part")), F.lit(0)), "total": F.sum("m").over(Window.partitionBy("g"))})
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(whole.select(F.col("g").alias("_g"), F.col("part").alias("_p"), "before", "total"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
    low = F.col("before") + F.col("inside")
    at = lambda p: F.min(F.when((low < F.ceil(F.col("total") * p)) & (low + F.col("n") >= F.ceil(F.col("total") * p)), F.col("v")))
    return placed.groupBy(F.col("g").alias(group)).agg(*[at(p).alias(name) for name, p in shares.items()], F.sum("n").alias("n"))


@query("""SELECT source, count(*) AS documents, round(quantile_cont(n_chars::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 4) AS p95, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def batch_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.percentile("n_chars", 0.5), 4).alias("p50"), F.round(F.percentile("n_chars", 0.95), 4).alias("p95"), F.sum("n_chars").alias("chars"))


@query("""WITH r AS (SELECT doc_id % 97 AS unit, quality FROM labels) SELECT unit, CASE WHEN bool_or(quality = 0) THEN 'rejected' WHEN bool_and(quality = 1) AND count(*) >= 2 THEN 'approved' ELSE 'pending' END AS status, count(*) AS reviews FROM r GROUP BY 1""")
def semantic_status_rollup(spark, d):
    """Any rejection rejects; two reviews that all approve approve; else pending."""
    status = F.when(F.bool_or(F.col("quality") == 0), "rejected").when(F.bool_and(F.col("quality") == 1) & (F.count("*") >= 2), "approved").otherwise("pending")
    return table(spark, d, "labels").groupBy((F.col("doc_id") % 97).alias("unit")).agg(status.alias("status"), F.count("*").alias("reviews"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS prio FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type NOT IN ('error', 'view')) AS done, arg_min(event_id, prio * 1000000000 + event_id) AS next_item FROM e GROUP BY 1""")
def session_status(spark, d):
    e = F.col("event_type")
    prio = F.when(e == "error", 0).when(e == "view", 1).otherwise(2)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(e == "error").alias("blocked"), F.count_if(e == "view").alias("pending"), F.count_if(~e.isin("error", "view")).alias("done"), F.min_by("event_id", F.struct(prio, "event_id")).alias("next_item"))


@query("SELECT o_custkey AS subject, count(DISTINCT o_orderpriority) AS objects, count(*) AS rows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def approval_conflicts(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("subject")).agg(F.countDistinct("o_orderpriority").alias("objects"), F.count("*").alias("rows")).where("objects > 1")


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("""SELECT c_nationkey AS nation, c_mktsegment AS segment, n, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END, n DESC, c_nationkey, c_mktsegment) AS review_order
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)""")
def review_packets(spark, d):
    """A numbered queue of packets, one for each nation and segment; those for context only come last."""
    packets = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.when(F.col("segment") == "MACHINERY", 1).otherwise(0), F.desc("n"), "nation", "segment")
    return packets.withColumn("review_order", F.row_number().over(order).cast("long"))


@query("SELECT source, doc_id, ((r - 1) // 10 + 1)::BIGINT AS session, ((r - 1) % 10 + 1)::BIGINT AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)")
def session_queue(spark, d):
    ranked = rank_in_groups(table(spark, d, "documents").select("source", "n_chars", "doc_id"), "source", "n_chars", "doc_id")
    return ranked.select("source", "doc_id", F.expr("(r - 1) DIV 10 + 1").alias("session"), ((F.col("r") - 1) % 10 + 1).alias("place"))


def rank_in_groups(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """df with r, the row number in each group by value downwards, then tie.

    Counts of each value are summed first, so a window sees the rows of one value only; a hot group is spread by value.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(group).alias("_g"), F.col(value).alias("_v"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(group, value).orderBy(tie))
    placed = df.withColumn("_k", inner).join(before, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")))
    return placed.select(*df.columns, (F.col("_before") + F.col("_k")).alias("r"))


@query("SELECT source, doc_id, n_chars, r AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_group(spark, d):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", r.alias("rank")).where("rank <= 3").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT conv_id, turn, row_number() OVER w - 1 AS ordinal, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def chunk_prev_next(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS occurrence FROM part")
def path_occurrence(spark, d):
    w = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "part").select("p_partkey", "p_name", F.count("*").over(w).alias("occurrence"))


@query("""SELECT 'stale_order' AS kind, o_orderkey AS ref, 1000 + row_number() OVER (ORDER BY o_orderkey) AS task_order FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 10)
UNION ALL SELECT 'large_document', doc_id, 2000 + row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)""")
def task_board(spark, d):
    """Two lists of ten tasks under running order numbers."""
    a = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").orderBy("o_orderkey").limit(10).select(F.lit("stale_order").alias("kind"), F.col("o_orderkey").alias("ref"), (1000 + F.row_number().over(Window.orderBy("o_orderkey"))).cast("long").alias("task_order"))
    b = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10).select(F.lit("large_document").alias("kind"), F.col("doc_id").alias("ref"), (2000 + F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).cast("long").alias("task_order"))
    return a.unionByName(b)


@query("""SELECT 'missing' AS side, doc_id AS id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'unknown', id FROM (SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels)""")
def id_set_closure(spark, d):
    docs, labels, vec = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return docs.subtract(labels).select(F.lit("missing").alias("side"), "id").unionByName(vec.subtract(labels).select(F.lit("unknown").alias("side"), "id"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.s, b.s) AS supplier, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS preserved, count(*) FILTER (b.p IS NULL) AS missing, count(*) FILTER (a.p IS NULL) AS added FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p GROUP BY 1""")
def ref_preservation(spark, d):
    side = lambda flag, name: F.max(F.when(F.col("l_returnflag") == flag, 1).otherwise(0)).alias(name)
    pairs = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy("l_suppkey", "l_partkey").agg(side("A", "a"), side("R", "b"))
    return pairs.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("preserved"), F.count_if(F.col("b") == 0).alias("missing"), F.count_if(F.col("a") == 0).alias("added"))


@query("""WITH old AS (SELECT o_custkey AS id, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_custkey AS id, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(old.id, new.id) AS id, coalesce(new.v, old.v) AS value, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'kept' WHEN old.v = new.v THEN 'unchanged' ELSE 'replaced' END AS action FROM old FULL JOIN new ON old.id = new.id""")
def decision_merge(spark, d):
    """Upsert of one set of decisions into another: each customer's most urgent priority of finished and of pending orders."""
    decided = lambda status: table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("v"))
    return merge_rows(decided("F"), decided("P"))


def merge_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: id, v. The merged value of every id and what happened to it; new wins."""
    o, n = old.select(F.col("id").alias("oid"), F.col("v").alias("ov")), new.select(F.col("id").alias("nid"), F.col("v").alias("nv"))
    action = F.when(F.col("oid").isNull(), "added").when(F.col("nid").isNull(), "kept").when(F.col("ov") == F.col("nv"), "unchanged").otherwise("replaced")
    return o.join(n, F.col("oid") == F.col("nid"), "full_outer").select(F.coalesce("oid", "nid").alias("id"), F.coalesce("nv", "ov").alias("value"), action.alias("action"))


@query(f"""WITH RECURSIVE e AS ({EDGES_SQL}), t AS (SELECT 'region:1' AS node, 0 AS depth, 'region:1' AS path UNION ALL SELECT e.src, t.depth + 1, t.path || '>' || e.src FROM t JOIN e ON e.dst = t.node WHERE t.depth < 8) SELECT node, depth, path FROM t""")
def section_subtree(spark, d):
    return subtree(place_edges(spark, d), "region:1")


def subtree(edges: DataFrame, root: str) -> DataFrame:
    """node, depth and path of everything below a root (edges from child src to parent dst); a cycle is an error.

    One join a level until there is nothing below; each level is written, so plans stay short however deep the tree is.
    A node that is reached by several paths has a row for each.
    """
    spark = edges.sparkSession
    arcs = settle(edges.select("src", "dst").distinct(), "arcs")
    level = spark.createDataFrame([(root, 0, root)], "node string, depth int, path string")
    levels = [level]
    again = F.instr(F.concat(F.lit(">"), "path", F.lit(">")), F.concat(F.lit(">"), "src", F.lit(">"))) > 0
    while True:
        below = level.join(arcs, F.col("node") == F.col("dst"))
        below = below.select(F.when(again, F.raise_error(F.lit("cycle in the tree"))).otherwise(F.col("src")).alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws(">", "path", "src").alias("path"))
        level = settle(below, "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


@query(f"""WITH RECURSIVE e AS ({EDGES_SQL}), t AS (SELECT 'supplier:3' AS node, 0 AS depth UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node) SELECT node, depth FROM t""")
def downstream_closure(spark, d):
    e = place_edges(spark, d)
    return subtree(e.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst")), "supplier:3").select("node", "depth")


@query(f"""WITH e AS ({EDGES_SQL}) SELECT src, relation, dst, split_part(src, ':', 1) AS src_type, split_part(dst, ':', 1) AS dst_type,
(relation = 'located_in' AND split_part(src, ':', 1) = 'supplier' AND split_part(dst, ':', 1) = 'nation') OR (relation = 'part_of' AND split_part(src, ':', 1) = 'region' AND split_part(dst, ':', 1) = 'region') AS allowed FROM e""")
def edge_type_constraints(spark, d):
    """Edges against the pairs of types that their relation allows."""
    rules = spark.createDataFrame([("located_in", "supplier", "nation"), ("part_of", "region", "region")], "relation string, src_type string, dst_type string").withColumn("ok", F.lit(True))
    kind = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    e = place_edges(spark, d).withColumns({"src_type": kind("src"), "dst_type": kind("dst")})
    return e.join(F.broadcast(rules), ["relation", "src_type", "dst_type"], "left").select("src", "relation", "dst", "src_type", "dst_type", F.coalesce("ok", F.lit(False)).alias("allowed"))
