"""Eligibility, governance states, review and lifecycle datasets, quality gates and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def first_match(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = (F if out is None else out).when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def states(spark, d) -> DataFrame:
    """Governance states of every document: quality and toxicity labels stand for review, the source for trust."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    k = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 5
    return rows.select(
        "doc_id", "source", F.when(F.col("n_chars") >= 20, "parsed").otherwise("failed").alias("parse_status"),
        first_match([(F.col("quality") == 1, "approved"), (F.col("quality") == 0, "rejected")], "approved").alias("content_quality"),
        F.get(F.array(*[F.lit(x) for x in ("trusted", "trusted_with_caution", "pending", "unknown", "untrusted")]), k).alias("source_trust"),
        first_match([(F.col("quality") == 1, "approved"), (F.col("quality") == 0, "rejected")], "pending").alias("semantic_review"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("isolated"),
        F.concat(F.lit("snapshot_"), F.when(F.col("doc_id") % 23 == 0, "none").otherwise(F.sha2(F.col("source").cast("binary"), 256))).alias("snapshot_id"), F.when(F.col("doc_id") % 3 == 0, "internal").otherwise("web").alias("source_type"),
    )


_STATES = """st AS (SELECT d.doc_id, source, CASE WHEN n_chars >= 20 THEN 'parsed' ELSE 'failed' END AS parse_status, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'approved' END AS content_quality,
CASE regexp_extract(source, '([0-9]+)$', 1)::INT % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'trusted_with_caution' WHEN 2 THEN 'pending' WHEN 3 THEN 'unknown' ELSE 'untrusted' END AS source_trust,
CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS semantic_review, coalesce(toxic = 1, false) AS isolated,
'snapshot_' || CASE WHEN d.doc_id % 23 = 0 THEN 'none' ELSE sha256(source) END AS snapshot_id, CASE WHEN d.doc_id % 3 = 0 THEN 'internal' ELSE 'web' END AS source_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def eligibility_rules(purpose: str = "answer") -> list[tuple[Column, str, str]]:
    """Condition, status and rule name, in the policy's order."""
    if purpose not in ("answer", "knowledge_fact"):
        raise ValueError(f"unknown purpose {purpose}")
    c = F.col
    return [
        (c("source").isNull() | (c("source") == "") | ~F.coalesce(c("snapshot_id").rlike("^snapshot_[0-9a-f]{64}$"), F.lit(False)), "ineligible", "missing_source"),
        (c("isolated"), "ineligible", "isolated"),
        (c("parse_status") != "parsed", "ineligible", "not_parsed"),
        (c("content_quality") != "approved", "ineligible", "content_not_approved"),
        (c("source_trust") == "untrusted", "ineligible", "untrusted_source"),
        (c("semantic_review") == "rejected", "ineligible", "semantic_rejected"),
        (F.lit(purpose == "knowledge_fact") & (c("semantic_review") != "approved"), "ineligible", "fact_not_approved"),
        ((c("source_type") == "internal") & c("source_trust").isin("pending", "unknown"), "ineligible", "internal_not_confirmed"),
        ((c("source_trust") == "trusted") & (c("semantic_review") == "approved"), "eligible", "trusted_approved"),
        (c("source_trust").isin("trusted", "trusted_with_caution", "pending", "unknown") & c("semantic_review").isin("approved", "pending", "unknown"), "eligible_with_caution", "caution"),
    ]


def decide_eligibility(rows: DataFrame, purpose: str = "answer") -> DataFrame:
    rules = eligibility_rules(purpose)
    return rows.select("doc_id", "source", first_match([(c, s) for c, s, _ in rules], "ineligible").alias("status"), first_match([(c, r) for c, _, r in rules], "default").alias("rule_id"))


_ELIGIBLE = f"""{_STATES}, el AS (SELECT doc_id, source, CASE WHEN coalesce(source, '') = '' OR NOT regexp_full_match(snapshot_id, 'snapshot_[0-9a-f]{{64}}') THEN 'missing_source' WHEN isolated THEN 'isolated' WHEN parse_status <> 'parsed' THEN 'not_parsed' WHEN content_quality <> 'approved' THEN 'content_not_approved' WHEN source_trust = 'untrusted' THEN 'untrusted_source' WHEN semantic_review = 'rejected' THEN 'semantic_rejected' WHEN source_type = 'internal' AND source_trust IN ('pending', 'unknown') THEN 'internal_not_confirmed'
WHEN source_trust = 'trusted' AND semantic_review = 'approved' THEN 'trusted_approved' ELSE 'caution' END AS rule_id FROM st)"""
_STATUS = "CASE rule_id WHEN 'trusted_approved' THEN 'eligible' WHEN 'caution' THEN 'eligible_with_caution' ELSE 'ineligible' END"


@query(f"WITH {_ELIGIBLE} SELECT doc_id, source, {_STATUS} AS status, rule_id FROM el")
def retrieval_eligibility(spark, d):
    return decide_eligibility(states(spark, d))


@query(f"WITH {_ELIGIBLE} SELECT rule_id, count(*) AS n, min(doc_id) AS first FROM el WHERE {_STATUS} = 'ineligible' GROUP BY 1")
def excluded_by_policy(spark, d):
    return decide_eligibility(states(spark, d)).where("status = 'ineligible'").groupBy("rule_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def migrate_trust(review: Column, level: Column) -> Column:
    """Source trust from an older review status and trust level; null review means no record."""
    return first_match([
        (review.isNull(), "unknown"), (review.isin("pending", "unreviewed", "needs_source", "pending_review"), "pending"), ((review == "rejected") | ((review == "approved") & (level == "low")), "untrusted"),
        ((review == "approved") & level.isin("high", "internal"), "trusted"), ((review == "approved") & (level == "medium"), "trusted_with_caution"),
    ], "unknown")


@query("""SELECT o_orderkey AS record, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending_review' ELSE 'unknown' END AS content_quality,
CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'untrusted' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'trusted' WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'trusted_with_caution' ELSE 'unknown' END AS source_trust FROM orders""")
def governance_migration(spark, d):
    review = first_match([(F.col("o_orderstatus") == "F", "approved"), (F.col("o_orderstatus") == "P", "pending")], "other")
    level = first_match([(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high"), (F.col("o_orderpriority") == "3-MEDIUM", "medium"), (F.col("o_orderpriority") == "5-LOW", "low")], "none")
    content = first_match([(review == "approved", "approved"), (review == "pending", "pending_review")], "unknown")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), content.alias("content_quality"), migrate_trust(review, level).alias("source_trust"))


@query("""SELECT p_partkey AS source_id, coalesce(n, 0) AS evidence, CASE WHEN n IS NULL THEN 'acquire' WHEN n < 20 THEN 'extend' ELSE 'watch' END AS action FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(n, 0) < 25""")
def gap_queue(spark, d):
    agg = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, d, "part").join(agg, F.col("l_partkey") == F.col("p_partkey"), "left").where(n < 25).select(F.col("p_partkey").alias("source_id"), n.alias("evidence"), first_match([(F.col("n").isNull(), "acquire"), (n < 20, "extend")], "watch").alias("action"))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check_id, status, violations: how many rows break each rule, in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.check_id", "x.violations", F.when(F.col("x.violations") == 0, "pass").otherwise("fail").alias("status"))


@query("""WITH v AS (SELECT 'missing_id' AS check_id, count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders UNION ALL SELECT 'bad_status', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders UNION ALL SELECT 'no_price', count(*) FILTER (o_totalprice <= 0) FROM orders UNION ALL SELECT 'future', count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01 00:00:00') FROM orders)
SELECT check_id, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM v""")
def input_validation(spark, d):
    rules = {"missing_id": F.col("o_orderkey").isNull(), "bad_status": ~F.col("o_orderstatus").isin("O", "F"), "no_price": F.col("o_totalprice") <= 0, "future": F.col("o_orderdate").cast("timestamp_ntz") > F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")}
    return check_rules(table(spark, d, "orders"), rules)


@query("""SELECT e.event_id, CASE WHEN e.event_type = 'view' THEN 'no_op' WHEN c.c_custkey IS NULL THEN 'blocked_invalid_entity' WHEN e.event_type = 'error' THEN 'manual_followup' WHEN e.event_type = 'click' THEN 'blocked_by_llm' ELSE 'ready_to_apply' END AS decision,
e.event_type IN ('signup', 'purchase') AND c.c_custkey IS NOT NULL AND e.value < 50 AS can_apply FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 11""")
def decision_audit(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    e = table(spark, d, "events").join(c, F.col("c_custkey") == F.col("user_id") * 11, "left")
    kind = F.col("event_type")
    decision = first_match([(kind == "view", "no_op"), (F.col("c_custkey").isNull(), "blocked_invalid_entity"), (kind == "error", "manual_followup"), (kind == "click", "blocked_by_llm")], "ready_to_apply")
    return e.select("event_id", decision.alias("decision"), (kind.isin("signup", "purchase") & F.col("c_custkey").isNotNull() & (F.col("value") < 50)).alias("can_apply"))


@query("SELECT p_name AS term, min(p_type) AS category, coalesce(nullif(min(p_brand), ''), 'none') AS definition, count(*) AS entries FROM part GROUP BY 1")
def glossary(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("category"), F.coalesce(F.nullif(F.min("p_brand"), F.lit("")), F.lit("none")).alias("definition"), F.count("*").alias("entries"))


@query("""SELECT c_custkey AS entity, CASE WHEN c_acctbal > 5000 AND n > 0 THEN 'approved' WHEN c_acctbal > 5000 THEN 'reviewed' WHEN c_acctbal < 0 THEN 'deprecated' WHEN n > 0 THEN 'candidate' ELSE 'draft' END AS lifecycle, coalesce(c_acctbal < 0 AND n > 0, false) AS still_referenced
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lifecycle(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b, seen = F.col("c_acctbal"), F.col("n") > 0
    stage = first_match([((b > 5000) & seen, "approved"), (b > 5000, "reviewed"), (b < 0, "deprecated"), (seen, "candidate")], "draft")
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("entity"), stage.alias("lifecycle"), F.coalesce((b < 0) & seen, F.lit(False)).alias("still_referenced"))


@query("""WITH f AS (SELECT 'no_evidence' AS rule_id, 'blocker' AS severity, o_orderkey AS subject FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'late_line', 'warning', l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'heavy_discount', 'info', l_orderkey FROM lineitem WHERE l_discount >= 0.1)
SELECT rule_id, severity, subject, count(*) AS findings FROM f GROUP BY 1, 2, 3""")
def semantic_findings(spark, d):
    """Findings of three rules, counted by subject."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_discount")
    found = lambda df, rule, severity, key: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(key).alias("subject"))
    every = [
        found(o.join(lines.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "no_evidence", "blocker", "o_orderkey"),
        found(lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate"), "late_line", "warning", "l_orderkey"),
        found(lines.where("l_discount >= 0.1"), "heavy_discount", "info", "l_orderkey"),
    ]
    return reduce(DataFrame.unionByName, every).groupBy("rule_id", "severity", "subject").agg(F.count("*").alias("findings"))


@query("""WITH c AS (SELECT l_partkey AS subject, l_suppkey AS object, count(*) AS votes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), g AS (SELECT subject, count(*) AS objects FROM c GROUP BY 1)
SELECT c.subject, c.object, c.votes, sha256(c.subject || '|supplied_by|' || c.object) AS fingerprint, CASE WHEN g.objects > 20 THEN 'blocked_conflict' WHEN c.votes >= 2 THEN 'ready' ELSE 'pending' END AS decision FROM c JOIN g ON g.subject = c.subject""")
def knowledge_candidate_audit(spark, d):
    """Candidate facts; a subject with too many objects blocks all of its facts."""
    c = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object")).agg(F.count("*").alias("votes"))
    g = c.groupBy("subject").agg(F.count("*").alias("objects"))
    mark = F.sha2(F.concat_ws("|", F.col("subject").cast("string"), F.lit("supplied_by"), F.col("object").cast("string")).cast("binary"), 256)
    return c.join(g, "subject").select("subject", "object", "votes", mark.alias("fingerprint"), first_match([(F.col("objects") > 20, "blocked_conflict"), (F.col("votes") >= 2, "ready")], "pending").alias("decision"))


# Metric, comparison and threshold of a release.
GATES = [("exact_duplicate_rate", "<=", 0.02), ("labelled_share", ">=", 0.30), ("empty_texts", "<=", 0.0), ("mean_chars", ">=", 100.0), ("recall_at_8", ">=", 0.80)]


def evaluate_gates(metrics: DataFrame, gates: list[tuple[str, str, float]]) -> DataFrame:
    """metric, value, threshold, passed; a metric that is missing fails."""
    rules = metrics.sparkSession.createDataFrame(gates, "metric string, comparison string, threshold double")
    ok = F.when(F.col("comparison") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rules.join(metrics, "metric", "left").select("metric", "value", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


@query("""WITH m AS (SELECT 'exact_duplicate_rate' AS metric, round((count(*) - count(DISTINCT sha256(text)))::DOUBLE / count(*), 6) AS value FROM documents UNION ALL SELECT 'labelled_share', round((SELECT count(*) FROM labels)::DOUBLE / count(*), 6) FROM documents
UNION ALL SELECT 'empty_texts', (count(*) FILTER (text = ''))::DOUBLE FROM documents UNION ALL SELECT 'mean_chars', round(avg(n_chars), 4) FROM documents),
g(metric, comparison, threshold) AS (VALUES ('exact_duplicate_rate', '<=', 0.02::DOUBLE), ('labelled_share', '>=', 0.30), ('empty_texts', '<=', 0.0), ('mean_chars', '>=', 100.0), ('recall_at_8', '>=', 0.80))
SELECT g.metric, m.value, g.threshold, coalesce(CASE WHEN comparison = '<=' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM g LEFT JOIN m ON m.metric = g.metric""")
def quality_gate(spark, d):
    docs = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), (F.col("text") == "").alias("empty"), "n_chars")
    by = docs.groupBy("h").agg(F.count("*").alias("n"), F.count_if("empty").alias("e"), F.sum("n_chars").alias("c"))
    one = by.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("e").alias("e"), F.sum("c").alias("c")).join(table(spark, d, "labels").agg(F.count("*").alias("labels")))
    values = {"exact_duplicate_rate": F.round((F.col("n") - F.col("k")) / F.col("n"), 6), "labelled_share": F.round(F.col("labels") / F.col("n"), 6), "empty_texts": F.col("e").cast("double"), "mean_chars": F.round(F.col("c") / F.col("n"), 4)}
    return evaluate_gates(one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("m")).select("m.metric", "m.value"), GATES)


@query("SELECT source, count(*) AS entries, bit_xor(('0x' || substring(sha256('{\"doc_id\":' || doc_id || ',\"text_hash\":\"' || sha256(text) || '\"}'), 1, 15))::BIGINT) AS digest FROM documents GROUP BY 1")
def retrieval_input_manifest(spark, d):
    """An order-free digest of each source's canonical entries, combined before the shuffle."""
    entry = F.to_json(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")))
    part = F.conv(F.substring(F.sha2(entry.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.bit_xor(part).alias("digest"))


@query()
def governance_dataset_manifest(spark, d):
    """Rows, record ids and content hash of the generic payload form of several datasets."""
    sets = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "labels": "doc_id"}
    parts = []
    for name, key in sets.items():
        df = table(spark, d, name)
        payload = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        parts.append(df.select(F.lit(name).alias("dataset"), F.coalesce(F.col(key).cast("string"), F.sha2(payload.cast("binary"), 256)).alias("record_id"), F.xxhash64(payload).alias("h")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("dataset").agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("records"), F.bit_xor("h").alias("content_hash"))
