"""Human review: checks of what reviewers hand in, progress of their sessions, and what their decisions would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table

# Columns of the input, decisions, and states of a queue in the order in which they come up.
COLUMNS = ("entity_id", "review_decision", "reviewer", "reviewed_at", "decision_note")
DECISIONS = ("unreviewed", "approved", "rejected", "needs_source", "needs_semantic_review")
QUEUE = ("awaiting_human_review", "ready_to_apply", "manual_followup", "blocked_by_llm")
CHECKS = (
    ("input_file_exists", "error"), ("required_columns", "error"), ("duplicate_entity_id", "error"), ("missing_entity_id", "error"),
    ("known_entity_id", "error"), ("allowed_review_decision", "error"), ("semantic_review_boundary", "warning"), ("ready_to_apply_preview", "info"),
)
RESULT = "check_order int, check_type string, severity string, checked_count long, issue_count long, entities long, first_row long"


def validate_input(decisions: DataFrame | None, entities: DataFrame) -> DataFrame:
    """The eight checks in order: check_order, check_type, severity, status, checked_count, issue_count, entities, first_row.

    decisions: the columns of the input and row_number, or None if there is no file; entities: entity_id. Blank values count as
    none, rows of nothing but these are left out. Without the file, or a column of it, only the first two checks are made.
    entities and first_row say how many different entities, and which row first, a check is about.
    """
    spark = entities.sparkSession
    lacking = [c for c in COLUMNS if decisions is None or c not in decisions.columns]
    opening = [(1, *CHECKS[0], 1, int(decisions is None), 0, 0 if decisions is None else None), (2, *CHECKS[1], len(COLUMNS), len(lacking), len(lacking), 1 if lacking else None)]
    status = F.when(F.col("issue_count") == 0, "pass").when(F.col("severity") == "error", "fail").when(F.col("severity") == "warning", "warning").otherwise("info")
    columns = ["check_order", "check_type", "severity", status.alias("status"), "checked_count", "issue_count", "entities", "first_row"]
    first = spark.createDataFrame(opening[: 2 if decisions is not None else 1], RESULT)
    if lacking:
        return first.select(*columns)
    said = decisions.select(F.col("row_number").cast("long").alias("row_number"), *[F.btrim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS])
    rows = said.where(" OR ".join(f"{c} <> ''" for c in COLUMNS))
    # One pass gives a row for each entity and decision, which all six checks are taken from.
    held = settle(rows.groupBy("entity_id", "review_decision").agg(F.count("*").alias("n"), F.min("row_number").alias("row")), "decisions")
    named = held.where("entity_id <> ''").groupBy("entity_id").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    known = entities.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    every = F.sum("n")

    def found(order: int, issues: DataFrame, checked: str) -> DataFrame:
        issue = issues.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"), F.countDistinct(F.when(F.col("entity_id") != "", F.col("entity_id"))).alias("entities"), F.min("row").alias("first_row"))
        total = held.where(checked).agg(F.coalesce(every, F.lit(0)).alias("checked_count"))
        return total.join(issue).select(F.lit(order).alias("check_order"), F.lit(CHECKS[order - 1][0]).alias("check_type"), F.lit(CHECKS[order - 1][1]).alias("severity"), "checked_count", "issue_count", "entities", "first_row")

    out = first
    for order, issues, checked in (
        (3, named.where("n > 1"), "true"), (4, held.where("entity_id = ''"), "true"), (5, named.join(known, "entity_id", "left_anti"), "entity_id <> ''"),
        (6, held.where(~F.col("review_decision").isin("", *DECISIONS)), "true"), (7, held.where("review_decision = 'needs_semantic_review'"), "true"), (8, held.where(F.col("review_decision").isin("approved", "rejected")), "true"),
    ):
        out = out.unionByName(found(order, issues, checked))
    return out.select(*columns)


def session_rollup(queue: DataFrame) -> DataFrame:
    """session_id, item_count, a count for each state and decision, completion_percent, the next entity, needs_llm_count.

    queue: session_id, place, entity_id, queue_status, review_decision, needs_llm. Next is the first by state, then by place
    and entity; "none" if no item waits. Counted before the shuffle, so a session of any size is one row a task.
    """
    at = F.array_position(F.array(*[F.lit(x) for x in QUEUE]), F.col("queue_status"))
    after = F.min(F.when(at > 0, F.struct(at.alias("at"), "place", "entity_id")))
    of = lambda column, name: F.count_if(F.col(column) == name).alias(f"{name}_count")
    done = F.count_if(F.col("review_decision").isin("approved", "rejected"))
    return queue.groupBy("session_id").agg(
        F.count("*").alias("item_count"), *[of("queue_status", x) for x in QUEUE], *[of("review_decision", x) for x in DECISIONS], F.round(done * 100 / F.count("*"), 2).alias("completion_percent"),
        F.coalesce(after["entity_id"], F.lit("none")).alias("next_entity_id"), F.count_if(F.coalesce("needs_llm", F.lit(False))).alias("needs_llm_count"),
    )


def apply_preview(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """entity_id, before, after, action of every entity. entities: entity_id, review_status. decisions: entity_id, review_decision.

    An approved or rejected entity takes that status if its decisions agree and it has not got it: apply. Decisions that
    differ are a conflict, needs_source and needs_semantic_review wait, all others keep. Decisions on unknown entities are
    rows of their own, without before and after: unknown.
    """
    own = decisions.where(F.coalesce("entity_id", F.lit("")) != "").groupBy("entity_id").agg(F.min("review_decision").alias("low"), F.max("review_decision").alias("high"))
    both = entities.join(own.withColumnRenamed("entity_id", "_e"), F.col("entity_id") == F.col("_e"), "full_outer")
    settled = F.col("low").isin("approved", "rejected")
    action = (
        F.when(F.col("entity_id").isNull(), "unknown").when(F.col("low") != F.col("high"), "conflict").when(F.col("low").isin("needs_source", "needs_semantic_review"), "wait")
        .when(settled & ~F.col("review_status").eqNullSafe(F.col("low")), "apply").otherwise("keep")
    )
    after = F.when(F.col("action") == "apply", F.col("low")).otherwise(F.col("before"))
    return both.select(F.coalesce("entity_id", "_e").alias("entity_id"), F.col("review_status").alias("before"), action.alias("action"), "low").select("entity_id", "before", after.alias("after"), "action")


def _handed_in(spark, d) -> DataFrame:
    """Events as rows that reviewers hand in: users are entities, some rows without one."""
    kind = F.col("event_type")
    decision = F.when(kind == "view", " approved ").when(kind == "click", "rejected").when(kind == "error", "needs_semantic_review").when(kind == "signup", "").otherwise("maybe")
    entity = F.when(F.col("event_id") % 11 == 0, " ").otherwise((F.col("user_id") * 7 + F.col("event_id") % 3).cast("string"))
    return table(spark, d, "events").select((F.col("event_id") + 2).alias("row_number"), entity.alias("entity_id"), decision.alias("review_decision"), F.lit("r").alias("reviewer"), F.col("ts").alias("reviewed_at"), F.lit(None).cast("string").alias("decision_note"))


_IN = """r AS (SELECT event_id + 2 AS row_number, CASE WHEN event_id % 11 = 0 THEN '' ELSE (user_id * 7 + event_id % 3)::VARCHAR END AS e, CASE event_type WHEN 'view' THEN 'approved' WHEN 'click' THEN 'rejected' WHEN 'error' THEN 'needs_semantic_review' WHEN 'signup' THEN '' ELSE 'maybe' END AS d FROM events)"""


@query(f"""WITH {_IN}, k AS (SELECT 3 AS o, 'duplicate_entity_id' AS t, 'error' AS s, r.*, e <> '' AND count(*) OVER (PARTITION BY e) > 1 AS bad, true AS c FROM r UNION ALL SELECT 4, 'missing_entity_id', 'error', r.*, e = '', true FROM r
UNION ALL SELECT 5, 'known_entity_id', 'error', r.*, e <> '' AND e NOT IN (SELECT c_custkey::VARCHAR FROM customer), e <> '' FROM r UNION ALL SELECT 6, 'allowed_review_decision', 'error', r.*, d = 'maybe', true FROM r
UNION ALL SELECT 7, 'semantic_review_boundary', 'warning', r.*, d = 'needs_semantic_review', true FROM r UNION ALL SELECT 8, 'ready_to_apply_preview', 'info', r.*, d IN ('approved', 'rejected'), true FROM r)
SELECT o AS check_order, t AS check_type, s AS severity, CASE WHEN count(*) FILTER (bad) = 0 THEN 'pass' WHEN s = 'error' THEN 'fail' ELSE s END AS status, count(*) FILTER (c) AS checked_count, count(*) FILTER (bad) AS issue_count, count(DISTINCT e) FILTER (bad AND e <> '') AS entities, min(row_number) FILTER (bad) AS first_row FROM k GROUP BY o, t, s
UNION ALL VALUES (1, 'input_file_exists', 'error', 'pass', 1, 0, 0, NULL), (2, 'required_columns', 'error', 'pass', 5, 0, 0, NULL)""")
def review_input_checks(spark, d):
    """All eight checks of the decisions handed in."""
    return validate_input(_handed_in(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id")))


@query("""WITH q AS (SELECT user_id AS session_id, event_id AS place, 'e' || event_id AS entity_id, ['awaiting_human_review', 'ready_to_apply', 'manual_followup', 'blocked_by_llm', 'done'][event_id % 5 + 1] AS s, ['unreviewed', 'approved', 'rejected', 'needs_source', 'needs_semantic_review'][event_id // 5 % 5 + 1] AS d, event_type = 'error' AS l FROM events)
SELECT session_id, count(*) AS item_count, count(*) FILTER (s = 'awaiting_human_review') AS awaiting_human_review_count, count(*) FILTER (s = 'ready_to_apply') AS ready_to_apply_count, count(*) FILTER (s = 'manual_followup') AS manual_followup_count, count(*) FILTER (s = 'blocked_by_llm') AS blocked_by_llm_count,
count(*) FILTER (d = 'unreviewed') AS unreviewed_count, count(*) FILTER (d = 'approved') AS approved_count, count(*) FILTER (d = 'rejected') AS rejected_count, count(*) FILTER (d = 'needs_source') AS needs_source_count, count(*) FILTER (d = 'needs_semantic_review') AS needs_semantic_review_count,
round(count(*) FILTER (d IN ('approved', 'rejected')) * 100 / count(*), 2) AS completion_percent, coalesce(first(entity_id ORDER BY list_position(['awaiting_human_review', 'ready_to_apply', 'manual_followup', 'blocked_by_llm'], s), place) FILTER (s <> 'done'), 'none') AS next_entity_id, count(*) FILTER (l) AS needs_llm_count FROM q GROUP BY 1""")
def session_rollups(spark, d):
    """Where every session stands, with all ten counts and its next item."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    e = table(spark, d, "events")
    queue = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("place"), F.concat(F.lit("e"), "event_id").alias("entity_id"), pick([*QUEUE, "done"], F.col("event_id") % 5).alias("queue_status"), pick(DECISIONS, F.expr("event_id DIV 5") % 5).alias("review_decision"), (F.col("event_type") == "error").alias("needs_llm"))
    return session_rollup(queue)


@query(f"""WITH {_IN}, o AS (SELECT e, min(d) AS low, max(d) AS high FROM r WHERE e <> '' GROUP BY e), b AS (SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' END AS before FROM customer),
j AS (SELECT coalesce(id, e) AS entity_id, before, CASE WHEN id IS NULL THEN 'unknown' WHEN low <> high THEN 'conflict' WHEN low IN ('needs_source', 'needs_semantic_review') THEN 'wait' WHEN low IN ('approved', 'rejected') AND before IS DISTINCT FROM low THEN 'apply' ELSE 'keep' END AS action, low FROM b FULL JOIN o ON id = e)
SELECT entity_id, before, CASE action WHEN 'apply' THEN low ELSE before END AS after, action FROM j""")
def decisions_applied(spark, d):
    """What the decisions handed in change of every customer's status."""
    status = F.when(F.col("c_custkey") % 3 == 0, "approved").when(F.col("c_custkey") % 3 == 1, "pending")
    entities = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), status.alias("review_status"))
    rows = _handed_in(spark, d).select(F.btrim("entity_id").alias("entity_id"), F.btrim("review_decision").alias("review_decision"))
    return apply_preview(entities, rows)
