import pytest

from evidara.operators import review

SCHEMA = "row_number long, entity_id string, review_decision string, reviewer string, reviewed_at string, decision_note string"


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")


def checks(spark, entities, *rows):
    df = spark.createDataFrame([(i + 2, *r, None, None, None) for i, r in enumerate(rows)], SCHEMA)
    return {r["check_type"]: (r["status"], r["checked_count"], r["issue_count"], r["entities"], r["first_row"]) for r in review.validate_input(df, entities).collect()}


def test_eight_checks(spark, entities):
    got = checks(spark, entities, ("a", "approved"), (None, " "), (" a", "rejected"), ("z", "needs_semantic_review"), ("", "unreviewed"), ("b", "perhaps"), ("c", None))
    assert got == {
        "input_file_exists": ("pass", 1, 0, 0, None), "required_columns": ("pass", 5, 0, 0, None), "duplicate_entity_id": ("fail", 6, 2, 1, 2), "missing_entity_id": ("fail", 6, 1, 0, 6),
        "known_entity_id": ("fail", 5, 1, 1, 5), "allowed_review_decision": ("fail", 6, 1, 1, 7), "semantic_review_boundary": ("warning", 6, 1, 1, 5), "ready_to_apply_preview": ("info", 6, 2, 1, 2),
    }
    assert {v[0] for v in checks(spark, entities).values()} == {"pass"}


def test_without_a_file_or_a_column(spark, entities):
    assert [(r["check_type"], r["status"]) for r in review.validate_input(None, entities).collect()] == [("input_file_exists", "fail")]
    df = spark.createDataFrame([(2, "a")], "row_number long, entity_id string")
    assert [(r["check_order"], r["status"], r["issue_count"]) for r in review.validate_input(df, entities).orderBy("check_order").collect()] == [(1, "pass", 0), (2, "fail", 4)]


def test_sessions(spark):
    rows = [("s", 3, "e3", "ready_to_apply", "approved", True), ("s", 2, "e2", "manual_followup", "rejected", None), ("s", 5, "e5", "ready_to_apply", "unreviewed", False), ("t", 1, "e1", "done", "needs_source", False)]
    got = {r["session_id"]: r for r in review.session_rollup(spark.createDataFrame(rows, "session_id string, place int, entity_id string, queue_status string, review_decision string, needs_llm boolean")).collect()}
    assert (got["s"]["item_count"], got["s"]["ready_to_apply_count"], got["s"]["completion_percent"], got["s"]["next_entity_id"], got["s"]["needs_llm_count"]) == (3, 2, 66.67, "e3", 1)
    assert (got["t"]["next_entity_id"], got["t"]["needs_source_count"], got["t"]["completion_percent"]) == ("none", 1, 0.0)


def test_what_decisions_change(spark):
    entities = spark.createDataFrame([("a", "pending"), ("b", "approved"), ("c", None), ("d", "pending"), ("e", "pending")], "entity_id string, review_status string")
    decisions = spark.createDataFrame([("a", "approved"), ("a", "approved"), ("b", "approved"), ("c", "rejected"), ("d", "approved"), ("d", "rejected"), ("x", "approved"), (None, "approved"), ("e", "needs_source")], "entity_id string, review_decision string")
    got = {r["entity_id"]: (r["after"], r["action"]) for r in review.apply_preview(entities, decisions).collect()}
    assert got == {"a": ("approved", "apply"), "b": ("approved", "keep"), "c": ("rejected", "apply"), "d": ("pending", "conflict"), "e": ("pending", "wait"), "x": (None, "unknown")}
