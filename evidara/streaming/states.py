"""Documents through their processing stages: retries, quarantine, interruption, and resumption by fingerprint.

One step function serves both forms. In batches a task reads its documents' events in order, a batch at a time, and holds
one document's state; as a stream that state is kept by document between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import query
from ..sources.tables import table

#: States in order, the end of failure, errors that are tried again, and errors that are not.
STATES = ("discovered", "preflighted", "parsed", "normalized", "validated", "approved")
QUARANTINED = "quarantined"
TRANSIENT = ("gpu_oom", "timeout", "transient_model_error")
FATAL = ("invalid_content", "schema_error", "governance_error")
ATTEMPTS = 2
FIELDS = "fingerprint string, state string, attempts long, transitions long, retries long, errors long, illegal long, ignored long, skipped long, interrupted boolean, last_seq long"


@dataclass
class Document:
    fingerprint: str | None = None
    state: str = STATES[0]
    attempts: int = 0
    transitions: int = 0
    retries: int = 0
    errors: int = 0
    illegal: int = 0
    ignored: int = 0
    skipped: int = 0
    interrupted: bool = False
    last_seq: int = -1

    @property
    def over(self) -> bool:
        return self.state in (STATES[-1], QUARANTINED)

    def step(self, seq: int, kind: str, stage: str | None, error: str | None, fingerprint: str | None, most: int = ATTEMPTS) -> None:
        """One event, once: events up to last_seq were seen.

        start: another fingerprint begins anew; the same one resumes what was interrupted, and skips what is over.
        done: the next state, if the stage is not named or is that one, else illegal. failed: a transient error is tried
        again until there were ``most`` attempts at the stage, then it is quarantined, as a fatal one is at once; any
        other error interrupts the document until it is started again. What comes when it is over or interrupted is ignored.
        """
        if seq <= self.last_seq:
            return
        if kind == "start" and fingerprint != self.fingerprint:
            self.__init__(fingerprint)
        elif kind == "start":
            self.skipped += self.over
            self.interrupted = False
        elif self.over or self.interrupted:
            self.ignored += 1
        elif kind == "done":
            then = STATES[STATES.index(self.state) + 1]
            if stage is not None and stage != then:
                self.illegal += 1
            else:
                self.state, self.attempts, self.transitions = then, 0, self.transitions + 1
        else:
            self.errors += 1
            self.attempts += 1
            if error in TRANSIENT and self.attempts < most:
                self.retries += 1
            elif error in TRANSIENT or error in FATAL:
                self.state, self.transitions = QUARANTINED, self.transitions + 1
            else:
                self.interrupted, self.attempts = True, 0
        self.last_seq = seq


def _text(x) -> str | None:
    return None if x is None or x != x else x


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    for doc, seq, kind, *rest in zip(*(batch[c] for c in ("doc", "seq", "kind", "stage", "error", "fingerprint")), strict=True):
        yield doc, int(seq), kind, *map(_text, rest)


def fold(events: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """The state of every document after all its events. events: doc, seq, kind, stage, error, fingerprint.

    Sorted by document and seq in each partition; a document with very many events costs one task their reading, not their
    keeping. Events with a null doc or seq, and repeated ones, count for nothing.
    """
    kind = events.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for doc, *event in _rows(batch):
                if state is None or doc != name:
                    if state is not None:
                        out.append((name, *astuple(state)))
                    name, state = doc, Document()
                state.step(*event, most=most)
            if out:
                yield _frame(out)
        if state is not None:
            yield _frame([(name, *astuple(state))])

    known = events.where("doc IS NOT NULL AND seq IS NOT NULL").select("doc", "seq", "kind", "stage", "error", "fingerprint")
    return known.repartition("doc").sortWithinPartitions("doc", "seq").mapInPandas(work, f"doc {kind}, {FIELDS}")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc", *(x.split()[0] for x in FIELDS.split(", "))])


def follow(events: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """The state of each document after each micro-batch that touches it; the row of largest last_seq is the latest."""
    kind = events.schema["doc"].dataType.simpleString()

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        document = Document(*state.get) if state.exists else Document()
        before = document.last_seq
        for _, *event in sorted((r for batch in batches for r in _rows(batch)), key=lambda r: r[1]):
            document.step(*event, most=most)
        state.update(astuple(document))
        if document.last_seq > before:
            yield _frame([(key[0], *astuple(document))])

    known = events.where("doc IS NOT NULL AND seq IS NOT NULL").select("doc", "seq", "kind", "stage", "error", "fingerprint")
    return known.groupBy("doc").applyInPandasWithState(work, f"doc {kind}, {FIELDS}", FIELDS, "append", GroupStateTimeout.NoTimeout)


def latest(states: DataFrame) -> DataFrame:
    names = [c for c in states.columns if c != "doc"]
    return states.groupBy("doc").agg(F.max_by(F.struct(*names), "last_seq").alias("s")).select("doc", "s.*")


def summary(states: DataFrame) -> DataFrame:
    """Documents of each state, and of all: how many, their retries, and the share that failed."""
    own = states.groupBy("state").agg(F.count("*").alias("n"), F.sum("retries").alias("retries"))
    every = states.agg(F.lit("all").alias("state"), F.count("*").alias("n"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.coalesce(F.round(F.avg(F.when(F.col("state") == QUARANTINED, 1.0).otherwise(0.0)), 6), F.lit(0.0)).alias("failed"))
    return own.withColumn("failed", F.lit(None).cast("double")).unionByName(every)


def stage_events(events: DataFrame) -> DataFrame:
    """The events table as stage events: users are documents, signups start them, errors fail, purchases name a stage."""
    k = F.col("event_id") % 5
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "failed").otherwise("done")
    error = F.element_at(F.array(*[F.lit(x) for x in (*TRANSIENT, FATAL[0], "unexpected_error")]), (k + 1).cast("int"))
    return events.select(
        F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_type") == "purchase", "validated").alias("stage"),
        F.when(F.col("event_type") == "error", error).alias("error"), F.when(F.col("event_type") == "signup", F.concat(F.lit("v"), (F.expr("event_id DIV 7") % 2).cast("string"))).alias("fingerprint"),
    )


_SQL = """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'done' END AS kind,
  CASE event_type WHEN 'purchase' THEN 4 END AS stage, event_id % 5 AS err, 'v' || event_id // 7 % 2 AS fp FROM events),
s AS (SELECT DISTINCT user_id AS doc, 0::BIGINT AS i, NULL::VARCHAR AS fp, 0 AS st, 0 AS att, 0 AS tr, 0 AS re, 0 AS er, 0 AS il, 0 AS ig, 0 AS sk, false AS it, -1::BIGINT AS seq FROM events
UNION ALL SELECT s.doc, e.i, CASE WHEN fresh THEN e.fp ELSE s.fp END, CASE WHEN fresh THEN 0 WHEN moves THEN st + 1 WHEN fails AND (err < 3 AND att + 1 >= 2 OR err = 3) THEN 6 ELSE st END,
  CASE WHEN fresh OR moves THEN 0 WHEN fails THEN CASE WHEN err = 4 THEN 0 ELSE att + 1 END ELSE att END, CASE WHEN fresh THEN 0 WHEN moves OR fails AND (err < 3 AND att + 1 >= 2 OR err = 3) THEN tr + 1 ELSE tr END,
  CASE WHEN fresh THEN 0 WHEN fails AND err < 3 AND att + 1 < 2 THEN re + 1 ELSE re END, CASE WHEN fresh THEN 0 WHEN fails THEN er + 1 ELSE er END, CASE WHEN fresh THEN 0 WHEN live AND kind = 'done' AND NOT moves THEN il + 1 ELSE il END,
  CASE WHEN fresh THEN 0 WHEN kind <> 'start' AND NOT live THEN ig + 1 ELSE ig END, CASE WHEN fresh THEN 0 WHEN kind = 'start' AND st >= 5 THEN sk + 1 ELSE sk END, CASE WHEN kind = 'start' THEN false WHEN fails AND err = 4 THEN true ELSE it END, e.seq
  FROM (SELECT s.*, e.i AS j, e.kind = 'start' AND e.fp IS DISTINCT FROM s.fp AS fresh, st < 5 AND NOT it AS live, st < 5 AND NOT it AND e.kind = 'done' AND coalesce(e.stage = st + 1, true) AS moves, st < 5 AND NOT it AND e.kind = 'failed' AS fails FROM s JOIN e ON e.doc = s.doc AND e.i = s.i + 1) s JOIN e ON e.doc = s.doc AND e.i = s.j)
SELECT doc, fp AS fingerprint, ['discovered', 'preflighted', 'parsed', 'normalized', 'validated', 'approved', 'quarantined'][st + 1] AS state, att AS attempts, tr AS transitions, re AS retries, er AS errors, il AS illegal, ig AS ignored, sk AS skipped, it AS interrupted, seq AS last_seq FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY i DESC) = 1"""


@query(_SQL)
def document_states(spark, d):
    """Where every document of the event table stands."""
    return fold(stage_events(table(spark, d, "events")))
