"""Cleaning rules as edits: what each rule changed, where that lay in the source, and one set of edits for all of them.

A rule finds spans of the text as it is when its turn comes. A map of pieces, each verbatim or replaced, leads from there
to the source; it is kept through all rules, so an edit of a late rule has the source span of whatever earlier rules made
of it. Lossless rules apply at once, structural ones are for review, semantic ones are refused and only reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table

LOSSLESS, STRUCTURAL, SEMANTIC = "lossless", "structural", "semantic"
LOG = "array<struct<rule:string,level:string,start:int,end:int,source_start:int,source_end:int,before:string,after:string>>"
NET = "array<struct<start:int,end:int,after:string>>"


@dataclass(frozen=True)
class Rule:
    """Spans of a pattern become what put says of the match; a rule without a pattern removes the lines it is given."""

    name: str
    level: str
    find: str | None = None
    put: str | Callable[[str], str] = ""


RULES = (
    Rule("line_ends", LOSSLESS, r"\r\n?", "\n"),
    # Combining marks may join the ASCII letter before them.
    Rule("nfkc", LOSSLESS, r"[\x00-\x7f]?[^\x00-\x7f]+", lambda s: unicodedata.normalize("NFKC", s)),
    Rule("spaces", LOSSLESS, r"[ \t]+", " "),
    Rule("line_edges", LOSSLESS, r"(?m)^ | $"),
    Rule("blank_lines", LOSSLESS, r"\A\n+|\n+\Z|(?<=\n)\n+"),
    Rule("repeated_lines", STRUCTURAL),
    Rule("hyphens", STRUCTURAL, r"(?<=[^\W\d_])-\n(?=[^\W\d_])"),
    Rule("summarise", SEMANTIC),
)


def _spans(rule: Rule, text: str, lines: set[str]) -> Iterator[tuple[int, int, str]]:
    """Start, end and new text of what a rule changes, in order."""
    if rule.find is not None:
        for m in re.finditer(rule.find, text):
            after = rule.put(m[0]) if callable(rule.put) else rule.put
            if after != m[0]:
                yield m.start(), m.end(), after
    elif lines:
        at = 0
        for line in text.split("\n"):
            end = at + len(line)
            if line in lines:
                # With its line end, or the one before it if it is the last.
                yield (at, end + 1, "") if end < len(text) else (max(at - 1, 0), end, "")
            at = end + 1


def _disjoint(spans: Iterator[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for start, end, after in spans:
        start = max(start, out[-1][1]) if out else start
        out.append((start, end, after))
    return out


def rebase(pieces: list[tuple[int, int, int, bool]], edits: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, int, bool]], list[tuple[int, int]]]:
    """The pieces after some edits, and the source span of each edit.

    A piece is its length, its source span, and whether it is verbatim. The first part of a replaced piece that is cut keeps
    its source span, the second has an empty one at its end.
    """
    out, spans, at = [], [], 0
    todo = list(reversed(pieces))

    def cut(n: int) -> tuple[int, int, int, bool]:
        size, a, b, verbatim = todo.pop()
        if n < size:
            todo.append((size - n, a + n if verbatim else b, b, verbatim))
            return n, a, a + n if verbatim else b, verbatim
        return size, a, b, verbatim

    for start, end, after in edits:
        while at < start:
            out.append(cut(start - at))
            at += out[-1][0]
        # What has no length here lies before an insertion.
        while start == end and todo and todo[-1][0] == 0:
            out.append(todo.pop())
        covered = []
        while at < end:
            covered.append(cut(end - at))
            at += covered[-1][0]
        place = todo[-1][1] if todo else (out[-1][2] if out else 0)
        span = (covered[0][1], covered[-1][2]) if covered else (place, place)
        out.append((len(after), *span, False))
        spans.append(span)
    out.extend(reversed(todo))
    return [p for p in out if p[0] or p[2] > p[1]], spans


def clean_text(text: str, rules: tuple[Rule, ...] = RULES, lines: set[str] = frozenset()) -> tuple[str, list[dict], list[dict]]:
    """The cleaned text, every edit of every rule with its source span, and the edits that lead from source to result."""
    pieces, log, now = [(len(text), 0, len(text), True)], [], text
    for rule in rules:
        if rule.level == SEMANTIC:
            continue
        edits = _disjoint(_spans(rule, now, lines))
        if not edits:
            continue
        pieces, spans = rebase(pieces, edits)
        parts, at = [], 0
        for (start, end, after), (a, b) in zip(edits, spans, strict=True):
            log.append({"rule": rule.name, "level": rule.level, "start": start, "end": end, "source_start": a, "source_end": b, "before": now[start:end], "after": after})
            parts += [now[at:start], after]
            at = end
        now = "".join([*parts, now[at:]])
    net, at = [], 0
    for size, a, b, verbatim in pieces:
        if not verbatim:
            if net and net[-1]["end"] == a and net[-1]["_to"] == at:
                net[-1] |= {"end": b, "after": net[-1]["after"] + now[at : at + size], "_to": at + size}
            else:
                net.append({"start": a, "end": b, "after": now[at : at + size], "_to": at + size})
        at += size
    return now, log, [{k: e[k] for k in ("start", "end", "after")} for e in net]


#: Characters of source whose edits are held at once, one text at least: an edit takes some hundred bytes in Python.
HELD = 1 << 18


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts exceed so many characters."""
    first = size = 0
    for i, n in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
        if size and size + n > most:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    yield batch.slice(first)


_TEXT, _AT = pa.string(), pa.int32()
_NET = pa.list_(pa.struct({"start": _AT, "end": _AT, "after": _TEXT}))
_LOG = pa.list_(pa.struct({"rule": _TEXT, "level": _TEXT, "start": _AT, "end": _AT, "source_start": _AT, "source_end": _AT, "before": _TEXT, "after": _TEXT}))


def _cleaned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc, text, cleaned, log and net. rows: doc, text, lines. Edits leave Python a portion at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, HELD):
                done = [clean_text(t, rules, set(x)) for t, x in zip(part.column("text").to_pylist(), part.column("lines").to_pylist(), strict=True)]
                made = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((_TEXT, _LOG, _NET))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text"), *made], names=["doc", "text", "cleaned", "log", "net"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "text", "lines").mapInArrow(work, f"doc {kind}, text string, cleaned string, log {LOG}, net {NET}")


def _plain(rules: tuple[Rule, ...]) -> Callable:
    """Column: the cleaned text alone, without the lines that repeat."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean_text(t, rules)[0])

    work.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "string")


def repeated_lines(texts: DataFrame, documents: int = 3, longest: int = 80) -> DataFrame:
    """doc, lines: those lines of each document that at least so many documents of its source hold. texts: doc, source, text.

    Each line counts once for a document; counts are combined before the shuffle and lines travel as hashes but once.
    """
    lines = settle(texts.select("doc", "source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line").between(1, longest)).withColumn("h", F.md5("line")), "lines")
    often = settle(lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select(F.col("source").alias("_s"), F.col("h").alias("_h")), "often")
    found = lines.join(often, F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")), "left_semi")
    return found.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES, documents: int = 3) -> DataFrame:
    """doc, text, cleaned, log and net of every document. docs: doc (unique), source, text.

    Lines that repeat in a source are sought in what the rules before make of the texts. A null text is an empty one. An
    unknown level is an error.
    """
    if bad := [r.level for r in rules if r.level not in (LOSSLESS, STRUCTURAL, SEMANTIC)]:
        raise ValueError(f"unknown rule level: {bad[0]}")
    rows = docs.select("doc", "source", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    at = next((i for i, r in enumerate(rules) if r.find is None and r.level == STRUCTURAL), None)
    if at is None:
        return _cleaned(rows.withColumn("lines", none), rules)
    before = rows.select("doc", "source", _plain(rules[:at])("text").alias("text"))
    known = rows.join(repeated_lines(before, documents), "doc", "left")
    return _cleaned(known.withColumn("lines", F.coalesce("lines", none)), rules)


def audit(cleaned: DataFrame) -> DataFrame:
    """A row for each edit: doc, seq, rule, level, spans, before, after, review_status."""
    status = F.when(F.col("e.level") == LOSSLESS, "auto_approved").otherwise("pending_review")
    return cleaned.select("doc", F.posexplode("log").alias("seq", "e")).select("doc", "seq", "e.*", status.alias("review_status"))


def refused(rules: tuple[Rule, ...]) -> list[dict]:
    """Review items of the rules that may not apply."""
    return [{"rule": r.name, "review_status": "pending_review", "reason": "semantic_change_forbidden"} for r in rules if r.level == SEMANTIC]


def apply_edits(text, edits):
    """Column: the text with disjoint edits (start, end, after) applied, in their order."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    step = lambda a, e: F.struct(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["after"])).alias("parts"), e["end"].alias("at"))
    return F.aggregate(edits, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


#: The rules that SQL has as well: NFKC it has not.
PLAIN = tuple(r for r in RULES if r.name not in ("nfkc", "hyphens"))


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", "text")


_SQL = r"""WITH d AS (SELECT doc_id, source, text AS t0 FROM documents), a AS (SELECT *, regexp_replace(t0, '\r\n?', chr(10), 'g') AS t1 FROM d), b AS (SELECT *, regexp_replace(t1, '[ \t]+', ' ', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '(?m)^ | $', '', 'g') AS t3 FROM b), e AS (SELECT *, trim(regexp_replace(t3, '\n{2,}', chr(10), 'g'), chr(10)) AS t4 FROM c),
l AS (SELECT doc_id, source, i, string_split(t4, chr(10))[i] AS line FROM e, range(1, 1000000) r(i) WHERE i <= len(string_split(t4, chr(10)))),
o AS (SELECT source, line FROM l WHERE length(line) BETWEEN 1 AND 80 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
k AS (SELECT l.doc_id, i, line, o.line IS NOT NULL AS gone FROM l LEFT JOIN o USING (source, line)),
f AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS cleaned, count(*) FILTER (gone) AS n_repeated FROM k GROUP BY doc_id)
SELECT doc_id AS doc, rule, n FROM (SELECT doc_id, len(regexp_extract_all(t0, '\r\n?')) AS line_ends, len(list_filter(regexp_extract_all(t1, '[ \t]+'), lambda x: x <> ' ')) AS spaces, len(regexp_extract_all(t2, '(?m)^ | $')) AS line_edges,
len(regexp_extract_all(trim(t3, chr(10)), '\n{2,}')) + CASE WHEN starts_with(t3, chr(10)) THEN 1 ELSE 0 END + CASE WHEN ends_with(t3, chr(10)) AND trim(t3, chr(10)) <> '' THEN 1 ELSE 0 END AS blank_lines, n_repeated AS repeated_lines FROM e JOIN f USING (doc_id))
UNPIVOT (n FOR rule IN (line_ends, spaces, line_edges, blank_lines, repeated_lines)) WHERE n > 0"""


@query(_SQL)
def cleaning_audit(spark, d):
    """Edits of each rule in every document."""
    return audit(clean(_documents(spark, d), PLAIN)).groupBy("doc", "rule").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS doc, true AS replays FROM documents")
def cleaning_replay(spark, d):
    """Whether the net edits, applied to a document's source, give its cleaned text: all rules, every document."""
    return clean(_documents(spark, d)).select("doc", (apply_edits(F.col("text"), F.col("net")) == F.col("cleaned")).alias("replays"))
