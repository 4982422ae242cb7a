"""Citation markers of answers, whole or as they stream in: [[cite:a,b]] in any split of a text into deltas.

One pattern takes a message apart: closed markers, an open end, opened markers that ran too long, and text. What may still
become a marker is at most LONGEST characters, so that is all a message holds back between deltas.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..plans.registry import query
from ..plans.settled import shared_dir
from ..sources.tables import table
from .turns import run_available

#: The marker and the characters after which an open one is given up.
PREFIX, SUFFIX, LONGEST = "[[cite:", "]]", 160
_INSIDE = LONGEST + 1 - len(PREFIX) - len(SUFFIX)
#: In order: a closed marker; an open one at the end, which may still close; an open one that is too long; the beginning of
#: a marker at the end; text. {0} is the end of input.
PIECE = r"(?s)\[\[cite:.{0,%d}?\]\]|\[\[cite:.{0,%d}%s|\[\[cite:|\[(?:\[(?:c(?:i(?:t(?:e)?)?)?)?)?%s|[^\[]+|\[" % (_INSIDE, _INSIDE + 1, "{0}", "{0}")
PIECE = PIECE.replace("{0}", r"\z")
_PIECE = re.compile(PIECE.replace(r"\z", r"\Z"))

PARTS = "part long, at long, kind string, text string, citation_ids array<string>"
STATE = "next long, buffer string, allowed array<string>, cited long, at long, invalid boolean, held array<string>, done boolean"


def _ids(marker: Column) -> Column:
    inside = F.substring(marker, F.lit(len(PREFIX) + 1), F.length(marker) - len(PREFIX) - len(SUFFIX))
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse(messages: DataFrame) -> DataFrame:
    """message, part, kind, text, citation_ids of whole messages. messages: message, text, allowed.

    Even parts are citations, odd ones the text between them; a message ends with a row of kind status. A marker counts if
    it has ids and all are allowed; others vanish. Status: incomplete if the text ends in a marker, else invalid if a
    marker was not allowed or never closed, else missing if ids were offered and none is cited, else complete. A null text
    is empty and a null offer has no ids.
    """
    held = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECE), F.lit(0))
    allowed = F.coalesce("allowed", F.array().cast("array<string>"))
    pieces = messages.select("message", allowed.alias("allowed"), F.posexplode_outer(held).alias("at", "piece"), F.size(held).alias("n"))
    closed = F.col("piece").startswith(PREFIX) & F.col("piece").endswith(SUFFIX)
    last = (F.col("at") == F.col("n") - 1) & (F.col("piece").startswith(PREFIX) | F.lit(PREFIX).startswith(F.col("piece")))
    good = (F.size("ids") > 0) & (F.size(F.array_except("ids", "allowed")) == 0)
    kind = F.when(F.col("piece").isNull(), "nothing").when(closed, F.when(good, "citation").otherwise("invalid")).when(last, "incomplete").when(F.col("piece") == PREFIX, "invalid").otherwise("text")
    known = pieces.withColumn("ids", F.when(closed, _ids(F.col("piece")))).withColumn("kind", kind)
    before = F.count(F.when(F.col("kind") == "citation", 1)).over(Window.partitionBy("message").orderBy("at"))
    numbered = known.withColumn("part", 2 * before + F.when(F.col("kind") == "citation", 0).otherwise(1))
    shown = numbered.where(F.col("kind").isin("text", "citation")).select("message", "part", "at", "kind", F.when(F.col("kind") == "text", F.col("piece")).alias("text"), F.when(F.col("kind") == "citation", F.col("ids")).alias("citation_ids"))
    has = lambda k: F.max(F.col("kind") == k)
    status = F.when(has("incomplete"), "incomplete").when(has("invalid"), "invalid").when(~has("citation") & (F.max(F.size("allowed")) > 0), "missing").otherwise("complete")
    ends = known.groupBy("message").agg(status.alias("text")).select("message", F.lit(None).cast("long").alias("part"), F.lit(0).alias("at"), F.lit("status").alias("kind"), "text", F.lit(None).cast("array<string>").alias("citation_ids"))
    return merged(shown.unionByName(ends))


def merged(parts: DataFrame) -> DataFrame:
    """Pieces of text of one part joined in order; a message is as long as its row, so no group is longer."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"]), "")
    joined = parts.groupBy("message", "part", "kind").agg(F.max("citation_ids").alias("citation_ids"), text.alias("text"))
    return joined.select("message", "part", "kind", F.when(F.col("kind") != "citation", F.col("text")).alias("text"), "citation_ids")


def take(buffer: str, final: bool) -> tuple[list[str], str]:
    """Pieces of a buffer that no further text can change, and what is held back; nothing is if the text is over."""
    pieces = _PIECE.findall(buffer)
    if pieces and not final and not pieces[-1].endswith(SUFFIX) and (pieces[-1].startswith(PREFIX) or PREFIX.startswith(pieces[-1])):
        return pieces[:-1], pieces[-1]
    return pieces, ""


def _feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of one message in one micro-batch, taken in order of seq; what came before its turn waits in the state."""
    after, buffer, allowed, cited, at, invalid, held, done = state.get if state.exists else (0, "", None, 0, 0, False, [], False)
    waiting = {int(n): (flag == "1", delta) for n, flag, delta in (x.split(":", 2) for x in held)}
    for batch in batches:
        for seq, delta, final, offer in zip(batch["seq"], batch["delta"], batch["final"], batch["allowed"], strict=True):
            allowed = list(offer) if allowed is None and offer is not None else allowed
            if seq >= after:
                waiting.setdefault(int(seq), (bool(final), delta or ""))
    out = []
    while not done and after in waiting:
        done, delta = waiting.pop(after)
        after += 1
        pieces, buffer = take(buffer + delta, done)
        for i, piece in enumerate(pieces):
            if piece.startswith(PREFIX) and piece.endswith(SUFFIX):
                ids = [x for x in (y.strip(" ") for y in piece[len(PREFIX) : -len(SUFFIX)].split(",")) if x]
                if ids and set(ids) <= set(allowed or ()):
                    cited += 1
                    out.append((2 * cited, at, "citation", None, ids))
                else:
                    invalid = True
            elif done and i == len(pieces) - 1 and (piece.startswith(PREFIX) or PREFIX.startswith(piece)):
                buffer = piece
            elif piece == PREFIX:
                invalid = True
            else:
                out.append((2 * cited + 1, at, "text", piece, None))
            at += len(piece)
    if done and (not state.exists or not state.get[7]):
        status = "incomplete" if buffer else "invalid" if invalid else "missing" if allowed and not cited else "complete"
        out.append((None, 0, "status", status, None))
    if done:
        waiting, buffer = {}, ""
    state.update((after, buffer, allowed, cited, at, invalid, [f"{n}:{int(f)}:{d}" for n, (f, d) in sorted(waiting.items())], done))
    if out:
        part, place, kind, text, ids = zip(*out, strict=True)
        yield pd.DataFrame({"message": [key[0]] * len(out), "part": pd.array(part, "Int64"), "at": place, "kind": kind, "text": text, "citation_ids": ids})


def parse_stream(deltas: DataFrame) -> DataFrame:
    """The pieces of messages that stream in, as soon as nothing can change them; merged() gives the rows of parse().

    deltas: message, seq from 0, delta, final (the message is over), allowed (read from the first row of a message).
    Deltas may be sent again, and may come before others of their message. A message that is over stays in the state, by
    its number only, so that late copies do not open it again.
    """
    kind = deltas.schema["message"].dataType.simpleString()
    return deltas.select("message", "seq", "delta", "final", "allowed").groupBy("message").applyInPandasWithState(_feed, f"message {kind}, {PARTS}", STATE, "append", GroupStateTimeout.NoTimeout)


def cut_deltas(messages: DataFrame, size: int) -> DataFrame:
    """Messages in deltas of size characters."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1))
    cut = messages.select("message", "text", "allowed", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq"))
    return cut.select("message", "seq", F.substring("text", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("delta"), (F.col("seq") == F.col("n") - 1).alias("final"), "allowed")


def _answers(spark, d) -> DataFrame:
    """Conversation turns as answers: sentence ends get a marker, of which some are unknown, too long or open."""
    t = table(spark, d, "conversations")
    many = F.repeat(F.lit("x"), F.lit(170))
    mark = F.when(F.col("turn") % 5 == 1, " [[cite:ev_9]]").when(F.col("turn") % 5 == 3, F.concat(F.lit(" [[cite:ev_1"), many)).when(F.col("turn") % 5 == 4, "").otherwise(" [[cite: ev_2 ,ev_1]].")
    end = F.when(F.col("turn") % 5 == 2, " [[cite:ev").otherwise("")
    text = F.concat(F.replace("text", F.lit("."), mark), end)
    return X.fixed(t, message=F.concat_ws(":", "conv_id", "turn"), text=text, allowed=F.array(F.lit("ev_1"), F.lit("ev_2")))


_SQL = r"""WITH m AS (SELECT concat_ws(':', conv_id, turn) AS message, replace(text, '.', CASE turn % 5 WHEN 1 THEN ' [[cite:ev_9]]' WHEN 3 THEN ' [[cite:ev_1' || repeat('x', 170) WHEN 4 THEN '' ELSE ' [[cite: ev_2 ,ev_1]].' END)
  || CASE turn % 5 WHEN 2 THEN ' [[cite:ev' ELSE '' END AS text FROM conversations),
p AS (SELECT message, regexp_extract_all(text, '(?s)\[\[cite:.{0,152}?\]\]|\[\[cite:.{0,153}\z|\[\[cite:|\[(?:\[(?:c(?:i(?:t(?:e)?)?)?)?)?\z|[^\[]+|\[') AS p FROM m),
q AS (SELECT message, unnest(p) AS piece, unnest(range(len(p))) AS pos, len(p) AS n FROM p),
k AS (SELECT *, CASE WHEN starts_with(piece, '[[cite:') AND ends_with(piece, ']]') THEN CASE piece WHEN '[[cite: ev_2 ,ev_1]]' THEN 'citation' ELSE 'invalid' END
  WHEN pos = n - 1 AND (starts_with(piece, '[[cite:') OR starts_with('[[cite:', piece)) THEN 'incomplete' WHEN piece = '[[cite:' THEN 'invalid' ELSE 'text' END AS kind FROM q),
w AS (SELECT *, 2 * count(*) FILTER (kind = 'citation') OVER (PARTITION BY message ORDER BY pos) + CASE kind WHEN 'citation' THEN 0 ELSE 1 END AS part FROM k)
SELECT message, part, kind, CASE kind WHEN 'text' THEN string_agg(piece, '' ORDER BY pos) END AS text, CASE kind WHEN 'citation' THEN 'ev_2,ev_1' END AS citation_ids
FROM w WHERE kind IN ('text', 'citation') GROUP BY message, part, kind
UNION ALL SELECT m.message, NULL, 'status', CASE WHEN bool_or(kind = 'incomplete') THEN 'incomplete' WHEN bool_or(kind = 'invalid') THEN 'invalid' WHEN NOT coalesce(bool_or(kind = 'citation'), false) THEN 'missing' ELSE 'complete' END, NULL
FROM m LEFT JOIN k USING (message) GROUP BY m.message"""


def _flat(parts: DataFrame) -> DataFrame:
    return parts.withColumn("citation_ids", F.array_join("citation_ids", ","))


@query(_SQL)
def citation_parts(spark, d):
    """Text, citations and status of every turn, parsed whole."""
    return _flat(parse(_answers(spark, d)))


@query(_SQL)
def citation_stream(spark, d):
    """The same rows from a stream of deltas of 40 characters, in some micro-batches with keyed state."""
    at = f"{shared_dir(spark)}/citations-{uuid.uuid4().hex}"
    deltas = cut_deltas(_answers(spark, d), 40)
    # By message too: seq 0 has a delta of every message. Two files a core make two micro-batches that fill the cores.
    files = 2 * max(2, spark.sparkContext.defaultParallelism)
    deltas.repartition(files, "seq", "message").write.parquet(f"{at}/deltas")
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{at}/deltas")
    return _flat(merged(run_available(parse_stream(stream), f"{at}/parts", f"{at}/checkpoint")))


#: Fixed value: where sentences end.
SENTENCE_END = r"(?<=[。！？!?.])(?:\s+|(?=[A-Z\x{4e00}-\x{9fff}]))"


def complete_sentence(full: Column, preview: Column, needle: int = 48, head: int = 32) -> Column:
    """The first sentence of full that holds the preview's first characters, or whose own first are in the preview.

    Without such a sentence the first one; without any text the preview. White space is collapsed in both.
    """
    said = lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text, hint = said(full), said(F.replace(F.coalesce(preview, F.lit("")), F.lit("…"), F.lit("")))
    key = F.btrim(F.substring(hint, 1, needle))
    sentences = F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.btrim(s)), lambda s: s != "")
    fits = F.filter(sentences, lambda s: (key != "") & (s.contains(key) | hint.contains(F.substring(s, 1, head))))
    return F.when(text == "", said(preview)).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.get(sentences, F.lit(0)), text))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(substring(text, 120, 70), '\s+', ' ', 'g')) AS hint FROM documents),
s AS (SELECT doc_id, hint, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([。！？!?.])\s+', '\1' || chr(1), 'g'), '([。！？!?.])([A-Z一-鿿])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM d)
SELECT doc_id, CASE WHEN t = '' THEN hint ELSE coalesce(list_filter(s, lambda x: trim(substring(hint, 1, 48)) <> '' AND (contains(x, trim(substring(hint, 1, 48))) OR contains(hint, substring(x, 1, 32))))[1], s[1], t) END AS sentence FROM s""")
def complete_sentences(spark, d):
    """The sentence that a preview of 70 characters, cut out of the middle of each document, comes from."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", complete_sentence(F.col("text"), F.concat(F.substring("text", 120, 70), F.lit("…"))).alias("sentence"))
