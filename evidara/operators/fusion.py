"""Search over several channels for many questions: fusion, intent, named sources, diversity, suppression, rerank, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table
from .evidence import anchors
from .retrieval import FUSED, RRF_K, TOP_K

#: What a source type that fits the question's intent adds, and which fit.
BOOST = 0.02
FITTING = {"standard": ("standard",), "case": ("case_report",), "paper": ("paper",), "data": ("data_doc", "tool_doc")}
CHANNELS = ("lexical", "vector")


class RetrievalUnavailable(RuntimeError):
    """Every channel that was asked has failed."""


def channel_status(states: DataFrame, items: DataFrame) -> DataFrame:
    """query, channel, status, n, degraded. states: query, channel, error, disabled. items: query, channel, doc.

    disabled, else failed, else complete if it found anything, else empty. A question is degraded if one of its channels
    failed. A question of which all channels that are not disabled failed is an error.
    """
    counts = items.groupBy("query", "channel").agg(F.count("*").alias("n"))
    known = states.join(counts, ["query", "channel"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off, failed = F.coalesce("disabled", F.lit(False)), F.col("error").isNotNull()
    status = F.when(off, "disabled").when(failed, "failed").when(F.col("n") > 0, "complete").otherwise("empty")
    rows = settle(known.select("query", "channel", status.alias("status"), "n", "error"), "status")
    asked = rows.where("status <> 'disabled'").groupBy("query").agg(F.every(F.col("status") == "failed").alias("lost"), F.bool_or(F.col("status") == "failed").alias("degraded"))
    if gone := asked.where("lost").limit(3).collect():
        raise RetrievalUnavailable(f"no channel is left for {', '.join(str(r['query']) for r in gone)}")
    return rows.join(asked.select("query", "degraded"), "query", "left").select("query", "channel", "status", "n", "error", F.coalesce("degraded", F.lit(False)).alias("degraded"))


def fuse(items: DataFrame, k: int = RRF_K, most: int = TOP_K) -> DataFrame:
    """query, doc, rrf, channels: the best rank of each channel counts once, of its ``most`` first.

    items: query, channel, doc, rank. Repeated and null documents of a channel do not count twice or at all.
    """
    best = items.where(F.col("doc").isNotNull() & (F.col("rank") <= most)).groupBy("query", "doc", "channel").agg(F.min("rank").alias("rank"))
    return best.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("rrf"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def with_intent(fused: DataFrame, intents: DataFrame, types: DataFrame) -> DataFrame:
    """fused with boost and score = rrf + boost. intents: query, intent. types: doc, source_type."""
    fits = reduce(lambda a, b: a | b, [(F.col("intent") == i) & F.col("source_type").isin(*t) for i, t in FITTING.items()])
    known = fused.join(intents, "query", "left").join(types, "doc", "left")
    boost = F.when(F.coalesce(fits, F.lit(False)), BOOST).otherwise(0.0)
    return known.select(*fused.columns, boost.alias("boost"), F.round(F.col("rrf") + boost, 8).alias("score"))


def select(fused: DataFrame, sources: DataFrame, anchored: DataFrame, limit: int = FUSED, most: int = 2) -> DataFrame:
    """query, doc, rrf, source, matched_terms, rank: documents of named sources first, then by score; diverse by source.

    sources: doc, source. anchored: query, source, matched_terms. The first of each source comes before second ones, of which
    more than ``most`` are left out. A document without a source stands for itself.
    """
    if not 1 <= limit <= FUSED:
        raise ValueError(f"limit must be from 1 to {FUSED}")
    named = fused.join(sources, "doc", "left").join(anchored, ["query", "source"], "left")
    own = F.coalesce("source", F.concat(F.lit("doc "), F.col("doc").cast("string")))
    order = [F.col("matched_terms").isNull(), F.desc("rrf"), F.asc("doc")]
    place = F.row_number().over(Window.partitionBy("query", "_own").orderBy(*order))
    near = named.withColumn("_own", own).withColumn("_r", place).where(F.col("_r") <= most)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("_r") > 1, *order))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("query", "doc", "rrf", "channels", "source", "matched_terms", "rank")


def suppress(rows: DataFrame, order: list[Column], exact: bool = True, per_group: int | None = 2, group: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of each question that stay, and a row of diagnostics for each that goes: query, doc, kept, rule.

    rows: query, doc, text_hash, source and what order needs. Of one text in one source the first stays; of what then is
    left, so many of each group. Null hashes and groups are like no other.
    """
    one = Window.partitionBy("query", "text_hash", "source").orderBy(*order)
    first = rows.withColumns({"_one": F.when(F.lit(exact) & F.col("text_hash").isNotNull(), F.row_number().over(one)).otherwise(1), "_kept": F.first("doc").over(one)})
    left = first.where("_one = 1").withColumn("_n", F.when(F.col(group).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("query", group).orderBy(*order))))
    most = per_group if per_group is not None else 1 << 30
    kept = left.where(F.col("_n") <= most).drop("_one", "_kept", "_n")
    twice = first.where("_one > 1").select("query", "doc", F.col("_kept").alias("kept"), F.lit("exact_duplicate_same_source_v1").alias("rule"))
    many = left.where(F.col("_n") > most).select("query", "doc", F.lit(None).cast(rows.schema["doc"].dataType).alias("kept"), F.lit("per_document_candidate_cap_v1").alias("rule"))
    return kept, twice.unionByName(many)


def rerank(pool: DataFrame, scores: DataFrame, top_n: int = 8, candidates: int = 20) -> tuple[DataFrame, DataFrame]:
    """query, doc, rrf, model_score, rank of the best, and the diagnostics of what went.

    pool: query, doc, rrf, source, text_hash; the first by rrf are candidates. scores: query, doc, model_score. Repeated texts
    go before scoring, the cap by source holds in the order after it. Documents without a score come last.
    """
    if not 5 <= top_n <= 8:
        raise ValueError("top_n must be from 5 to 8")
    by_rrf = [F.desc("rrf"), F.asc("doc")]
    near = settle(pool.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(*by_rrf))).where(F.col("_r") <= candidates).drop("_r"), "pool")
    once, twice = suppress(near, by_rrf, per_group=None)
    scored = once.join(scores, ["query", "doc"], "left")
    order = [F.desc_nulls_last("model_score"), *by_rrf]
    kept, many = suppress(scored, order, exact=False)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top_n)
    return best.select("query", "doc", "rrf", "model_score", "rank"), twice.unionByName(many)


def nearest(asked: DataFrame, docs: DataFrame, key: list[Column], value: Column, k: int = TOP_K) -> DataFrame:
    """query, doc, rank: the k documents of a question's key whose value is nearest to its own, ties by doc, itself left out.

    asked: doc_id and the columns that key (none null in a match) and value (an integer) need, as docs. Of one key and value
    the first k + 1 ids can be among the nearest, so no more of them meet a question; and of a key's values only those are
    taken before which fewer than k + 1 ids lie. Both are settled for each key and value that is asked for, which are as many
    as there are values, before any question is joined.
    """
    names = [f"_k{i}" for i in range(len(key))]
    placed = lambda df, of: df.where("doc_id IS NOT NULL").select(*[c.alias(n) for n, c in zip(names, key, strict=True)], value.cast("long").alias(of), "doc_id")
    first = Window.partitionBy(*names, "_m").orderBy("doc_id")
    near = settle(placed(docs, "_m").withColumn("_i", F.dense_rank().over(first)).where(F.col("_i") <= k + 1), "firsts")
    own = placed(asked, "_v")
    counts = near.groupBy(*names, "_m").agg(F.max("_i").alias("_n"))
    far = F.abs(F.col("_m") - F.col("_v"))
    closer = Window.partitionBy(*names, "_v").orderBy(far).rangeBetween(Window.unboundedPreceding, -1)
    values = own.select(*names, "_v").distinct().join(counts, names).withColumn("_before", F.coalesce(F.sum("_n").over(closer), F.lit(0))).where(F.col("_before") <= k).select(*names, "_v", "_m")
    best = Window.partitionBy(*names, "_v").orderBy(far, "doc_id")
    some = settle(values.join(near.drop("_i"), [*names, "_m"]).withColumn("_r", F.dense_rank().over(best)).where(F.col("_r") <= k + 1).drop("_r"), "nearest")
    found = own.withColumnRenamed("doc_id", "query").join(some, [*names, "_v"]).where("query <> doc_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(far, "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("doc_id").alias("doc"), "rank")


def _given(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions (ids divisible by 50), documents, and two channels that stand for searches: near lengths in one source, and
    near last digits of lengths in one language."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_hash"))
    asked = docs.where("doc_id % 50 = 0")
    best = lambda name, key, value: nearest(asked, docs, key, value).select("query", F.lit(name).alias("channel"), "doc", "rank")
    lexical = best("lexical", [F.col("source"), F.expr("n_chars DIV 400")], F.col("n_chars"))
    vector = best("vector", [F.col("lang"), F.expr("n_chars DIV 200")], F.col("n_chars") % 100)
    asked = asked.select(F.col("doc_id").alias("query"), F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("n_chars").alias("_n"))
    return asked, docs, settle(lexical.unionByName(vector), "channels")


_GIVEN = """a AS (SELECT doc_id AS query, source AS s, lang AS l, n_chars AS n FROM documents WHERE doc_id % 50 = 0),
ch AS (SELECT query, 'lexical' AS channel, doc_id AS doc, row_number() OVER (PARTITION BY query ORDER BY abs(n_chars - n), doc_id) AS rank FROM a JOIN documents ON source = s AND n_chars // 400 = n // 400 AND doc_id <> query
  UNION ALL SELECT query, 'vector', doc_id, row_number() OVER (PARTITION BY query ORDER BY abs(n_chars % 100 - n % 100), doc_id) FROM a JOIN documents ON lang = l AND n_chars // 200 = n // 200 AND doc_id <> query),
fu AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, string_agg(channel, ',' ORDER BY channel) AS channels FROM ch WHERE rank <= 64 GROUP BY 1, 2)"""


@query(f"""WITH {_GIVEN}, an AS (SELECT query, 'src' || (query // 50 % 20) AS source FROM a WHERE query % 100 = 0), x AS (SELECT fu.*, d.source, CASE WHEN an.query IS NOT NULL AND length(d.source) >= 4 THEN d.source END AS matched_terms FROM fu JOIN documents d ON d.doc_id = doc LEFT JOIN an ON an.query = fu.query AND an.source = d.source),
y AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY matched_terms IS NULL, rrf DESC, doc) AS r FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r > 1, matched_terms IS NULL, rrf DESC, doc) AS rank FROM y WHERE r <= 2)
SELECT query, doc, rrf, channels, source, matched_terms, rank FROM z WHERE rank <= 20""")
def anchored_fusion(spark, d):
    """Both channels of every question fused, sources that a question names first, two documents of a source at most."""
    asked, docs, channels = _given(spark, d)
    named = asked.where("query % 100 = 0").select(F.col("query").alias("query_id"), F.concat(F.lit("what does src"), (F.expr("query DIV 50") % 20).cast("string"), F.lit(" say")).alias("text"))
    found = anchors(named, docs.select("source").distinct()).withColumnRenamed("query_id", "query")
    return select(fuse(channels), docs.select(F.col("doc_id").alias("doc"), "source"), found)


@query(f"""WITH {_GIVEN}, i AS (SELECT query, ['standard', 'case', 'paper', 'data', ''][query // 50 % 5 + 1] AS intent FROM a), t AS (SELECT doc_id AS doc, ['standard', 'case_report', 'paper', 'data_doc', 'tool_doc', 'note'][doc_id % 6 + 1] AS source_type FROM documents),
b AS (SELECT fu.query, fu.doc, rrf, CASE WHEN intent = source_type OR intent = 'case' AND source_type = 'case_report' OR intent = 'data' AND source_type IN ('data_doc', 'tool_doc') THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM fu JOIN i USING (query) JOIN t USING (doc))
SELECT query, doc, boost, round(rrf + boost, 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf + boost, 8) DESC, doc) AS rank FROM b) WHERE rank <= 20""")
def intent_fusion(spark, d):
    """Fusion with what fits the question's intent raised, the first twenty of each question."""
    asked, docs, channels = _given(spark, d)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    intents = asked.select("query", pick([*FITTING, ""], F.expr("query DIV 50") % 5).alias("intent"))
    types = docs.select(F.col("doc_id").alias("doc"), pick(["standard", "case_report", "paper", "data_doc", "tool_doc", "note"], F.col("doc_id") % 6).alias("source_type"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return with_intent(fuse(channels), intents, types).withColumn("rank", rank.cast("long")).where(F.col("rank") <= FUSED).select("query", "doc", "boost", "score", "rank")


_RANKED = f"""{_GIVEN}, po AS (SELECT fu.query, doc, rrf, source, md5(text) AS h, n_chars FROM fu JOIN documents ON doc_id = doc QUALIFY row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) <= 20),
o AS (SELECT *, row_number() OVER w AS one, first(doc) OVER w AS kept FROM po WINDOW w AS (PARTITION BY query, h, source ORDER BY rrf DESC, doc)),
c AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY n_chars % 10 DESC, rrf DESC, doc) AS k FROM o WHERE one = 1)"""


@query(f"WITH {_RANKED} SELECT query, doc, rrf, n_chars % 10 AS model_score, row_number() OVER (PARTITION BY query ORDER BY n_chars % 10 DESC, rrf DESC, doc) AS rank FROM c WHERE k <= 2 QUALIFY rank <= 8")
def rerank_all(spark, d):
    """The best eight of every question's pool by a score of the documents, repeated texts and third ones of a source gone."""
    return _reranked(spark, d)[0]


@query(f"WITH {_RANKED} SELECT query, doc, kept, 'exact_duplicate_same_source_v1' AS rule FROM o WHERE one > 1 UNION ALL SELECT query, doc, NULL, 'per_document_candidate_cap_v1' FROM c WHERE k > 2")
def rerank_diagnostics(spark, d):
    """What went from every question's pool, by which rule and for which document."""
    return _reranked(spark, d)[1]


def _reranked(spark, d) -> tuple[DataFrame, DataFrame]:
    _, docs, channels = _given(spark, d)
    pool = fuse(channels).join(docs.select(F.col("doc_id").alias("doc"), "source", "text_hash", "n_chars"), "doc")
    scores = pool.select("query", "doc", (F.col("n_chars") % 10).alias("model_score"))
    return rerank(pool.select("query", "doc", "rrf", "source", "text_hash"), scores)


@query(f"""WITH {_GIVEN}, s AS (SELECT query, channel, CASE WHEN query % 200 = 0 AND channel = 'vector' THEN 'timeout' END AS error, query % 150 = 0 AND channel = 'lexical' AND query % 200 > 0 AS disabled FROM a, (VALUES ('lexical'), ('vector')) c(channel)),
n AS (SELECT query, channel, count(*) AS n FROM ch WHERE rank <= 64 GROUP BY ALL), t AS (SELECT s.*, coalesce(n, 0) AS n, CASE WHEN disabled THEN 'disabled' WHEN error IS NOT NULL THEN 'failed' WHEN coalesce(n, 0) > 0 THEN 'complete' ELSE 'empty' END AS status FROM s LEFT JOIN n USING (query, channel))
SELECT query, channel, status, n, error, bool_or(status = 'failed') OVER (PARTITION BY query) AS degraded FROM t""")
def channel_states(spark, d):
    """How each channel of each question went, where some time out and some are turned off."""
    asked, _, channels = _given(spark, d)
    states = asked.select("query", F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("channel"))
    error = F.when((F.col("query") % 200 == 0) & (F.col("channel") == "vector"), "timeout")
    off = (F.col("query") % 150 == 0) & (F.col("channel") == "lexical") & (F.col("query") % 200 > 0)
    return channel_status(states.select("query", "channel", error.alias("error"), off.alias("disabled")), channels)
