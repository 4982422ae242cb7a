"""Evidence predicates, citations, source anchors, budgets, paging, mapping audits and migration gates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table
from .governance import first_match
from .relational import EDGES_SQL, place_edges


def publishable(blocks: DataFrame, status: str = "status", reasons: str = "risk_reasons") -> DataFrame:
    """Blocks that are approved, by hand or by rule, and have no reason of risk."""
    return blocks.where(F.col(status).isin("approved", "auto_approved") & (F.size(F.coalesce(reasons, F.array().cast("array<string>"))) == 0))


@query("""SELECT doc_id, status FROM (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'auto_approved' END AS status, coalesce(toxic = 1, false) AS toxic, instr(text, chr(65533)) > 0 AS lost FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
WHERE status <> 'rejected' AND NOT toxic AND NOT lost""")
def publishable_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.instr("text", "�") > 0).alias("lost")).join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    risks = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("lost"), F.lit("replacement_character"))))
    status = first_match([(F.col("quality") == 1, "approved"), (F.col("quality") == 0, "rejected")], "auto_approved")
    return publishable(rows.select("doc_id", status.alias("status"), risks.alias("risk_reasons"))).select("doc_id", "status")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'approved_record' WHEN d.source IN (SELECT source FROM documents x JOIN labels y ON y.doc_id = x.doc_id WHERE quality = 1 AND toxic = 0) THEN 'approved_entity_evidence' WHEN n_chars >= 20 THEN 'processed_source' ELSE '' END AS trust_basis
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def trust_basis(spark, d):
    """Why a document is trusted: its own approval, an approved one of its source, that it was processed, or not at all."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    approved = docs.where("quality = 1 AND toxic = 0").select(F.col("source").alias("_s")).distinct()
    rows = docs.join(approved, F.col("source") == F.col("_s"), "left")
    basis = first_match([(F.col("quality") == 1, "approved_record"), (F.col("_s").isNotNull(), "approved_entity_evidence"), (F.col("n_chars") >= 20, "processed_source")], "")
    return rows.select("doc_id", basis.alias("trust_basis"))


@query("""SELECT o_orderkey AS record, strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') AS valid_until FROM orders WHERE o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1999-06-01' AND o_orderstatus <> 'F'
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def expired_validity(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("status"), F.date_format(F.date_add("o_orderdate", 365), "yyyy-MM-dd").alias("valid_until"))
    open_actions = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record"))
    return expired(records, open_actions, "1999-06-01", ["F"]).select("record", "valid_until")


def expired(records: DataFrame, open_actions: DataFrame, today: str, retired: list[str]) -> DataFrame:
    """Records that were valid until before today, are not retired and have no open action."""
    past = records.where((F.col("valid_until") != "") & (F.col("valid_until") < today) & ~F.col("status").isin(retired))
    return past.join(open_actions.select("record").distinct(), "record", "left_anti")


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression of a glob; `dir/**` is everything below dir, * and ? go across slashes."""
    if pattern.endswith("/**"):
        return f"^{re.escape(pattern[:-3].rstrip('/'))}/"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


CHANGED = ["https://*/en/*", "http://*.com/fr/**", "*ref=x"]


@query("SELECT page_id, url, concat_ws(',', CASE WHEN regexp_matches(url, '^https://.*/en/.*$') THEN 'https://*/en/*' END, CASE WHEN regexp_matches(url, '^http://\\*\\.com/fr/') THEN 'http://*.com/fr/**' END, CASE WHEN regexp_matches(url, '^.*ref=x$') THEN '*ref=x' END) AS patterns FROM pages WHERE regexp_matches(url, '^https://.*/en/.*$|^http://\\*\\.com/fr/|^.*ref=x$')")
def changed_paths(spark, d):
    """Paths that a list of change patterns matches, with the patterns."""
    hits = F.array_compact(F.array(*[F.when(F.col("url").rlike(glob_regex(p)), F.lit(p)) for p in CHANGED]))
    return table(spark, d, "pages").select("page_id", "url", hits.alias("h")).where(F.size("h") > 0).select("page_id", "url", F.array_join("h", ",").alias("patterns"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z0-9_À-ÿ./]+'), lambda x: upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS w FROM conversations WHERE role = 'user'),
n AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '[a-z][A-Z]') OR regexp_full_match(x, '[A-Z]{2,}[A-Za-z0-9]*')) AS named FROM t)
SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN len(named) > 0 THEN named ELSE w END, lambda x: '"' || x || '"'), ' OR ') AS fts FROM n""")
def fts_queries(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", fts_query(F.col("text")).alias("fts"))


def fts_query(text: Column) -> Column:
    """User text as literal tokens joined by OR; operators go, and names in capitals or camel case are preferred."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)[\w./]+"), F.lit(0)), lambda t: ~F.upper(t).isin("AND", "OR", "NOT", "NEAR"))
    named = F.filter(tokens, lambda t: t.rlike("[a-z][A-Z]") | t.rlike("^[A-Z]{2,}[A-Za-z0-9]*$"))
    return F.array_join(F.transform(F.when(F.size(named) > 0, named).otherwise(tokens), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


# Words of source names that name no source.
ANCHOR_STOPWORDS = "actions api archive bgp data doc docs framework global index outage paper raw review route routes routing source".split()


def anchor_terms(identity: Column) -> Column:
    """The words of a source's name that tell it: of four letters or more, ris, or an RFC number."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(identity), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda t: ((F.length(t) >= 4) | (t == "ris") | t.rlike(r"^rfc\d+$")) & ~t.rlike(r"^\d+$") & ~t.isin(ANCHOR_STOPWORDS))


def anchors(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, source and matched_terms where a question (query_id, text) names a source by whole words."""
    terms = sources.select("source", F.explode(anchor_terms(F.col("source"))).alias("term"))
    words = questions.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return words.join(terms, "term").groupBy("query_id", "source").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("matched_terms"))


@query(r"""WITH n AS (SELECT DISTINCT p_type AS source FROM part), s AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS term FROM n), q AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS term FROM part)
SELECT query_id, source, string_agg(term, ',' ORDER BY term) AS matched_terms FROM q JOIN s USING (term) WHERE length(term) >= 4 AND NOT regexp_matches(term, '^\d+$') AND term NOT IN ('actions', 'archive', 'data', 'docs', 'framework', 'global', 'index', 'outage', 'paper', 'review', 'route', 'routes', 'routing', 'source') GROUP BY 1, 2""")
def source_anchors(spark, d):
    p = table(spark, d, "part")
    return anchors(p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), p.select(F.col("p_type").alias("source")).distinct())


@query("""WITH r AS (SELECT source, doc_id, n_chars, (lang = 'de')::INT AS anchored, row_number() OVER (PARTITION BY source ORDER BY (lang = 'de')::INT DESC, n_chars DESC, doc_id) AS place FROM documents) SELECT source, doc_id, anchored, place FROM r WHERE place <= 5""")
def anchored_first(spark, d):
    """The five best of each source, those that a question names before all others and each part in its own order."""
    r = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.coalesce((F.col("lang") == "de").cast("int"), F.lit(0)).alias("anchored"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("anchored"), F.desc("n_chars"), "doc_id"))
    return r.withColumn("place", place.cast("long")).where("place <= 5").select("source", "doc_id", "anchored", "place")


# Substrings that tell a question's intent, tried in this order.
INTENTS = {
    "case": ["incident", "outage", "case", "war story", "youtube", "cloudflare", "verizon", "aws", "facebook"], "data": ["routeviews", "ripe ris", "bgpstream", "asrank", "aspa", "data source", "raw data"],
    "paper": ["detect", "detection", "method", "analysis", "artemis", "bear", "beam"], "standard": ["rfc", "what is", "definition", "validation", "roa", "rpki", "route flap"],
}


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}'" for k, w in INTENTS.items()) + " ELSE '' END AS intent FROM conversations WHERE role = 'user'")
def query_intents(spark, d):
    low = F.lower("text")
    intent = first_match([(low.rlike("|".join(words)), name) for name, words in INTENTS.items()], "")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


def expand(text: Column, expansions: dict[str, list[str]]) -> Column:
    """A question with the expansions of every key in it, once each: keys of ASCII as whole words, others anywhere."""
    added = [F.lit(x) for key, words in expansions.items() for x in words]
    hit = lambda key: text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(key)}(?![A-Za-z0-9_])") if re.fullmatch(r"[A-Za-z0-9_.+-]+", key) else F.contains(F.lower(text), F.lit(key.lower()))
    found = F.concat(F.array(text), *[F.when(hit(key), F.array(*[F.lit(x) for x in words])).otherwise(F.array().cast("array<string>")) for key, words in expansions.items()]) if added else F.array(text)
    return F.btrim(F.array_join(F.array_distinct(F.filter(found, lambda x: x != "")), " "))


@query(r"""SELECT conv_id, turn, trim(concat_ws(' ', nullif(text, ''), CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') THEN 'definite article' END, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])of($|[^A-Za-z0-9_])') THEN 'preposition' END, CASE WHEN instr(lower(text), 'ü') > 0 THEN 'umlaut' END)) AS expanded FROM conversations WHERE role = 'user'""")
def query_expansion(spark, d):
    rules = {"the": ["definite article"], "of": ["preposition"], "ü": ["umlaut"]}
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.btrim(expand(F.col("text"), rules)).alias("expanded"))


MARKER = r"\[\[cite:([^\]]*)\]\]"


def cited(text: Column, allowed: Column) -> dict[str, Column]:
    """Citations of an answer: ids of valid markers [[cite:a,b]] in order, the visible text, and the status.

    A marker is valid if all its ids are allowed. Status: incomplete if the last marker never ends, else invalid if a
    marker has another id or none, else missing if none is valid though citations were offered, else complete. Invalid
    markers vanish from the text; valid ones become [n] by the place of their ids in the offer.
    """
    ids = lambda m: F.filter(F.transform(F.split(m, ","), lambda x: F.btrim(x)), lambda x: x != "")
    ok = lambda m: (F.size(ids(m)) > 0) & (F.size(F.array_except(ids(m), allowed)) == 0)
    markers = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    valid = F.filter(markers, ok)
    label = lambda m: F.concat(F.lit("["), F.array_join(F.transform(ids(m), lambda x: F.array_position(allowed, x).cast("string")), ","), F.lit("]"))
    cut = F.regexp_replace(text, r"\[\[cite:[^\]]*\z|\[(\[(c(i(te?)?)?)?)?\z", "")
    plain = F.split(cut, MARKER, -1)
    shown = F.transform(markers, lambda m: F.when(ok(m), label(m)).otherwise(""))
    visible = F.array_join(F.flatten(F.zip_with(plain, shown, lambda p, s: F.array(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    status = first_match([(cut != text, "incomplete"), (F.size(valid) < F.size(markers), "invalid"), ((F.size(valid) == 0) & (F.size(allowed) > 0), "missing")], "complete")
    return {"citation_ids": F.flatten(F.transform(valid, ids)), "visible": visible, "status": status}


@query(r"""WITH a AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' [[cite:ev_1]] and [[cite: ev_2 , ev_1 ]].' WHEN 1 THEN ' [[cite:ev_9]] end' WHEN 2 THEN ' [[cite:ev' ELSE '' END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ev_1,ev_2,ev_1' ELSE '' END AS citation_ids, CASE doc_id % 4 WHEN 0 THEN replace(replace(t, '[[cite:ev_1]]', '[1]'), '[[cite: ev_2 , ev_1 ]]', '[2,1]') WHEN 1 THEN replace(t, '[[cite:ev_9]]', '') WHEN 2 THEN replace(t, '[[cite:ev', '') ELSE t END AS visible,
CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'invalid' WHEN 2 THEN 'incomplete' ELSE 'missing' END AS status FROM a""")
def citation_markers(spark, d):
    k = F.col("doc_id") % 4
    end = F.when(k == 0, " [[cite:ev_1]] and [[cite: ev_2 , ev_1 ]].").when(k == 1, " [[cite:ev_9]] end").when(k == 2, " [[cite:ev").otherwise("")
    answers = X.fixed(table(spark, d, "documents"), "doc_id", t=F.concat("text", end))
    found = cited(F.col("t"), F.array(F.lit("ev_1"), F.lit("ev_2")))
    return answers.select("doc_id", F.array_join(found["citation_ids"], ",").alias("citation_ids"), found["visible"].alias("visible"), found["status"].alias("status"))


def within_budget(rows: DataFrame, group: str, size: str, order: list[Column], budget: int, keep_first: bool) -> DataFrame:
    """Rows of each group, in order, while their sizes add up to the budget at most; keep_first keeps the first anyway.

    A pack of characters stops at the first row that does not fit, and may be empty; units trimmed from the lowest score
    up are the same beginning, of which one always stays.
    """
    w = Window.partitionBy(group).orderBy(*order)
    used = rows.withColumns({"used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w).cast("long")})
    return used.where((F.col("used") <= budget) | (F.col("place") == 1) if keep_first else F.col("used") <= budget)


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER w AS used, row_number() OVER w AS place FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, used::BIGINT AS used FROM r WHERE used <= 6000""")
def context_pack(spark, d):
    """Results of each source up to 6000 characters; the first that does not fit ends the pack."""
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return within_budget(rows, "source", "n_chars", [F.col("doc_id")], 6000, keep_first=False).select("source", "doc_id", "used")


@query("""WITH r AS (SELECT source, doc_id, sum((n_chars + 1) // 2) OVER w AS used, row_number() OVER w AS place FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars % 97 DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, used::BIGINT AS used, place FROM r WHERE used <= 3000 OR place = 1""")
def score_budget(spark, d):
    """Units dropped from the lowest score up until their tokens fit 3000; the best always stays."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.expr("(n_chars + 1) DIV 2").alias("tokens"), (F.col("n_chars") % 97).alias("score"))
    return within_budget(rows, "source", "tokens", [F.desc("score"), F.col("doc_id")], 3000, keep_first=True).select("source", "doc_id", "used", "place")


def page_sections(sections: DataFrame, cursor: int, limit: int = 3, most: int = 48_000) -> DataFrame:
    """sections: doc_id, position from 0, content. The page of each document from a cursor, cut at most characters in
    all, with the next cursor (null at the end)."""
    total = sections.groupBy("doc_id").agg(F.count("*").alias("_n"))
    page = sections.where(F.col("position").between(cursor, cursor + limit - 1)).join(total, "doc_id")
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(most) - F.col("_before"), F.lit(0)).cast("int")
    out = page.withColumn("_before", before).where(F.col("_before") < most)
    return out.select("doc_id", "position", F.substring("content", F.lit(1), left).alias("content"), F.when(F.col("_n") > cursor + limit, F.lit(cursor + limit).cast("long")).alias("next_cursor"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS position, len(string_split(text, chr(10))) AS n FROM documents), p AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE position BETWEEN 1 AND 3)
SELECT doc_id, position, substring(content, 1, (greatest(400 - before, 0))::INT) AS content, CASE WHEN n > 4 THEN 4 END AS next_cursor FROM p WHERE before < 400""")
def evidence_page(spark, d):
    """The second page of every document's paragraphs, three to a page and 400 characters at most."""
    sections = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content")).withColumn("position", F.col("position").cast("long"))
    return page_sections(sections, 1, 3, 400)


@query(f"""WITH e AS ({EDGES_SQL}) SELECT relation AS local_value, string_agg(DISTINCT dst, ',' ORDER BY dst) AS source_refs, count(*) AS n, min(src) AS first_example FROM e WHERE relation NOT IN ('part_of') AND relation <> '' GROUP BY 1""")
def unmapped_relations(spark, d):
    """Relations that occur and have no mapping, with all that refers to them."""
    return unmapped(place_edges(spark, d), ["part_of"])


def unmapped(edges: DataFrame, mapped: Iterable[str]) -> DataFrame:
    rows = edges.where((F.col("relation") != "") & ~F.col("relation").isin(list(mapped)))
    refs = rows.groupBy("relation", "dst").agg(F.count("*").alias("n"), F.min("src").alias("s"))  # combined before the second level
    return refs.groupBy(F.col("relation").alias("local_value")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("source_refs"), F.sum("n").alias("n"), F.min("s").alias("first_example"))


@query("""WITH h AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS h FROM documents), c AS (SELECT doc_id, h, count(*) AS n FROM h WHERE length(h) BETWEEN 1 AND 60 GROUP BY 1, 2) SELECT doc_id, count(*) AS headings, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_heading_count FROM c GROUP BY 1""")
def heading_duplicates(spark, d):
    """Headings of each document and how many of them share their wording with another; all of these count."""
    h = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("h")).select("doc_id", F.trim("h").alias("h")).where(F.length("h").between(1, 60))
    c = h.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_heading_count"))


@query("""SELECT source, count(*) AS raw, count(*) FILTER (n_chars >= 20) AS parsed, count(*) FILTER (n_chars >= 20 AND instr(text, chr(65533)) = 0) AS cleaned, sum(len(string_split(text, chr(10))))::BIGINT AS chunk_count,
CASE WHEN source LIKE 'note%' THEN 'manual_note' WHEN count(*) FILTER (n_chars >= 20) = count(*) AND count(*) FILTER (n_chars >= 20 AND instr(text, chr(65533)) = 0) = count(*) AND sum(len(string_split(text, chr(10)))) > 0 THEN 'complete_deterministic' WHEN count(*) FILTER (n_chars >= 20) = 0 THEN 'raw_only_unparseable' ELSE 'incomplete' END AS processing_status FROM documents GROUP BY 1""")
def source_processing_status(spark, d):
    """What came of each source's documents at every step, and its status by the first rule that holds."""
    parsed = F.col("n_chars") >= 20
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("raw"), F.count_if(parsed).alias("parsed"), F.count_if(parsed & (F.instr("text", "�") == 0)).alias("cleaned"), F.sum(F.size(F.split("text", "\n"))).alias("chunk_count"))
    status = first_match([(F.col("source").startswith("note"), "manual_note"), ((F.col("parsed") == F.col("raw")) & (F.col("cleaned") == F.col("raw")) & (F.col("chunk_count") > 0), "complete_deterministic"), (F.col("parsed") == 0, "raw_only_unparseable")], "incomplete")
    return g.withColumn("processing_status", status)


@query("""WITH st AS (SELECT s_suppkey AS ref, CASE WHEN s_acctbal > 0 THEN 'complete_deterministic' ELSE 'incomplete' END AS status FROM supplier), r AS (SELECT DISTINCT p_partkey AS entity, l_suppkey AS ref FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40)
SELECT entity, count(r.ref) AS source_ref_count, coalesce(string_agg(r.ref || ':' || coalesce(status, 'unknown_source'), ',' ORDER BY r.ref) FILTER (r.ref IS NOT NULL), '') AS statuses, count(r.ref) FILTER (coalesce(status, '') <> 'complete_deterministic') AS blocked,
CASE WHEN count(r.ref) = 0 THEN 'add_source_refs_before_review' WHEN count(r.ref) FILTER (coalesce(status, '') <> 'complete_deterministic') > 0 THEN 'resolve_source_gaps_first' ELSE 'human_review_ready' END AS suggested_action FROM r LEFT JOIN st ON st.ref = r.ref GROUP BY 1""")
def entity_review_queue(spark, d):
    status = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.when(F.col("s_acctbal") > 0, "complete_deterministic").otherwise("incomplete").alias("status"))
    heavy = table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey", F.col("l_suppkey").alias("ref")).distinct()
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("entity")).join(heavy, F.col("l_partkey") == F.col("entity"), "left").select("entity", "ref")
    return review_queue(refs, status)


def review_queue(refs: DataFrame, status: DataFrame, ready: tuple[str, ...] = ("complete_deterministic",)) -> DataFrame:
    """refs: entity, ref (null where it has none). Each entity with the states of its sources and what to do first."""
    rows = refs.join(status, "ref", "left")
    known = F.col("ref").isNotNull()
    blocked = known & ~F.coalesce("status", F.lit("")).isin(*ready)
    named = F.when(known, F.struct("ref", F.concat(F.col("ref").cast("string"), F.lit(":"), F.coalesce("status", F.lit("unknown_source"))).alias("s")))
    g = rows.groupBy("entity").agg(F.count("ref").alias("source_ref_count"), F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["s"]), ",").alias("statuses"), F.count_if(blocked).alias("blocked"))
    return g.withColumn("suggested_action", first_match([(F.col("source_ref_count") == 0, "add_source_refs_before_review"), (F.col("blocked") > 0, "resolve_source_gaps_first")], "human_review_ready"))


@query("""WITH r AS (SELECT c_custkey AS entity, CASE WHEN c_acctbal > 5000 THEN 'approved' WHEN c_acctbal < 0 THEN 'deprecated' WHEN c_acctbal < 500 THEN NULL ELSE 'candidate' END AS status, CASE WHEN c_nationkey % 3 = 0 THEN 'pending' ELSE 'approved' END AS review, coalesce(n, 0) AS evidence FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
k AS (SELECT count(*) FILTER (status IS NULL) AS a, count(*) FILTER (status = 'approved' AND evidence < 1) AS b, count(*) FILTER (status = 'deprecated' AND evidence > 0) AS c, count(*) FILTER ((review = 'pending' AND status = 'approved') OR (review = 'approved' AND status = 'candidate')) AS e FROM r)
SELECT 'lifecycle_status_required' AS rule_id, a AS violations, CASE WHEN a = 0 THEN 'pass' ELSE 'fail' END AS status FROM k UNION ALL SELECT 'approved_requires_review_evidence', b, CASE WHEN b = 0 THEN 'pass' ELSE 'fail' END FROM k
UNION ALL SELECT 'deprecated_or_archived_reference_warning', c, CASE WHEN c = 0 THEN 'pass' ELSE 'warning' END FROM k UNION ALL SELECT 'review_lifecycle_consistency', e, CASE WHEN e = 0 THEN 'pass' ELSE 'fail' END FROM k""")
def lifecycle_checks(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = F.col("c_acctbal")
    rows = table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.when(b > 5000, "approved").when(b < 0, "deprecated").when(b < 500, F.lit(None)).otherwise("candidate").alias("lifecycle_status"), F.when(F.col("c_nationkey") % 3 == 0, "pending").otherwise("approved").alias("review_status"), F.coalesce("n", F.lit(0)).alias("evidence"), (F.coalesce("n", F.lit(0)) > 0).alias("referenced")
    )
    return check_lifecycle(rows)


def check_lifecycle(rows: DataFrame) -> DataFrame:
    """rule_id, violations and status of the lifecycle's rules, in one pass over lifecycle_status, review_status, evidence
    and referenced."""
    s, r = F.col("lifecycle_status"), F.col("review_status")
    rules = {
        "lifecycle_status_required": (s.isNull() | (s == ""), "fail"), "approved_requires_review_evidence": ((s == "approved") & (F.col("evidence") < 1), "fail"), "deprecated_or_archived_reference_warning": (s.isin("deprecated", "archived") & F.col("referenced"), "warning"),
        "review_lifecycle_consistency": (((r == "pending") & (s == "approved")) | ((r == "approved") & s.isin("draft", "candidate")), "fail"),
    }
    row = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, (c, _) in rules.items()])
    each = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.col(k).alias("violations"), F.when(F.col(k) == 0, "pass").otherwise(bad).alias("status")) for k, (_, bad) in rules.items()])
    return row.select(F.inline(each))


@query("""SELECT doc_id, sha256('{"model":"stub","model_revision":"1","normalization":"NFC","provider_contract":"v1","retrieval_text_hash":"' || sha256(text) || '"}') AS cache_key FROM documents""")
def embedding_cache_keys(spark, d):
    key = F.to_json(F.struct(F.lit("stub").alias("model"), F.lit("1").alias("model_revision"), F.lit("NFC").alias("normalization"), F.lit("v1").alias("provider_contract"), F.sha2(F.col("text").cast("binary"), 256).alias("retrieval_text_hash")))
    return table(spark, d, "documents").select("doc_id", F.sha2(key.cast("binary"), 256).alias("cache_key"))


@query("""SELECT user_id, event_id AS sequence, event_type FROM events WHERE event_id > 500""")
def replay_frames(spark, d):
    """Frames behind a resume point, each once."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("sequence"), "event_type")
    return resume(e.unionByName(e.where("sequence % 10 = 0")), 500)


def resume(frames: DataFrame, after: int) -> DataFrame:
    return frames.where(F.col("sequence") > after).dropDuplicates(["user_id", "sequence"])


@query("""WITH c AS (SELECT doc_id, length(text) AS n, length(replace(text, chr(10), '')) AS m, instr(text, chr(65533)) > 0 AS lost FROM documents), g AS (SELECT doc_id, concat_ws(',', CASE WHEN m < 0.995 * n THEN 'body_coverage_below_threshold' END, CASE WHEN lost THEN 'replacement_characters' END, CASE WHEN m = 0 THEN 'empty_body' END) AS issues FROM c) SELECT doc_id, issues, issues = '' AS passed FROM g""")
def migration_gates(spark, d):
    """Gates of a rewriting that drops line ends: how much of the body stays, lost characters, an empty body."""
    n, m = F.length("text"), F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rules = [("body_coverage_below_threshold", m < 0.995 * n), ("replacement_characters", F.instr("text", "�") > 0), ("empty_body", m == 0)]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in rules]).alias("issues")).withColumn("passed", F.col("issues") == "")


@query(r"""WITH r AS (SELECT o_orderkey AS record, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END AS t FROM orders)
SELECT record, CASE WHEN record % 3 = 2 THEN 'unreadable' WHEN record % 3 = 1 THEN 'timezone_missing' ELSE 'valid' END AS verdict FROM r""")
def review_times(spark, d):
    """Review times: ISO 8601 with an offset, or what is wrong with them."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat(day, F.lit("+02:00"))).when(k == 1, day).otherwise("soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), check_time(t).alias("verdict"))


def check_time(text: Column) -> Column:
    return F.when(F.try_to_timestamp(text).isNull(), "unreadable").when(~text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), "timezone_missing").otherwise("valid")


def override(base: Column, patch: Column) -> Column:
    """A map with another's entries put over it."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)


@query("""SELECT doc_id, 'lang=' || lang || ',size=' || CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END || ',source=' || CASE WHEN n_chars > 1000 THEN 'reviewed' ELSE source END AS merged, CASE WHEN n_chars > 1000 THEN 'source' ELSE '' END AS changed FROM documents""")
def map_override(spark, d):
    """Settings with overrides on top, as sorted text, and the keys that were overridden."""
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("size"), F.lit("short"))
    long = F.col("n_chars") > 1000
    patch = F.when(long, F.create_map(F.lit("size"), F.lit("long"), F.lit("source"), F.lit("reviewed"))).otherwise(F.create_map(F.lit("size"), F.lit("short")))
    rows = X.fixed(table(spark, d, "documents"), "doc_id", m=override(base, patch), base=base)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    changed = F.array_sort(F.filter(F.map_keys("base"), lambda k: (F.element_at("base", k) != F.element_at("m", k)) & (k != "size")))
    return rows.select("doc_id", text(F.col("m")).alias("merged"), F.array_join(changed, ",").alias("changed"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Figures of answers: claims, cited_claims, citations, valid (ids that exist), supported (that bear the claim),
    expected and status (answered or no_evidence), injected and followed. A figure without a case is null."""
    share = lambda a, of: F.round(F.sum(a) / F.nullif(F.sum(of), F.lit(0)), 6)
    none, held = F.col("expected") == "no_evidence", F.col("injected") & ~F.col("followed")
    count = lambda c: F.when(c, 1).otherwise(0)
    return answers.agg(
        F.count("*").alias("answers"), share("cited_claims", "claims").alias("claim_citation_coverage"), share("supported", "citations").alias("citation_precision"), share("valid", "citations").alias("citation_id_validity"),
        share(count(none & (F.col("status") == "no_evidence")), count(none)).alias("rejection_rate"), share(count(held), count(F.col("injected"))).alias("injection_protection"),
    )


@query("""WITH a AS (SELECT o_orderkey, count(l_orderkey) AS claims, count(*) FILTER (l_returnflag <> 'N') AS cited, count(*) FILTER (l_returnflag <> 'N' AND l_suppkey % 50 <> 0) AS valid, count(*) FILTER (l_returnflag <> 'N' AND l_suppkey % 50 <> 0 AND l_quantity > 10) AS supported,
any_value(o_orderstatus) AS st, any_value(o_orderpriority) AS pr FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT count(*) AS answers, round(sum(cited)::DOUBLE / sum(claims), 6) AS claim_citation_coverage, round(sum(supported)::DOUBLE / sum(cited), 6) AS citation_precision, round(sum(valid)::DOUBLE / sum(cited), 6) AS citation_id_validity,
round(count(*) FILTER (st = 'P' AND cited = 0)::DOUBLE / count(*) FILTER (st = 'P'), 6) AS rejection_rate, round(count(*) FILTER (pr = '1-URGENT' AND claims < 5)::DOUBLE / count(*) FILTER (pr = '1-URGENT'), 6) AS injection_protection FROM a""")
def answer_quality(spark, d):
    """Orders as answers and their lines as claims, of which returned or accepted ones cite a supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "N").alias("cited"), (F.col("l_suppkey") % 50 != 0).alias("known"), "l_quantity")
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("claims"), F.count_if("cited").alias("cited_claims"), F.count_if(F.col("cited") & F.col("known")).alias("valid"), F.count_if(F.col("cited") & F.col("known") & (F.col("l_quantity") > 10)).alias("supported"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = table(spark, d, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderstatus", "o_orderpriority", *[zero(c) for c in ("claims", "cited_claims", "valid", "supported")])
    return answer_metrics(rows.select(
        "claims", "cited_claims", F.col("cited_claims").alias("citations"), "valid", "supported", F.when(F.col("o_orderstatus") == "P", "no_evidence").otherwise("answered").alias("expected"), F.when(F.col("cited_claims") == 0, "no_evidence").otherwise("answered").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("injected"), (F.col("claims") >= 5).alias("followed"),
    ))


@query("""SELECT s_suppkey AS entity, '{"@context":"https://schema.org","@id":"urn:supplier:' || s_suppkey || '","@type":"Organization","name":"' || s_name || '","location":{"@id":"urn:nation:' || s_nationkey || '"}}' AS record FROM supplier""")
def jsonld_entities(spark, d):
    """Entities as JSON-LD records."""
    urn = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string"))
    record = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), urn("supplier", "s_suppkey").alias("@id"), F.lit("Organization").alias("@type"), F.col("s_name").alias("name"), F.struct(urn("nation", "s_nationkey").alias("@id")).alias("location")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), record.alias("record"))


@query("""SELECT 'entity' AS kind, 'document:' || doc_id AS subject, '' AS object FROM documents UNION ALL SELECT DISTINCT 'activity', 'ingest:' || source, '' FROM documents UNION ALL SELECT 'wasGeneratedBy', 'document:' || doc_id, 'ingest:' || source FROM documents UNION ALL SELECT 'wasDerivedFrom', 'item:' || item_id, 'document:' || min(doc_id) FROM benchmark JOIN documents ON documents.text = benchmark.text GROUP BY item_id""")
def prov_records(spark, d):
    """Provenance of documents: what each is, which activity made it, and what was derived from it."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("doc"), F.concat(F.lit("ingest:"), "source").alias("act"), "doc_id", "text")
    row = lambda df, kind, s, o: df.select(F.lit(kind).alias("kind"), s.alias("subject"), o.alias("object"))
    none = F.lit("")
    items = table(spark, d, "benchmark").join(docs, "text").groupBy("item_id").agg(F.min("doc_id").alias("m"))
    derived = row(items, "wasDerivedFrom", F.concat(F.lit("item:"), F.col("item_id").cast("string")), F.concat(F.lit("document:"), F.col("m").cast("string")))
    return row(docs, "entity", F.col("doc"), none).unionByName(row(docs.select("act").distinct(), "activity", F.col("act"), none)).unionByName(row(docs, "wasGeneratedBy", F.col("doc"), F.col("act"))).unionByName(derived)


def sequential(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, its place from 1 in a total order, without a task that sees all rows.

    Ranges of the order are sorted apart and written; the counts of those before give each range its first number.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    parts = settle(sorted_.withColumns({"_part": F.shiftright("_i", 33), "_i": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(before, F.col("_part") == F.col("_p")).withColumn("seq", F.col("_before") + F.col("_i") + 1).drop("_part", "_i", "_p", "_before")


@query(f"""WITH e AS ({EDGES_SQL}), u AS (SELECT DISTINCT * FROM e) SELECT 'rel_' || printf('%05d', row_number() OVER (ORDER BY src, relation, dst)) AS rel_id, src, relation, dst FROM u""")
def serving_relationships(spark, d):
    """Edges as the serving store keeps them: repeated ones ignored, numbered in order."""
    e = place_edges(spark, d)
    return sequential(e.unionByName(e.where("relation = 'part_of'")).distinct(), "src", "relation", "dst").select(F.concat(F.lit("rel_"), F.lpad(F.col("seq").cast("string"), 5, "0")).alias("rel_id"), "src", "relation", "dst")
