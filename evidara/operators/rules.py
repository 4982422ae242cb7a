"""Checks over many datasets, declared as rules and compiled into one scan of each dataset and one shuffle of facts.

Datasets whose references miss their targets are read once more, for the least row that makes each of these.

A row gives a fact for each rule that it breaks, each key it claims, each reference it makes and each key others may refer
to. Facts are counted before and behind one shuffle; duplicates are keys counted twice, and all references of all datasets
meet their targets in one anti join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table

FACTS = "array<struct<code:int,value:string>>"


@dataclass(frozen=True)
class Rule:
    """field: an expression of the dataset's columns. target: dataset.field. holds: what must be true of a row.

    kind: required (not null, empty or blank), allowed (holds, with the value as detail), holds, unique, refers (a value or an
    array of values that must be there in the target; null refers to nothing), share (holds for so great a part at least).
    """

    name: str
    dataset: str
    kind: str
    field: str = ""
    holds: str = ""
    target: str = ""
    least: float = 0.0


def required(dataset: str, field: str) -> Rule:
    return Rule(f"{dataset}.{field} is there", dataset, "required", field)


def allowed(dataset: str, field: str, *values: object) -> Rule:
    listed = ", ".join(repr(v) for v in values)
    return Rule(f"{dataset}.{field} is allowed", dataset, "allowed", field, f"{field} IN ({listed})")


def holds(dataset: str, condition: str) -> Rule:
    return Rule(f"{dataset}: {condition}", dataset, "holds", holds=condition)


def unique(dataset: str, *fields: str) -> Rule:
    field = fields[0] if len(fields) == 1 else f"concat_ws('|', {', '.join(fields)})"
    return Rule(f"{dataset} has one row for {', '.join(fields)}", dataset, "unique", field)


def refers(dataset: str, field: str, target: str) -> Rule:
    return Rule(f"{dataset}.{field} is in {target}", dataset, "refers", field, target=target)


def covers(target: str, source: str) -> Rule:
    """Every value of source (dataset.field) is in target (dataset.field): the closure the other way round."""
    return refers(*source.split(".", 1), target)


def share(dataset: str, condition: str, least: float) -> Rule:
    return Rule(f"{dataset}: {condition} for {least:.0%}", dataset, "share", holds=condition, least=least)


def _one(code: int, value: Column) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"))).cast(FACTS)


def _fact(rule: Rule, code: Callable[[str], int]) -> Column:
    """The array of facts that a row gives for a rule."""
    none = F.array().cast(FACTS)
    if rule.kind == "unique":
        return F.when(F.expr(rule.field).isNotNull(), _one(code("key"), F.expr(rule.field))).otherwise(none)
    if rule.kind == "share":
        return _one(code("share"), F.coalesce(F.expr(rule.holds), F.lit(False)))
    if rule.kind == "required":
        text = F.expr(f"cast({rule.field} AS string)")
        return F.when(text.isNull() | (F.btrim(text) == ""), _one(code("bad"), F.lit(None))).otherwise(none)
    value = F.expr(rule.field) if rule.kind == "allowed" else F.lit(None)
    return F.when(F.coalesce(F.expr(rule.holds), F.lit(False)), none).otherwise(_one(code("bad"), value))


def _values(df: DataFrame, rule: Rule) -> Column:
    """The values that a row refers to."""
    array = df.select(F.expr(rule.field)).schema[0].dataType.typeName() == "array"
    values = F.expr(rule.field) if array else F.array(F.expr(rule.field))
    return F.coalesce(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: v.cast("string")), F.array().cast("array<string>"))


def _references(values: Column, code: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(code).alias("code"), v.alias("value"))).cast(FACTS)


def facts(datasets: dict[str, tuple[DataFrame, str]], rules: list[Rule]) -> DataFrame:
    """dataset, kind, rule, target, value, bad, n: what the rows of all datasets say, counted.

    datasets: a table and the expression that names its rows. A dataset that no rule asks about is not read. Rules of kind bad
    keep every row (in bad). A number stands for dataset, kind, rule and target until all is counted.
    """
    targets = {r.target for r in rules if r.kind == "refers"}
    codes: list[tuple[str, str, str, str]] = []

    def code(*named: str) -> int:
        codes.append(named)
        return len(codes) - 1

    out = None
    for name, (df, record) in datasets.items():
        own = [r for r in rules if r.dataset == name]
        wanted = sorted(t.split(".", 1)[1] for t in targets if t.split(".", 1)[0] == name)
        if not own and not wanted:
            continue
        parts = [_references(_values(df, r), code(name, "ref", r.name, r.target)) if r.kind == "refers" else _fact(r, lambda kind, r=r: code(name, kind, r.name, "")) for r in own]
        parts += [F.when(F.expr(f).isNotNull(), _one(code(name, "def", "", f"{name}.{f}"), F.expr(f))).otherwise(F.array().cast(FACTS)) for f in wanted]
        said = df.select(F.expr(record).cast("string").alias("record"), F.explode(F.concat(*parts)).alias("f")).select("record", "f.*")
        out = said if out is None else out.unionByName(said)
    if out is None:
        raise ValueError("no rule asks about any dataset")
    bad = F.when(F.col("code").isin(*[i for i, c in enumerate(codes) if c[1] == "bad"]), F.col("record")) if any(c[1] == "bad" for c in codes) else F.lit(None).cast("string")
    counts = out.select("code", "value", bad.alias("bad")).groupBy("code", "value", "bad").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("dataset", "kind", "rule", "target"), c, strict=True)]) for c in codes])
    return counts.select(F.get(names, "code").alias("_c"), "value", "bad", "n").select("_c.*", "value", "bad", "n")


def _least_records(datasets: dict[str, tuple[DataFrame, str]], rules: list[Rule], lost: DataFrame) -> DataFrame:
    """lost (dataset, rule, value, n) with the least record that refers so. Only datasets of such references are read again."""
    broken = {(r["dataset"], r["rule"]) for r in lost.select("dataset", "rule").distinct().collect()}
    out = None
    for r in rules:
        if r.kind == "refers" and (r.dataset, r.name) in broken:
            df, record = datasets[r.dataset]
            made = df.select(F.lit(r.dataset).alias("dataset"), F.lit(r.name).alias("rule"), F.expr(record).cast("string").alias("record"), F.explode(_values(df, r)).alias("value"))
            made = made.join(lost.where((F.col("dataset") == r.dataset) & (F.col("rule") == r.name)).select("value"), "value", "left_semi")
            out = made if out is None else out.unionByName(made)
    if out is None:
        return lost.withColumn("record", F.lit(None).cast("string"))
    return lost.join(out.groupBy("dataset", "rule", "value").agg(F.min("record").alias("record")), ["dataset", "rule", "value"])


def check(datasets: dict[str, tuple[DataFrame, str]], rules: list[Rule]) -> DataFrame:
    """dataset, rule, record, detail, n: what breaks the rules.

    A row that breaks a condition; a key that n rows claim; a value that n rows refer to in vain, with the least of them; a
    share that is too small, with the rows that it fails for. Rules for datasets that are not given are an error.
    """
    if missing := {r.dataset for r in rules} | {r.target.split(".", 1)[0] for r in rules if r.target} - {""}:
        missing -= set(datasets)
        if missing:
            raise ValueError(f"no such dataset: {', '.join(sorted(missing))}")
    known = settle(facts(datasets, rules).where("kind <> 'key' OR n > 1"), "facts")
    shown = lambda df, record, detail: df.select("dataset", "rule", record.alias("record"), detail.alias("detail"), "n")
    bad = shown(known.where("kind = 'bad'"), F.col("bad"), F.col("value"))
    twice = shown(known.where("kind = 'key'"), F.col("value"), F.lit(None).cast("string"))
    there = known.where("kind = 'def'").select("target", "value")
    vain = settle(known.where("kind = 'ref'").join(there, ["target", "value"], "left_anti").select("dataset", "rule", "value", "n"), "lost")
    lost = shown(_least_records(datasets, rules, vain), F.col("record"), F.col("value"))
    least = F.lit(None).cast("double")
    for r in rules:
        if r.kind == "share":
            least = F.when(F.col("rule") == r.name, r.least).otherwise(least)
    parts = known.where("kind = 'share'").groupBy("dataset", "rule").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("value") == "false", F.col("n"))), F.lit(0)).alias("n"))
    held = 1 - F.col("n") / F.col("all")
    small = shown(parts.where(held < least), F.lit(None).cast("string"), F.round(held, 6).cast("string"))
    return bad.unionByName(twice).unionByName(lost).unionByName(small)


def report(violations: DataFrame, rules: list[Rule], samples: int = 5) -> DataFrame:
    """rule, dataset, kind, passed, n, samples: every rule, how often it is broken, and its least records.

    The least are taken of 64 parts first, so that a rule that most rows break is not sorted in one task.
    """
    least = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("record"))).where(F.col("_r") <= samples).drop("_r")
    named = violations.where("record IS NOT NULL").select("rule", "record").distinct().withColumn("_part", F.pmod(F.xxhash64("record"), F.lit(64)))
    shown = least(least(named, "rule", "_part"), "rule").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("record")), ",").alias("samples"))
    counts = violations.groupBy("rule").agg(F.sum("n").alias("n"))
    every = violations.sparkSession.createDataFrame([(r.name, r.dataset, r.kind) for r in rules], "rule string, dataset string, kind string")
    found = every.join(counts, "rule", "left").join(shown, "rule", "left")
    return found.select("rule", "dataset", "kind", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


RULES = [
    required("region", "r_name"), unique("region", "r_regionkey"), required("nation", "n_name"), unique("nation", "n_nationkey"), refers("nation", "n_regionkey", "region.r_regionkey"), covers("nation.n_regionkey", "region.r_regionkey"),
    required("customer", "c_name"), unique("customer", "c_custkey"), refers("customer", "c_nationkey", "nation.n_nationkey"), allowed("customer", "c_mktsegment", "HOUSEHOLD", "MACHINERY", "BUILDING", "AUTOMOBILE"), holds("customer", "c_acctbal >= 0"), holds("customer", "c_name LIKE 'Customer#%'"),
    unique("supplier", "s_suppkey"), refers("supplier", "s_nationkey", "nation.n_nationkey"), covers("supplier.s_nationkey", "nation.n_nationkey"), share("supplier", "s_acctbal >= 5000", 0.6),
    unique("part", "p_partkey"), unique("part", "p_name", "p_brand", "p_type"), holds("part", "p_size BETWEEN 1 AND 45"), covers("lineitem.l_partkey", "part.p_partkey"),
    unique("orders", "o_orderkey"), refers("orders", "o_custkey", "customer.c_custkey"), covers("orders.o_custkey", "customer.c_custkey"), allowed("orders", "o_orderstatus", "F", "O", "P"), required("orders", "o_orderpriority"), share("orders", "o_totalprice > 1000", 0.99),
    unique("lineitem", "l_orderkey", "l_linenumber"), refers("lineitem", "l_orderkey", "orders.o_orderkey"), refers("lineitem", "l_partkey", "part.p_partkey"), refers("lineitem", "l_suppkey", "supplier.s_suppkey"), holds("lineitem", "l_discount <= 0.09"), covers("lineitem.l_orderkey", "orders.o_orderkey"),
    unique("events", "event_id"), allowed("events", "event_type", "view", "signup", "click", "purchase"), holds("events", "value >= 0.01"),
    unique("documents", "doc_id"), unique("documents", "md5(text)"), required("documents", "text"), allowed("documents", "lang", "en", "de", "fr"), holds("documents", "n_chars = length(text)"), share("documents", "n_chars >= 200", 0.99),
    refers("labels", "doc_id", "documents.doc_id"), covers("labels.doc_id", "documents.doc_id"), allowed("labels", "quality", 0, 1), unique("conversations", "conv_id", "turn"), allowed("conversations", "role", "user", "assistant"), required("conversations", "text"), unique("pages", "url"), unique("benchmark", "md5(text)"),
]
NAMED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "concat_ws('|', l_orderkey, l_linenumber)", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "conversations": "concat_ws('|', conv_id, turn)", "pages": "page_id", "benchmark": "item_id"}


def _sql(rule: Rule) -> str:
    """A rule by itself, as a query over the tables."""
    d, record, name = rule.dataset, f"CAST({NAMED[rule.dataset]} AS VARCHAR)", rule.name.replace("'", "''")
    head = f"SELECT '{d}' AS dataset, '{name}' AS rule, "
    if rule.kind == "unique":
        return f"{head} CAST({rule.field} AS VARCHAR) AS record, NULL AS detail, count(*) AS n FROM {d} WHERE {rule.field} IS NOT NULL GROUP BY 3 HAVING count(*) > 1"
    if rule.kind == "refers":
        other, key = rule.target.split(".", 1)
        return f"{head} min({record}), CAST({rule.field} AS VARCHAR), count(*) FROM {d} WHERE {rule.field} IS NOT NULL AND {rule.field} NOT IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL) GROUP BY {rule.field}"
    if rule.kind == "share":
        return f"{head} NULL, CAST(round(avg(CASE WHEN {rule.holds} THEN 1.0 ELSE 0.0 END), 6) AS VARCHAR), count(*) FILTER (NOT coalesce({rule.holds}, false)) FROM {d} HAVING avg(CASE WHEN {rule.holds} THEN 1.0 ELSE 0.0 END) < {rule.least}"
    if rule.kind == "required":
        return f"{head} {record}, NULL, 1 FROM {d} WHERE trim(coalesce(CAST({rule.field} AS VARCHAR), '')) = ''"
    detail = f"CAST({rule.field} AS VARCHAR)" if rule.kind == "allowed" else "NULL"
    return f"{head} {record}, {detail}, count(*) FROM {d} WHERE NOT coalesce({rule.holds}, false) GROUP BY ALL"


_EACH = " UNION ALL ".join(f"SELECT dataset, rule, record, detail, n FROM ({_sql(r)}) x(dataset, rule, record, detail, n)" for r in RULES)
_VALUES = ", ".join("('{}', '{}', '{}')".format(r.name.replace("'", "''"), r.dataset, r.kind) for r in RULES)


def _datasets(spark, d) -> dict[str, tuple[DataFrame, str]]:
    return {name: (table(spark, d, name), record) for name, record in NAMED.items()}


@query(_EACH)
def rule_violations(spark, d):
    """What breaks the rules of all tables."""
    return check(_datasets(spark, d), RULES)


@query(f"WITH v AS ({_EACH}), k AS (SELECT rule, record, row_number() OVER (PARTITION BY rule ORDER BY record) AS r FROM (SELECT DISTINCT rule, record FROM v WHERE record IS NOT NULL)), s AS (SELECT rule, string_agg(record, ',' ORDER BY record) AS samples FROM k WHERE r <= 5 GROUP BY rule), n AS (SELECT rule, sum(n)::BIGINT AS n FROM v GROUP BY rule) SELECT e.rule, dataset, kind, n IS NULL AS passed, coalesce(n, 0) AS n, coalesce(samples, '') AS samples FROM (VALUES {_VALUES}) e(rule, dataset, kind) LEFT JOIN n ON n.rule = e.rule LEFT JOIN s ON s.rule = e.rule")
def rule_report(spark, d):
    """Every rule, whether it holds, and the first records that break it."""
    return report(check(_datasets(spark, d), RULES), RULES)
