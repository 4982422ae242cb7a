"""Learned decision lists over text statistics, with DataFrame functions only.

``text_statistics`` measures every whole text in one narrow pass. ``learn_rules`` runs sequential covering on
labelled rows: a rule grows literal by literal on two thirds of them by information gain, loses trailing literals on
the other third, and is kept while it stays precise there. Each growing step is one small aggregation in Spark, whose
result has a row for each feature, bin and class. ``apply_rules`` turns the list into one ordered CASE expression.

Null or empty texts have no words, so they fail the base rule. Identical rows are judged alike and all returned.
Null labels and labels without a document are not learned from. Without labels of both kinds the list is empty and
only the base rule rejects. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, settle, words_of

#: Statistics that the rules may test: ratios that do not depend on a text's length.
FEATURES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "capital_share")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def condition(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.condition()
    return out


def text_statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns in keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the FEATURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = docs.select(*keep, words_of(F.col(text)).alias("_w"), lines.alias("_l"), *[F.length(F.regexp_replace(t, f"[^{kind}]++", "")).cast("long").alias(name) for name, kind in (("n_symbols", "#*$%&|<>"), ("_capitals", "A-Z"))])
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
    })
    # Equal windows have equal hashes, so texts without a repeated hash are done; the others sort them and compare words.
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    windows = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(windows)))
    word = lambda x, k: F.get("_w", x["i"] + k)
    same = lambda x, y: (x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    twice = F.filter("_s", lambda x, k: F.coalesce(same(x, F.get("_s", k + 1)), F.lit(False)) | ((k > 0) & same(x, F.get("_s", F.greatest(k - 1, F.lit(0))))))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("long"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.withColumn("_n_lines", F.size("_l"))
    shares = [share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("_capitals", "word_chars").alias("capital_share")]
    # inline() keeps later filters above it; pushed below, they would repeat the array work for every reference.
    return df.select(*keep, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *shares))))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Statistics of labelled documents: all of them, or where there are more than max_rows, about that many by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(total, 1))))
    # One row of each id, however often it is there: the text of least hash.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return settle(text_statistics(rows, "doc_id", "quality").where(~base_failed()), "labelled-statistics")


def learn_rules(rows: DataFrame, n_cuts: int = 32, max_rules: int = 10, max_literals: int = 3, min_precision: float = 0.95, min_support: int = 3) -> list[Rule]:
    """An ordered list of rules that reject. rows: quality (0 is to be rejected) and FEATURES, of bounded number."""
    steps = [i / n_cuts for i in range(1, n_cuts)]
    found = rows.groupBy("quality").agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).collect()
    if {r["quality"] for r in found} != {0, 1}:
        return []
    cuts = {f: sorted({float(x) for r in found for x in r[f]}) for f in FEATURES}
    below = lambda f: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)))
    bins = F.array(*[F.struct(F.lit(k).alias("f"), below(f).alias("b")) for k, f in enumerate(FEATURES)])
    bad, part = (F.col("quality") == 0).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    rows = settle(rows.select(*FEATURES, bad.alias("bad"), (part > 0).alias("grow"), bins.alias("bins")).coalesce(1), "rule-rows")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(~verdict_rejects(rules))
        rule = _prune(left, _grow(left.where("grow"), cuts, max_literals))
        p, n = _counts(left, [rule])[0]
        if not rule or p < min_support or p < min_precision * (p + n):
            break
        rules.append(rule)
    return rules


def _grow(left: DataFrame, cuts: dict[str, list[float]], max_literals: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_literals:
        seen = left.where(holds(rule)).select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        p0, n0 = sum(r["p"] for r in seen if r["f"] == 0), sum(r["n"] for r in seen if r["f"] == 0)
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for k, f in enumerate(FEATURES):
            by = {r["b"]: (r["p"], r["n"]) for r in seen if r["f"] == k}
            p = n = 0
            for b, cut in enumerate(cuts[f]):  # bin b has values above b of the cuts, so up to the next
                p, n = p + by.get(b, (0, 0))[0], n + by.get(b, (0, 0))[1]
                for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if q and (g := q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                        best, gain = Literal(f, above, cut), g
        if best is None:
            break
        f = best.feature
        edge = left.where(holds(rule)).agg(F.max(F.when(F.col(f) <= best.cut, F.col(f))).alias("a"), F.min(F.when(F.col(f) > best.cut, F.col(f))).alias("b")).first()
        rule += (best if None in (edge["a"], edge["b"]) else Literal(f, best.above, (edge["a"] + edge["b"]) / 2),)
    return rule


def _counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    sums = [F.coalesce(F.sum(F.when(holds(r), x)), F.lit(0)) for r in rules for x in (F.col("bad"), 1 - F.col("bad"))]
    got = rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
    return [(got[2 * i], got[2 * i + 1]) for i in range(len(rules))]


def _prune(left: DataFrame, rule: Rule) -> Rule:
    """The beginning of the rule that is best on the pruning rows; shorter where equal."""
    if len(rule) < 2:
        return rule
    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in _counts(left.where("NOT grow"), starts)]
    return starts[worth.index(max(worth))]


def verdict_rejects(rules: list[Rule]) -> Column:
    """True where a rule of the list fires; one CASE in the list's order."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(holds(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, fired (the number of the first rule that fires from 1, else 0) and kept."""
    fired = None
    for k, rule in enumerate(rules, 1):
        fired = (F if fired is None else fired).when(holds(rule), k)
    fired = F.lit(0) if fired is None else fired.otherwise(0)
    return stats.withColumns({"base_failed": base_failed(), "fired": fired}).withColumn("kept", ~F.col("base_failed") & (F.col("fired") == 0))


def judge(docs: DataFrame, labels: DataFrame, *keep: str, max_labelled: int = 8_000) -> DataFrame:
    """Every row of docs with its statistics and verdict. max_labelled: about how many labelled rows to learn from."""
    rules = learn_rules(labelled_statistics(docs, labels, max_labelled))
    return apply_rules(text_statistics(docs, *keep), rules)


def keep_good(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    return judge(rows, labels, "_row", **options).where("kept").select("_row.*")
