import brute
import pytest
from compare import connection, spark_rows, sql_rows

from evidara.llm import bpe, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(connection(sf_dir), queries.oracle_sql()[name])


def test_pipeline_against_brute_force(spark, sf_dir, docs, labels):
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = queries.queries()["op7_quality_rules"](spark, sf_dir).where("kept").collect()
    good = {r["doc_id"] for r in judged}
    rows = [r for r in rows if r[0] in good]
    kept = {i for i, _, _, k in brute.components(rows) if k}
    rows = sorted(r for r in rows if r[0] in kept)
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        staged = stage(spark, staged, sf_dir)
    cut = {r["doc_id"]: r["text"] for r in staged.collect()}
    assert {i: brute.sha(" ".join(brute.BLANK.findall(t))) for i, t in cut.items()} == {i: d for i, _, _, d in brute.repeats(rows)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {c[0] for c in brute.contamination(sorted(cut.items()), items) if not c[-1]}
    encoding = bpe.tokenizer()
    want = {i: len(encoding.encode_ordinary(cut[i])) for i in clean}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_on_edges_and_nothing(spark, sf_dir, edge_docs, no_docs, tmp_path):
    import corpus_pipeline

    for docs in (edge_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in now.collect()}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
