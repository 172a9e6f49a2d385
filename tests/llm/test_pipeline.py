import plain
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import queries, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions_take_effect(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        sizes.append(docs.count())
        assert docs.columns == before.columns, name
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < before.count()
    assert docs.where(F.col("text").rlike(r"[0-9a-f]{32,}")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_stages_against_plain_versions(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality.op4_quality(spark, SF).where("kept").collect()}  # held against a plain version in test_operators
    left = {i: t for i, t in texts.items() if i in kept}
    fp = {i: plain.fingerprint(t) for i, t in left.items()}
    group = plain.union_find(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    left = {i: t for i, t in left.items() if group[i] == i}
    dirty = {i for i, _ in plain.alignments(left.items(), bench)}
    model, codes = secrets.fit(secrets.samples()), plain.library("byte_bpe_50k.json")
    want = {i: plain.encoding(codes, plain.redacted(t, plain.secret_spans(t, model)[1])) for i, t in left.items() if i not in dirty}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and dirty


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    compare(spark, connect(d), d, queries.QUERIES[name], queries.SQL[name])
