"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabspark.functions.session import written
from tabspark.llm.catalog import let_workers_import

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The result of every stage, and the documents before the first."""
    let_workers_import(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(-1, "%%% 123 !!!", "en", "src0", 11), (-2, None, "en", "src1", 0), (-3, "", None, None, 0)]
    out = [written(docs.union(spark.createDataFrame(junk, docs.schema)))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(tables):
    for df in tables[1:-1]:
        assert df.columns == tables[0].columns
    assert tables[-1].columns[: len(tables[0].columns)] == tables[0].columns


def test_language_keeps_letters(tables):
    assert ids(tables[0]) - ids(tables[1]) == Counter([-1, -2, -3])


def test_near_copies_go(tables):
    from test_operators import shingles

    rows = [(r.doc_id, shingles(r.text, 5)) for r in tables[1].collect()]
    label = {i: i for i, _ in rows}
    changed = True
    links = [(i, j) for i, a in rows for j, b in rows if i < j and a & b and 100 * len(a & b) >= 80 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert ids(tables[2]) == Counter(i for i in label if label[i] == i)


def test_benchmark_items_go(spark, tables):
    from test_operators import best_windows

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in tables[2].collect() if not list(best_windows(r.text, items))]
    assert ids(tables[3]) == Counter(clean)


def test_mixture_takes_effect(tables):
    from test_operators import words_of

    before = {r.doc_id: (r.source, len(words_of(r.text))) for r in tables[3].collect()}
    after = ids(tables[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    total = sum(n for _, n in before.values())
    assert sum(before[i][1] * k for i, k in after.items()) == pytest.approx(total, rel=0.1)


def test_shards_hold_all(tables):
    assert ids(tables[5]) == ids(tables[4])
    sums = tables[5].groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.first("shard_bytes").alias("s"), F.first("oversize").alias("o"))
    assert all(r.b == r.s and (r.b <= corpus_pipeline.SHARD_BYTES or r.o) for r in sums.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language"
