"""Stages of the pipeline on rows without an id and rows that share one."""

from collections import Counter

import pytest
from test_operators import passage, words_of

import corpus_pipeline
from tabspark.llm.catalog import let_workers_import


@pytest.fixture(scope="module")
def docs(spark):
    let_workers_import(spark)
    texts = [passage(i, 200) for i in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (6, texts[5]), (7, texts[5] + " end"), (8, "")]
    return spark.createDataFrame([(i, t, "en", "abc"[n % 3], len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_dedup_keeps_different_texts(spark, docs):
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, ""))
    wanted = Counter({k: 1 for k in rows_of(docs)})
    assert got == wanted - Counter([next(k for k in wanted if k[0] == 7)])


def test_mixture_takes_each_row_by_its_own_decision(spark, docs):
    from tabspark.llm.mixing import mix_sources

    assert sum(rows_of(corpus_pipeline.mixture(spark, docs, "")).values()) == sum(r.copies for r in mix_sources(docs).collect())
    got, given = rows_of(corpus_pipeline.mixture(spark, docs, "")), rows_of(docs)
    assert set(got) <= set(given) and all(n <= 3 * given[k] for k, n in got.items())
    total = sum(n * len(words_of(k[1])) for k, n in given.items())
    assert sum(n * len(words_of(k[1])) for k, n in got.items()) == pytest.approx(total, abs=3 * 101)
