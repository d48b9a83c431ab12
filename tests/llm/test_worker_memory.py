"""What tasks of the pipeline hold beside the documents themselves."""

import re

from pyspark.sql import functions as F

from tabspark.llm import mixing, text
from tabspark.llm.catalog import let_workers_import
from tabspark.llm.language import fit_languages, predict_language


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_word_count_is_that_of_runs_of_other_bytes(spark):
    texts = [None, "", " ", "\t\n\v\f\r ", "a", " a b ", "a b c d", "\x1c\x1d x\x85y", "\U0001f600 z\n\n" * 50, "w" * 100_000 + " " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in rows.select("i", text.word_count(F.col("t")).alias("n")).sort("i").collect()]
    assert got == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]


def test_mix_sends_no_document_to_python(spark, monkeypatch):
    plans, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df: plans.append(_plan(df)) or written(df))
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, None), (3, "d e", "y")], "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, keep=docs.columns)
    assert found.count() == 3 and plans
    assert not any("MapInArrow" in p for p in [*plans, _plan(found)])


def test_a_kept_text_goes_to_the_task_once(spark):
    let_workers_import(spark)
    docs = spark.createDataFrame([(1, "some words here", "en"), (2, "andere worte dort", "de"), (3, None, None)], "doc_id long, text string, lang string")
    found = predict_language(docs, fit_languages(docs), keep=docs.columns)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    below = _plan(found).split("MapInArrow")[1].split("Project")[1]
    assert len(re.findall(r"\btext#\d+ AS", below.split("+-")[0])) == 1
    assert sorted(r[:3] for r in found.collect()) == sorted(tuple(r) for r in docs.collect())


def test_tables_of_powers_stay_small(spark):
    assert sum(p.nbytes for p in text.powers(1)) <= 1 << 24
    usual = text.powers(1)
    text.powers(1 << 20)
    assert text.powers(1)[0] is usual[0]
