"""Only strings whose shared bytes stand twice are looked at one by one."""

import numpy as np
import pytest

from tabspark.llm import repeats
from tabspark.llm.catalog import let_workers_import

LENGTH = 40


@pytest.fixture(scope="module", autouse=True)
def imports(spark):
    let_workers_import(spark)


def strings_looked_at(spark, monkeypatch, texts):
    """Result rows, and how many strings were written for comparison."""
    sizes, write = [], repeats.written

    def spy(df):
        out = write(df)
        if "many" in df.columns and "string" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(repeats, "written", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs, length=LENGTH).collect()}, sum(sizes)


def test_short_passages_are_not_spelled_out(spark, monkeypatch):
    """A passage that is repeated, but is shorter than the strings asked for, gives equal heads and no repeat."""
    random = np.random.default_rng(3)
    noise = ["".join(random.choice(list("abcdefgh"), 60)) for _ in range(24)]
    passage = "".join(random.choice(list("xyz"), 28))
    found, looked = strings_looked_at(spark, monkeypatch, [n + passage + n[::-1] for n in noise])
    assert set(found.values()) == {0} and looked == 0


def test_ends_of_long_passages(spark, monkeypatch):
    """A passage one byte longer than the strings: all of it goes, and few strings beside it are looked at."""
    random = np.random.default_rng(4)
    noise = ["".join(random.choice(list("abcdefgh"), 60)) for _ in range(12)]
    passage = "".join(random.choice(list("xyz"), LENGTH + 1))
    texts = [str(i) + n + str(i % 10) * 2 + passage + "#" * (i + 1) + n[::-1] for i, n in enumerate(noise)]
    found, looked = strings_looked_at(spark, monkeypatch, [*texts, passage])
    assert all(n >= LENGTH + 1 for n in found.values()) and 0 < looked < 13 * (LENGTH - LENGTH // 2 + 1)
