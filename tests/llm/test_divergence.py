"""Distances between sources against plain Python, whatever the blocks."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabspark.llm import divergence
from tabspark.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs, most_terms):
    terms = [(lang or "", source or "", [t.translate({i: i + 32 for i in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    docs, counts, of_lang = Counter(), Counter(), Counter()
    for lang, source, ts in terms:
        docs.update((lang, t) for t in set(ts))
        counts.update((lang, source, t) for t in ts)
        of_lang.update((lang, t) for t in ts)
    out = set()
    for lang in {r[0] for r in terms}:
        kept = [t for (k, t), n in docs.items() if k == lang and n >= least_docs]
        sources = sorted({r[1] for r in terms if r[0] == lang})

        def shares(n):
            total = sum(n(t) for t in kept)
            return {t: 1 + 10**9 * (n(t) + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(lambda t: of_lang[lang, t])
        p = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            more = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(more)[:most_terms])):
                out.update((lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1))
    return out


def documents(n=300, n_sources=9, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Aa", "bé", "ß", "日本", "x", "Zz") for b in ("", "q", "ö", "k", "WW", " ")]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "x"])
        source = f"s{rng.randrange(n_sources)}" if lang != "x" else "only"
        body = rng.choice([" ", "-", "1", "\n", "[", "\x7f"]).join(rng.choices(words, [1 + (j * (int(source[1:]) if lang != "x" else 1)) % 7 for j in range(len(words))], k=rng.randrange(12)))
        rows.append((i, rng.choice([body, body, body, None]), lang, rng.choice([source, source, source, None])))
    return rows + rows[:5] + [(None, "Aa " * 50, "en", "hot")] * 40 + [(7, "", "zz", "empty"), (8, None, "zz", None)]


@pytest.mark.parametrize("groups,terms", [(256, 4096), (2, 5), (1, 1)])
def test_equals_plain_python_for_any_blocks(spark, groups, terms):
    rows = documents()
    got = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs=6, most_terms=4, groups_per_block=groups, terms_per_block=terms)
    assert {tuple(r) for r in got.collect()} == brute(rows, 6, 4)


def test_counts_leave_the_task_in_pieces(spark, monkeypatch):
    rows = documents(120) + [(900, "lang " * 3000 + "Ünïcode" * 400, "en", "s1")] * 6
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 50)
    monkeypatch.setattr(divergence, "TASK_TERMS", 3)
    batches = divergence._term_counts(iter(spark.createDataFrame([(r[2] or "", r[3] or "", r[1] or "") for r in rows], "lang string, source string, text string").toArrow().to_batches()))
    seen = Counter()
    for b in batches:
        for r in b.to_pylist():
            seen[r["lang"], r["source"], r["term"]] += r["n"]
    assert seen["en", "s1", "lang"] == 18000 and seen["en", "s1", "Ünïcode" * 400] == 6


def test_no_kept_terms_no_rows_and_clashing_columns(spark):
    rows = documents(40)
    none = source_divergence(spark.createDataFrame(rows, SCHEMA), least_docs=1000)
    assert {tuple(r) for r in none.collect()} == brute(rows, 1000, 50)
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("n"), F.lit("t").alias("term"), F.lit(2).alias("p"), F.lit(3).alias("own"))
    assert {tuple(r) for r in source_divergence(odd, least_docs=3, most_terms=2).collect()} == brute(rows, 3, 2)
