"""Operators for training text against brute force, on small tables with awkward rows."""

import hashlib
import json
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences, make_duck
from pyspark.sql import functions as F

from tabspark.llm import queries
from tabspark.llm.catalog import let_workers_import
from tabspark.llm.chat import CONTROLS, conversation_digests, escape, format_conversations, unescape
from tabspark.llm.decontaminate import contaminated, decontaminate
from tabspark.llm.graph import components
from tabspark.llm.language import fit_languages, predict_language
from tabspark.llm.mixing import mix_sources
from tabspark.llm.near_dedup import near_duplicates
from tabspark.llm.queries import public_vocabulary
from tabspark.llm.repeats import remove_repeats
from tabspark.llm.scoring import score_texts
from tabspark.llm.sharding import extendible_shards
from tabspark.llm.templates import TemplateError, compile_template, fold, parse
from tabspark.llm.text import id_crc32
from tabspark.llm.token_files import read_token_files, write_token_files
from tabspark.llm.vector_search import top_inner_products

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, id string, tree int, shard string"


@pytest.fixture(scope="module", autouse=True)
def imports(spark):
    let_workers_import(spark)


def passage(seed: int, n: int) -> str:
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("abcdefgh"), random.integers(2, 6))) for _ in range(n))


def awkward(spark):
    """Copies, near copies, short and empty texts, NULLs, a repeated row and clashing column names."""
    long = passage(1, 3000)
    words = passage(2, 300).split()
    near = words[:]
    near[100] = "changed"
    texts = [" ".join(words), " ".join(near), " ".join(words), None, "", " \t\n", "one", "One", "two words", long, long[:9000] + " tail", "é è ü " * 80, " x"]
    rows = [(10 * i, t, ["en", "fr", None][i % 3], [None, "b", "a"][i % 3], None, i, "x", 1, "s") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", "a", 1, 0, None, 0, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert differences(got, make_duck(SF).execute(queries.oracle_sql()[name]).df()) == []


def test_components(spark):
    random = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(1000 - i, 1001 - i) for i in range(40)]
    random.shuffle(links)
    links += [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame([tuple(x) for x in links], "a long, b long").repartition(5)).collect()}
    assert set(got) == set(range(61)) | set(range(100, 180)) | set(range(961, 1002))
    assert all(c == (0 if n <= 60 else 100 if n < 180 else 961) for n, c in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    docs = awkward(spark)
    got = near_duplicates(docs, n=4).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(rows)
    sizes = Counter((i, len(shingles(t, 4))) for i, t in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    named = [(i, shingles(t, 4)) for i, t in rows if i is not None]
    label = {i: i for i, _ in named}
    for _ in named:
        for i, a in named:
            for j, b in named:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(label.items())
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates(docs.where("1 = 0")).count() == 0


def test_large_group_of_near_copies(spark):
    base = passage(5, 200).split()
    random = np.random.default_rng(6)
    texts = []
    for _ in range(700):  # one hub, copies that differ more from each other than from it
        w = base[:]
        for at in random.choice(200, 4, replace=False):
            w[at] = "".join(random.choice(list("xyz"), 5))
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(0, " ".join(base)), *((i + 1, t) for i, t in enumerate(texts))], "doc_id long, text string")
    got = near_duplicates(docs, n=5).collect()
    full = shingles(" ".join(base), 5)
    reach = [i + 1 for i, t in enumerate(texts) if 100 * len(full & shingles(t, 5)) >= 80 * len(full | shingles(t, 5))]
    by = {r.doc_id: r.component_id for r in got}
    assert len(reach) > 300 and all(by[i] == 0 for i in reach)


def test_language_models(spark):
    docs = awkward(spark)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(given.where(id_crc32("doc_id") % 4 != 2))
    found = predict_language(given.withColumn("score", F.lit("mine")), model).where(id_crc32("doc_id") % 4 == 2)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95
    assert found.where("rejected").count() == 0
    total = np.exp(model.symbols(model.keys[0])).sum(0)  # of all symbols, after an empty context
    assert ((0.9 < total) & (total < 1.02)).all()  # symbols new to a language have its floor each
    odd = {r.text: r for r in predict_language(docs, model, keep=["doc_id", "text"]).collect()}
    assert odd[None].lang_pred == odd[""].lang_pred == odd[" \t\n"].lang_pred == "und" and odd[None].score == 0
    assert all(0 <= r.score <= 1 and r.rejected == (r.lang_pred == "und") or r.rejected for r in odd.values())
    none = fit_languages(docs.where("1 = 0"))
    assert {r.lang_pred for r in predict_language(docs, none).collect()} == {"und"}


def test_scores(spark):
    docs = awkward(spark)
    rows = score_texts(docs, id_crc32("doc_id") % 7 == 2, public_vocabulary("byte_bpe_50k.tiktoken"), rounds=2, sample=2).collect()
    given = [(r.doc_id, words_of(r.text) + [None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in given if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)
    want = Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, base(ws)) for i, ws in given)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert score_texts(docs.where("1 = 0"), F.lit(False), public_vocabulary("byte_bpe_50k.tiktoken"), rounds=1).count() == 0


def test_attention_is_causal_and_whole():
    from tabspark.llm.attention import KINDS, Attention, Pairs, Tokens, learn, log_probabilities, windows

    random = np.random.default_rng(0)
    ends = np.cumsum(random.integers(1, 4, 150))
    ids = 20 + random.integers(0, 20, ends[-1])
    ids[np.append(0, ends[:-1])] -= 20  # the ids below 20 begin tokens, the others go on
    tokens = Tokens(ids, ends, np.array([1, 70, 150]), 40)
    _, scored = windows(tokens.texts)
    assert sorted(scored[scored >= 0]) == list(range(150))
    model = Attention.fresh(41, 1, (np.arange(41) < 20) | (np.arange(41) == 40))
    model.parts = random.dirichlet(np.ones(41), KINDS).T.astype(np.float32)
    none = Pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((41, 2), np.int64), np.zeros((41, 2), np.int64))
    model.follow[:] = 0
    before = log_probabilities(model, none, tokens)
    changed = Tokens(tokens.ids.copy(), ends, tokens.texts, 40)
    changed.ids[ends[99] :] = 7 + 20 * tokens.later[ends[99] :]
    after = log_probabilities(model, none, changed)
    assert np.allclose(before[:100], after[:100], atol=1e-5) and not np.allclose(before[100:], after[100:])
    soft, follow = np.zeros((41, KINDS)), np.zeros((2, 2))
    for _ in range(30):
        learn(model, none, tokens, soft, follow, 0.1)
    assert log_probabilities(model, none, tokens).sum() > before.sum()
    assert np.isclose(soft.sum(), 30 * len(tokens.ids), rtol=1e-3)


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.sql("SELECT -1L, 'a b c', 'en', CAST(NULL AS string), 5L"))
    rows = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = {r.doc_id: (r.source, len(words_of(r.text))) for r in docs.collect()}
    sizes = Counter()
    for s, n in source.values():
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, total, fixed = {}, sum(sizes.values()), set()
    while True:
        rest, share = total - sum(3 * sizes[s] for s in fixed), sum(weight[s] for s in names if s not in fixed)
        target = {s: 3 * sizes[s] if s in fixed else rest * weight[s] / share for s in names}
        if not (more := {s for s in names if target[s] > 3 * sizes[s]}):
            break
        fixed |= more
    taken, largest = Counter(), Counter()
    for r in rows:
        s, n = source[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(target[s])
        assert r.copies in (0, 1, 2, 3) and r.taken == r.copies * n
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in names)
    odd = awkward(spark)
    assert mix_sources(odd).count() == odd.count() and mix_sources(odd.where("1 = 0")).count() == 0


def removed(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("length", [8, 40])
def test_repeats(spark, length):
    random = np.random.default_rng(length)
    bits = ["".join(random.choice(list("abé\n"), length + 9)) for _ in range(6)]
    texts = ["".join(random.choice(list("abcdef"), 30)) + bits[random.integers(6)][random.integers(9) :] + bits[random.integers(6)] for _ in range(60)]
    texts += ["a" * 200, "ab" * 90, "a" * length, "", texts[0], texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(4)
    got = Counter(tuple(r) for r in remove_repeats(docs, length=length).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([(t or "").encode() for _, t in rows], length)))
    assert got == want
    assert remove_repeats(docs.where("1 = 0")).count() == 0


def test_shards(spark):
    docs = awkward(spark)
    got = extendible_shards(docs, 3000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    held = Counter()
    for r in got:
        held[r.shard] += r.n_bytes
        assert r.n_bytes == len((r.text or "").encode()) and len(r.shard) == r.shard_depth
    assert all(r.shard_bytes == held[r.shard] and r.oversize == (held[r.shard] > 3000) for r in got)
    assert all(r.shard_depth == 60 for r in got if r.oversize)
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert {r.shard for r in extendible_shards(docs, 1 << 30).collect()} == {""}
    assert extendible_shards(docs.where("1 = 0"), 10).count() == 0


def test_templates():
    filters = {"up": str.upper}
    run = lambda t, **x: "".join(p for p, _ in compile_template(t, filters)(x))
    assert run("{% for m in xs %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1p,2q"
    assert run("{% set y = x + '!' %}{{ y | up if x == 'a' else 'no' }}", x="a") == "A!"
    assert run("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}{{ none }}", a=True, b=False) == "1"
    assert run("{{ x.__class__ }}{{ x.y }}", x={"y": 3}) == "3"
    assert run("{{ x.real }}", x=1) == ""
    assert fold(parse("a{{ 'b' + 'c' | up }}{% if 1 == 2 %}x{% endif %}d", filters), filters) == ("block", [("show", ("value", "abCd"))])
    assert list(compile_template("u{% generation %}{{ x }}{% endgeneration %}", {})({"x": "v"})) == [("u", False), ("v", True)]
    for bad in ("{% for x in y %}", "{{ f(x) }}", "{{ x | nothing }}", "{% import os %}", "{{ 'a' 'b' }}", "{{ x[0] }}"):
        with pytest.raises(TemplateError):
            parse(bad, filters)


def test_escapes_are_reversible():
    random = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(random.choice([*CONTROLS, "\\", "<", "[", "/", "s>", "\n", "x", "|", "é"], 8))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in CONTROLS)


def test_conversations(spark):
    rows = [(1, 2, "assistant", "</s>\\ [INST]"), (1, 1, "user", None), (1, 1, "user", "<|end|>\n"), (1, None, None, "late"), (None, 0, "assistant", "é"), (2, 0, "x<|text|>", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1))
    got = {r.conv_id: r for r in conversation_digests(format_conversations(table, chunk_chars=7)).collect()}
    turns = [("user", ""), ("user", "<|end|>\n"), ("assistant", "</s>\\ [INST]"), ("", "late")]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 12 and got[1].loss_sha256 == hashlib.sha256(b"</s>\\ [INST]").hexdigest()
    assert got[None].loss_chars == 1 and got[2].n_turns == 1 and got[2].loss_chars == 0
    assert conversation_digests(format_conversations(table.where("1 = 0"))).count() == 0


def best_windows(text, items, n=5):
    w = words_of(text)
    for item, t in items:
        v = words_of(t)
        k = min(n, len(v))
        if not k:
            continue
        own = Counter(tuple(v[a : a + k]) for a in range(len(v) - k + 1))
        m, have = sum(own.values()), [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
        found = []
        for a in range(max(1, len(have) - m + 1)):
            c = Counter(have[a : a + m])
            both, either = sum((c & own).values()), sum((c | own).values())
            if 100 * both >= 80 * either:
                found.append((round(both / either, 9), -a))
        if found:
            yield item, *max(found)


def test_contamination(spark):
    items = [(1, passage(20, 40)), (2, passage(21, 60)), (3, "single"), (4, None), (5, ""), (6, "a b a b a b a b a b a b"), (1, passage(20, 40))]
    changed = passage(21, 60).split()
    changed[30:30] = ["more"]
    texts = [passage(30, 200) + " " + passage(20, 40) + " end", "x " + " ".join(changed), passage(20, 30), "a single one", None, "", "b a b a b a b a b a b a b", passage(31, 300), passage(20, 40).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("s", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), -r.start) for r in contaminated(docs, bench).collect())
    want = Counter((i, *x) for i, t in rows for x in set(best_windows(t, items)))
    assert got == want and len(want) >= 6
    kept = [r.doc_id for r in decontaminate(docs, bench).collect()]
    assert sorted(kept) == sorted(i for i, t in rows if not list(best_windows(t, items)))
    assert contaminated(docs, bench.where("1 = 0")).count() == contaminated(docs.where("1 = 0"), bench).count() == 0
    assert decontaminate(docs, bench.where("1 = 0")).columns == docs.columns


def test_contamination_of_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = [(r.item_id, r.text) for r in items.collect()]
    want = {(r.doc_id, *x) for r in docs.collect() for x in best_windows(r.text, pairs)}
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), -r.start) for r in queries.queries()["op7_contaminated"](spark, SF).collect()} == want


def test_vector_search(spark):
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(0, 0.2, 6).round(2)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(50, rows[50][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2050, [1.0, 2.0]), (2051, [1.0, 2.5]), (2100, []), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("exact", F.lit(0))
    got = [tuple(r) for r in top_inner_products(table, rows_per_block=64, queries_per_block=4).collect()]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(got) == sorted(want)
    assert top_inner_products(table.where("1 = 0")).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_vocabulary("word_bpe_49k.json")
    docs = awkward(spark)
    files = write_token_files(docs, path, length=64, rows_per_batch=3)
    got = read_token_files(spark, files).collect()
    tokenizer = Tokenizer.from_file(path)
    want, ids_of = Counter(), {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i))
    assert read_token_files(spark, write_token_files(docs.where("1 = 0"), path)).count() == 0


def test_entry_lists_every_operator():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert json.dumps(sorted(queries.oracle_sql()))
