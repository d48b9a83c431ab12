"""What the scoring model learns from and is scored with, whatever is held by every task."""

import copy

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import awkward

from tabspark.llm import attention, scoring
from tabspark.llm.attention import Attention, Pairs, Tokens, learn, log_probabilities, windows
from tabspark.llm.catalog import let_workers_import
from tabspark.llm.queries import public_vocabulary
from tabspark.llm.text import pieces

VOCABULARY = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module", autouse=True)
def imports(spark):
    let_workers_import(spark)


def test_rare_pairs_and_words_score_like_common_ones(spark, monkeypatch):
    docs = awkward(spark)

    def scores(most):
        monkeypatch.setattr(scoring, "COMMON", most)
        rows = scoring.score_texts(docs, F.col("doc_id") % 20 == 0, public_vocabulary(VOCABULARY), rounds=0, sample=1).collect()
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in rows)

    assert scores(1) == scores(100) == scores(1 << 20)


def test_every_text_is_learned_from(spark):
    texts = [f"{a}{b} " * 40 for a in "bcdfghklmnprst" for b in ("olume", "arvest", "idnight")]
    given = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string")
    path = public_vocabulary(VOCABULARY)
    model, _ = scoring.fit_text_model(given, path, rounds=2)
    encode = scoring.Subwords.of(path).encoding.encode_ordinary
    used = sorted({i for t in texts for i in encode(" " + t.split()[0])})
    fresh = scoring.Attention.fresh(scoring.Subwords.of(path).size, 5)
    assert (model.attention.embed[used] != fresh.embed[used]).any(1).all()


def test_words_after_a_text_add_up_to_at_most_one(spark):
    """All words of the training texts, of many ids and of one, and the end, after some contexts."""
    words = ["unbelievable", "xqzv", "the", "a,b", "é", "ab", "antidisestablishmentarianism", "12345", "of", "日本語", "x"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 30)) for _ in range(60)] + ["the of the of"] * 5
    given = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string")
    path = public_vocabulary(VOCABULARY)
    model, _ = scoring.fit_text_model(given, path)
    for context in ("", "the", "unbelievable x", " ".join(words * 4), "never seen qqq"):
        (piece,) = pieces(pa.array([f"{context} {w}".strip() for w in words] + [context]), 1 << 30)
        counts, attended, read = scoring._both(model, piece, path)
        of_word, of_end = attended[read.ends[:-1] - 2], attended[read.ends[-1] - 1]
        unigram = np.where(counts > 0, model.unigram(counts), 0.0)
        whole = model.share * unigram + (1 - model.share) * attended
        assert of_word.sum() + of_end <= 1 + 1e-6, context
        assert whole[read.ends[:-1] - 2].sum() + whole[read.ends[-1] - 1] <= 1 + 1e-6
        assert of_word.sum() + of_end > 0.2 or "qqq" in context  # nor is most of it lost after words that were learned


def test_ids_of_a_sort_add_up_to_one(spark):
    """The probabilities of all ids of either sort, after texts of a fitted model, by the formula and in one go."""
    texts = [f"{a}{b} {b} of{a}" * 9 for a in "bcdfgh" for b in ("olume", "arvest", "idnight")]
    given = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string")
    path = public_vocabulary(VOCABULARY)
    model, _ = scoring.fit_text_model(given, path, rounds=2)
    vocabulary = scoring.Subwords.of(path)
    before = vocabulary.encoding.encode_ordinary(" volume of")
    every = np.arange(vocabulary.size)
    first = every[model.attention.leads]
    # As many texts as ids: the words before, then one id that begins a token.
    ids = np.concatenate([[*before, i] for i in first])
    n = len(before) + 1
    starts = [i for i in range(len(before)) if vocabulary.after_space[before[i]]] + [len(before)]
    stops = np.array([*starts[1:], n])
    ends = (np.arange(len(first))[:, None] * n + stops).ravel()
    tokens = Tokens(ids, ends, np.arange(1, len(first) + 1) * len(stops), vocabulary.end)
    logs = log_probabilities(model.attention, model.pairs, tokens).reshape(len(first), -1)[:, -1]
    ending = np.where(first == vocabulary.end, 1.0, model.pairs.sort(first, np.zeros(len(first), np.int64)))
    assert (np.exp(logs) / ending).sum() == pytest.approx(1, abs=1e-5)


def test_as_many_keys_are_held_as_may_be(spark, monkeypatch):
    """By rank, not only those above a fixed share of all: 20 of 31 keys, the most common ones."""
    monkeypatch.setattr(scoring, "COMMON", 20)
    texts = [f"w{i}q" for i in range(1, 31) for _ in range(i)]
    given = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string")
    model, _ = scoring.fit_text_model(given, public_vocabulary(VOCABULARY), rounds=0, sample=1)
    assert sorted(model.common_counts.tolist()) == [*range(12, 31), len(texts)]
    assert 0 < len(model.pairs.keys) <= 20


def _few_texts(n=30):
    """Texts of tokens of one to four ids, each ended by id 0; every id but 0 either begins tokens or goes on."""
    random = np.random.default_rng(7)
    ids, ends, texts = [], [], []
    for _ in range(n):
        for _ in range(random.integers(0, 70)):
            ids += [random.integers(1, 20), *random.integers(20, 40, random.integers(0, 4))]
            ends.append(len(ids))
        ids.append(0)
        ends.append(len(ids))
        texts.append(len(ends))
    return Tokens(np.array(ids), np.array(ends), np.array(texts), 0)


def test_learning_expects_what_single_ids_give():
    """The expected counts of one step against the formula, id by id; the parts are added up once for all pieces."""
    tokens = _few_texts()
    model = Attention.fresh(40, 3, np.arange(40) < 20)
    model.parts = np.random.default_rng(4).random(model.parts.shape).astype(np.float32)
    model.parts /= model.parts.sum(0)
    assert model.mass is model.mass
    old, none = copy.deepcopy(model), np.zeros((40, 2), np.int64)
    pairs = Pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), none, none)
    soft, follow = np.zeros_like(model.parts), np.zeros((2, 2))
    logs = learn(model, pairs, tokens, soft, follow, 0.1, step=1 << 20)
    assert logs == pytest.approx(log_probabilities(old, pairs, tokens), abs=1e-4)
    x = attention._inputs(old, tokens)
    at, scored = windows(tokens.texts)
    w = attention.forward(old, x, attention.project(old, x), at)[0][scored >= 0]
    want = np.zeros_like(soft)
    for i, token in zip(tokens.ids, tokens.owner):  # without pairs, all of the probability is that of attention
        want[i] += w[token] * old.parts[i] / (w[token] @ old.parts[i])
    assert soft == pytest.approx(want, rel=1e-4)
    ids = np.unique(tokens.ids)
    assert (model.embed[np.setdiff1d(ids, [0])] != old.embed[np.setdiff1d(ids, [0])]).any(1).mean() > 0.9


@pytest.mark.parametrize("most", [3, 1 << 40, 1 << 62])
def test_keys_are_told_apart_in_any_range(most):
    keys = np.random.default_rng(2).integers(0, most, 500) // (most // 3) * (most // 3)
    found = attention.told_apart(keys)
    for mine, plain in zip(found, np.unique(keys, return_index=True, return_inverse=True, return_counts=True)):
        assert mine.tolist() == plain.tolist()
    assert [len(x) for x in attention.told_apart(keys[:0])] == [0] * 4


def test_words_of_one_slot_keep_their_ids(monkeypatch):
    monkeypatch.setattr(scoring, "KNOWN_WORDS", 1)
    vocabulary = scoring.Subwords(public_vocabulary(VOCABULARY))
    for _ in range(2):
        for text in ("unbelievable the xqzv of", "The volume of a text", "of xqzv", ""):
            (piece,) = pieces(pa.array([text, text + " more"]), 1 << 30)
            monkeypatch.setitem(scoring.Subwords._of, "few slots", vocabulary)
            read = scoring._read(piece, "few slots")
            want = []
            for row in (text, text + " more"):
                want += [i for w in row.lower().split() for i in vocabulary.encoding.encode_ordinary(" " + w)] + [vocabulary.end]
            assert read.tokens.ids.tolist() == want
    assert len(vocabulary.slots) == 4
