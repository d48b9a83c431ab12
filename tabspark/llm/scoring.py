"""Log probabilities of whole texts by a self-attention model, beside a word unigram."""

from __future__ import annotations

import base64
import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import fresh_dir, local_table, written

from .attention import KINDS, NAMES, Attention, Pairs, Tokens, learn, log_probabilities, looked_up, of_own_row, told_apart
from .text import Piece, mix, pieces, word_hashes, words
from .token_files import _room

Batches = Iterator[pa.RecordBatch]
END = mix(np.array([0x0E4D0F7E87], np.uint64))[0]  # stands for the end token among hashes of words
COMMON = 1 << 20
SHARES = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98])
_GRAM = 1 << 16
HELD = 1 << 20  # keys that a task adds up before it lets them go
KNOWN_WORDS = 1 << 19


@dataclass
class Read:
    """The tokens of a piece: words and the end of every row. ``hashes`` are those of the different tokens
    (the end first), ``counts`` how often each occurs, ``tokens`` their subword ids with ``tokens.which``
    among the different ones, ``ends`` where rows end."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: Tokens
    ends: np.ndarray


def _read(piece: Piece, tokenizer: str) -> Read:
    found = words(piece)
    ends = found.bounds[1:] + np.arange(1, piece.rows + 1)
    which = np.zeros(int(ends[-1]), np.int64)
    word = np.ones(len(which), bool)
    word[ends - 1] = False
    hashes = word_hashes(piece, found)
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    begins = np.flatnonzero(new)
    different, first, counts = hashes[begins], order[begins], np.diff(begins, append=len(order))
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new)
    which[word] = same
    vocabulary = Subwords.of(tokenizer)
    flat, begins = vocabulary.ids(different, piece.data.tobytes().lower(), found.starts[first], found.ends[first])
    sizes = np.diff(begins)[which]
    stop = np.cumsum(sizes)
    ids = flat[np.repeat(begins[which] - (stop - sizes), sizes) + np.arange(int(stop[-1]))]
    tokens = Tokens(ids, stop, ends, vocabulary.end, which, flat, begins[:-1])
    return Read(np.concatenate([[END], different]), np.concatenate([[piece.rows], counts]), tokens, ends)


WORD, PAIR = 0, 1


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def _counts(tokenizer: str) -> Callable[[Batches], Batches]:
    """Counts of words and of pairs of subword ids, added up over pieces."""

    def run(batches: Batches) -> Batches:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], PAIR: []}

        def out(kind: int) -> pa.RecordBatch:
            k, n = _added(held[kind])
            held[kind] = []
            return pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], names=["kind", "key", "n"])

        for b in batches:
            for piece in pieces(b.column(0)):
                read = _read(piece, tokenizer)
                before, ids = read.tokens.before, read.tokens.ids
                held[WORD].append((read.hashes.view(np.int64), read.counts))
                held[PAIR].append(np.unique(before << 32 | ids, return_counts=True))
                for kind, parts in held.items():
                    if sum(len(k) for k, _ in parts) > HELD:
                        held[kind] = [_added(parts)]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield out(kind)
        for kind, parts in held.items():
            if parts:
                yield out(kind)

    return run


@dataclass
class TextModel:
    """Word counts of the training texts, the attention model and the weight between them.

    ``common`` are the most common words, by a least count such that there are at most 2^20 of them, as
    sorted hashes, with their counts; ``pairs`` holds as many of the most common pairs of subword ids. Both are only what every task knows: the counts of the rarer ones come with the texts that
    hold them (``MORE``). ``share`` is the weight of the word unigram.
    """

    total: int
    different: int
    common: np.ndarray
    common_counts: np.ndarray
    pairs: Pairs
    attention: Attention
    share: float
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    more_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words, 0 for those that are neither common nor come with the texts."""
        return looked_up(self.common, self.common_counts, hashes) + looked_up(self.more, self.more_counts, hashes)

    def beside(self, more: pa.Array) -> "TextModel":
        """The model for some texts, with the counts that come with them."""
        kind, key, n = (x.to_numpy(zero_copy_only=False) for x in more.flatten().flatten())
        words, first = np.unique(key[kind == WORD].view(np.uint64), return_index=True)
        keys, at = np.unique(key[kind == PAIR], return_index=True)
        pairs = replace(self.pairs, more=keys, more_counts=n[kind == PAIR][at])
        return replace(self, pairs=pairs, more=words, more_counts=n[kind == WORD][first])

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.different + 1)


MORE = "array<struct<kind: int, key: long, n: long>>"


def _rare(tokenizer: str, held) -> Callable[[Batches], Batches]:
    """(place, text) to (place, kind, key): the words and pairs of each text that not every task knows."""

    def run(batches: Batches) -> Batches:
        model: TextModel = held.value
        for b in batches:
            place = b.column(0).to_numpy()
            for piece in pieces(b.column(1), _GRAM * 8):
                read = _read(piece, tokenizer)
                tokens, row = read.tokens, np.repeat(np.arange(piece.rows), np.diff(read.ends, prepend=0))
                _, first, same, _ = told_apart(tokens.before * len(model.pairs.before) + tokens.ids)
                pairs = tokens.before[first] << 32 | tokens.ids[first]
                unknown = looked_up(model.pairs.keys, model.pairs.counts, pairs) == 0
                for kind, keys, rare, at, rows in (
                    (WORD, read.hashes.view(np.int64), model.counts(read.hashes) == 0, tokens.which, row),
                    (PAIR, pairs, unknown, same, row[tokens.owner]),
                ):
                    mine = rare[at]
                    once = np.unique(rows[mine] * len(keys) + at[mine])
                    columns = [place[piece.first + once // len(keys)], np.full(len(once), kind, np.int32), keys[once % len(keys)]]
                    yield pa.record_batch([pa.array(x) for x in columns], names=["place", "kind", "key"])

    return run


def _least_count(counts: DataFrame, total: int) -> int:
    """The least count of which, and of more, there are at most ``COMMON`` keys. Keys of one in ``COMMON`` of all
    are no more than that, so only lower counts are told apart: ``total / COMMON`` values."""
    high = -(-total // COMMON)
    found = counts.groupBy(F.least("n", F.lit(high)).alias("n")).agg(F.count("*").alias("keys")).collect()
    least, keys = high, 0
    for r in sorted(found, key=lambda r: -r["n"]):
        keys += r["keys"]
        if keys > COMMON:
            break
        least = r["n"]
    return least


def _with_counts(given: DataFrame, every: DataFrame, model: TextModel, least: tuple[int, int], tokenizer: str) -> DataFrame:
    """Add ``more``: the counts of all words and pairs of each row's ``text`` that are rarer than
    ``least`` (of words, of pairs), from a join with the full tables.

    Rows meet what belongs to them by a hash of the text, so equal texts share it; where two texts had
    one hash, each would come with the counts of both, which are right for either.
    """
    held = given.sparkSession.sparkContext.broadcast(model)
    placed = given.withColumn("place", F.xxhash64("text"))
    wanted = placed.select("place", "text").mapInArrow(_rare(tokenizer, held), "place long, kind int, key long").distinct()
    rare = every.where(F.col("n") < F.when(F.col("kind") == WORD, least[WORD]).otherwise(least[PAIR]))
    met = wanted.join(rare, ["kind", "key"]).groupBy("place").agg(F.collect_list(F.struct("kind", "key", "n")).alias("more"))
    return placed.join(written(met), "place", "left").drop("place").withColumn("more", F.coalesce("more", F.array().cast(MORE)))


# Fixed value: the public pattern by which this vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Subwords:
    """Subword ids of lower-cased words, each taken after a space, by a file of ranks. The id after the
    last rank ends a text. Words met before are not encoded again; the memory for them is bounded."""

    _of: dict[str, "Subwords"] = {}

    def __init__(self, path: str):
        import tiktoken

        store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name) as file:
            lines = [line.split() for line in file.read().splitlines()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.after_space = np.zeros(self.size, bool)
        self.after_space[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.encoding = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    @classmethod
    def of(cls, path: str) -> "Subwords":
        """One per worker process and file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _reset(self) -> None:
        self.slots = np.full(4 * KNOWN_WORDS, -1, np.int32)  # by low bits of a hash, the last word that took the slot
        self.n = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.begins = np.zeros(1025, np.int64)
        self.flat = np.zeros(1024, np.int64)

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has. Words without white space of any kind go
        together: every one of them begins with the one id that begins with a space."""
        if (text := " ".join(new)).split() == new:
            flat = np.array(self.encoding.encode_ordinary(" " + text), np.int64)
            return flat, np.diff(np.append(np.flatnonzero(self.after_space[flat]), len(flat)))
        alone = [self.encoding.encode_ordinary(" " + w) for w in new]
        return np.array([i for x in alone for i in x], np.int64), np.array([len(x) for x in alone])

    def ids(self, hashes: np.ndarray, lower: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the end and of different words end to end, and where each begins. The words are given by
        their hashes and by where they stand in the lower-cased bytes."""
        slots = (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        at = self.slots[slots].astype(np.int64)
        new = np.flatnonzero((at < 0) | (self.hashes[at] != hashes))
        if len(new):
            if self.n and self.n + len(new) > KNOWN_WORDS:
                self._reset()
                new = np.arange(len(hashes))
            places = zip(starts[new].tolist(), stops[new].tolist())
            flat, counts = self._encode([lower[a:b].decode("utf-8", "replace") for a, b in places])
            n, to, used = self.n, self.n + len(new), int(self.begins[self.n])
            self.hashes, self.begins = _room(self.hashes, to), _room(self.begins, to + 1)
            self.flat = _room(self.flat, used + len(flat))
            self.hashes[n:to], self.begins[n + 1 : to + 1] = hashes[new], used + np.cumsum(counts)
            self.flat[used : used + len(flat)] = flat
            at[new] = np.arange(n, to)
            self.slots[slots[new]] = at[new]
            self.n = to
        sizes = np.append(1, self.begins[at + 1] - self.begins[at])
        begins = np.append(0, np.cumsum(sizes))
        flat = np.full(int(begins[-1]), self.end, np.int64)
        flat[1:] = self.flat[np.repeat(self.begins[at] - begins[1:-1], sizes[1:]) + np.arange(1, len(flat))]
        return flat, begins


def _train(tokenizer: str, held, held_model, rate: float) -> Callable[[Batches], Batches]:
    """Texts to changes of the parameters, as rows (kind, row, weight, values) to be added up."""

    def run(batches: Batches) -> Batches:
        old: Attention = held.value
        model = copy.deepcopy(old)
        soft, follow, shares, n = np.zeros_like(model.parts), np.zeros((2, 2)), np.zeros(len(SHARES)), 0
        for b in batches:
            counted = held_model.value.beside(b.column(1))
            for piece in pieces(b.column(0), _GRAM):
                read = _read(piece, tokenizer)
                attended = np.exp(learn(model, counted.pairs, read.tokens, soft, follow, rate))
                shares += _likelihoods(counted, read, attended)
                n += len(read.tokens.ids)
        if not n:
            return
        rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        used = np.flatnonzero(soft.sum(1))
        rows.append(("parts", used, np.ones(len(used)), soft[used]))
        moved = np.flatnonzero((model.embed != old.embed).any(1))
        weight = np.maximum(soft[moved].sum(1), 1e-3)
        rows.append(("embed", moved, weight, (model.embed - old.embed)[moved] * weight[:, None]))
        for name in ("query", "key", "value", "gate"):
            change = getattr(model, name) - getattr(old, name)
            rows.append((name, np.arange(len(change)), np.full(len(change), n), change * n))
        rows.append(("follow", np.arange(2), np.ones(2), follow))
        rows.append(("share", np.arange(len(SHARES)), np.ones(len(SHARES)), shares[:, None]))
        rows.append(("recency", np.array([0]), np.array([n]), (model.recency - old.recency)[None] * n))
        for name, at, weight, values in rows:
            if len(at):
                wide = np.zeros((len(at), KINDS))
                wide[:, : values.shape[1]] = values
                columns = [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(np.asarray(weight, np.float64))]
                columns += [pa.array(np.ascontiguousarray(wide[:, j])) for j in range(KINDS)]
                yield pa.record_batch(columns, names=["kind", "row", "weight", *[f"v{j}" for j in range(KINDS)]])

    return run


def _likelihoods(model: TextModel, read: Read, attended: np.ndarray) -> np.ndarray:
    """Log likelihood of learned texts for each weight between unigram and attention."""
    counts = model.counts(read.hashes)[read.tokens.which] - of_own_row(read.tokens.which, read.tokens.row)
    known = np.where(counts > 0, model.unigram(counts), 0.0)
    return np.array([np.log(share * known + (1 - share) * attended + 1e-300).sum() for share in SHARES])


def _both(model: TextModel, piece: Piece, tokenizer: str) -> tuple[np.ndarray, np.ndarray, Read]:
    """For every token: the count of its word, its probability by attention; and the piece read."""
    read = _read(piece, tokenizer)
    logs = log_probabilities(model.attention, model.pairs, read.tokens)
    return model.counts(read.hashes)[read.tokens.which], np.exp(logs), read


def fit_text_model(given: DataFrame, tokenizer: str, rounds: int = 10, sample: int = 50, rate: float = 0.1, seed: int = 5) -> tuple[TextModel, DataFrame]:
    """Fit the model on the rows of ``given`` (id, held_out, text) that are not held out; also all its rows
    with ``more``, the counts of their rarer words and pairs.

    Counts of words and of pairs of ids are over all texts. The attention is trained in rounds of local steps, whose changes are
    added up by parameter row. Texts are dealt into ``sample`` lots and the lots over the rounds, so every text
    is learned from. While all parts are equal they give the attention no direction, so the first lot comes
    once more in the end. The weight of the unigram is that of highest likelihood of all texts, each
    by the parameters before the steps that learn from it; a later round weighs twice the one before.
    """
    spark = given.sparkSession
    train = given.where(~F.col("held_out")).select("text")
    every = train.mapInArrow(_counts(tokenizer), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    every = written(every)
    counts = every.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least_word = _least_count(counts, total)
    common = counts.where(F.col("n") >= least_word).toArrow()
    hashes = common.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = Subwords.of(tokenizer)
    size, leads = vocabulary.size, vocabulary.after_space.copy()
    leads[vocabulary.end] = True
    attention, (pairs, least_pair) = Attention.fresh(size, seed, leads), _pairs(every, size, leads)
    model = TextModel(total, different, hashes[order], common.column("n").to_numpy()[order], pairs, attention, 0.5)
    soft = np.zeros_like(attention.parts, dtype=np.float64)
    shares = np.zeros(len(SHARES))
    lot = F.pmod(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(sample)), F.lit(max(rounds, 1)))
    path = fresh_dir(spark, "counted")
    counted = _with_counts(given, every, model, (least_word, least_pair), tokenizer).withColumn("lot", F.when(F.col("held_out"), -1).otherwise(lot).cast("int"))
    counted.write.partitionBy("lot").parquet(path)
    counted = spark.read.schema(f"id long, held_out boolean, text string, more {MORE}, lot int").parquet(path)
    held_model = spark.sparkContext.broadcast(model)
    columns = ["kind string", "row int", "weight double", *[f"v{j} double" for j in range(KINDS)]]
    for i, own in enumerate([*range(rounds), *range(min(rounds, 1))]):
        held = spark.sparkContext.broadcast(attention)
        drawn = counted.where(F.col("lot") == own).select("text", "more")
        changes = drawn.mapInArrow(_train(tokenizer, held, held_model, rate), ", ".join(columns))
        sums = changes.groupBy("kind", "row").agg(F.sum("weight").alias("w"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(KINDS)])
        attention, soft, shares = _advance(attention, soft, shares, sums.toArrow(), seed + i)
        held.unpersist()
    held_model.unpersist()
    model = replace(model, attention=attention)
    if shares.any():
        model.share = float(SHARES[np.argmax(shares)])
    return model, counted


def _pairs(every: DataFrame, size: int, leads: np.ndarray) -> tuple[Pairs, int]:
    """The pairs that every task knows, and the least count of them."""
    pairs = every.where(F.col("kind") == PAIR).withColumn("id", (F.col("key") % (1 << 32)).cast("int"))
    beginning = local_table(every.sparkSession, [(int(i), True) for i in np.flatnonzero(leads)], "id int, begins boolean")
    sides = pairs.join(beginning, "id", "left").groupBy(F.shiftright("key", 32).alias("before"), F.col("begins").isNull().cast("int").alias("sort"))
    rows = sides.agg(F.sum("n").alias("n"), F.count("*").alias("different")).toArrow()  # at most two for each id
    at = rows.column("before").to_numpy(), rows.column("sort").to_numpy()
    before, different = np.zeros((size, 2), np.int64), np.zeros((size, 2), np.int64)
    before[at], different[at] = rows.column("n").to_numpy(), rows.column("different").to_numpy()
    least = _least_count(pairs, int(before.sum()))
    rows = pairs.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    return Pairs(keys[order], rows.column("n").to_numpy()[order], before, different), least


def _advance(old: Attention, soft: np.ndarray, shares: np.ndarray, sums: pa.Table, seed: int) -> tuple[Attention, np.ndarray, np.ndarray]:
    """The next parameters: changes averaged over tasks, parts from expected counts of all rounds, of
    which a later round weighs twice the one before, and so do the likelihoods by share."""
    new = copy.deepcopy(old)
    new.seen = {}
    kinds = np.array(sums.column("kind").to_pylist(), object)
    at, weight = sums.column("row").to_numpy(), sums.column("w").to_numpy()
    values = np.column_stack([sums.column(f"v{j}").to_numpy() for j in range(KINDS)])
    soft, shares = soft / 2, shares / 2
    for name in NAMES:
        mine = kinds == name
        if mine.any():
            held = getattr(new, name)
            change = values[mine] / weight[mine][:, None]
            if name == "recency":
                held += change[0, : held.shape[0]].astype(np.float32)
            else:
                held[at[mine]] += change[:, : held.shape[1]].astype(np.float32)
    mine = kinds == "share"
    shares[at[mine]] += values[mine][:, 0]
    mine = kinds == "follow"
    if mine.any():
        slope, fall = values[mine][np.argsort(at[mine])][:, :2].T
        new.follow = np.clip(old.follow + slope / np.maximum(fall, 1e-9), 0.01, 0.99).astype(np.float32)  # Newton's step
    mine = kinds == "parts"
    soft[at[mine]] += values[mine]
    all_ids = soft.sum(1)
    if all_ids.sum():
        every = (all_ids + 0.1) / (all_ids + 0.1).sum()
        each = soft + 20.0 * every[:, None]
        if not old.seen and (old.parts == old.parts[0, 0]).all():  # first counts: the kinds are told apart
            each = every[:, None] * np.exp(0.7 * np.random.default_rng(seed).standard_normal(soft.shape))
        new.parts = (each / each.sum(0)).astype(np.float32)
    return new, soft, shares


def _score(tokenizer: str, held) -> Callable[[Batches], Batches]:
    """(id, held_out, text, more) to scores."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            model: TextModel = held.value.beside(b.column(3))
            log_all = np.log10(model.total + model.different + 1)
            n_tokens, known, base, score = [], [], [], []
            for piece in pieces(b.column(2), _GRAM * 8):
                counts, attended, read = _both(model, piece, tokenizer)
                starts = np.concatenate([[0], read.ends[:-1]])
                unigram = np.where(counts > 0, model.unigram(counts), 0.0)
                p = np.maximum(model.share * unigram + (1 - model.share) * attended, 1e-300)
                score.append(np.add.reduceat(np.log10(p), starts))
                base.append(np.add.reduceat(np.log10(counts + 1) - log_all, starts))
                known.append(np.add.reduceat((counts > 0).astype(np.int64), starts))
                n_tokens.append(read.ends - starts)
            if not n_tokens:
                continue
            columns = [pa.array(np.concatenate(x)) for x in (n_tokens, known, base, score)]
            yield pa.record_batch([b.column(0), b.column(1), *columns], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, tokenizer: str, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows of which ``held_out`` is not true (NULL counts as not held out) are learned from. Tokens are the lower-cased words and
    one end. ``base_score`` adds up log10((c + 1) / (N + V + 1)) with the exact count c of every
    token; ``score`` is the log10 probability by the model: for each token, the mixture of the word
    unigram and of causal attention with counted pairs over its subwords and its end. After any text the
    probabilities of all words and the end add up to at most 1. A NULL
    text is empty: its only token is the end. Without training rows all counts are 0. Rows without
    an id and repeated rows are scored like any other. Other columns are ignored.

    The most common words and pairs (at most 2^20 of each) are known to every task; the counts of
    all others meet the texts that hold them in a join before the training, so training, mixture
    weight and scores use the same full counts.
    """
    given = docs.select(
        F.col(id).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    model, counted = fit_text_model(given, tokenizer, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = counted.select("id", "held_out", "text", "more").mapInArrow(
        _score(tokenizer, held), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
