"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import given_back, pieces

Batches = Iterator[pa.RecordBatch]
ORDER = 4
SYMBOL_BITS = 16
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For every code point: 0 if it is no letter, else a number of 16 bits for its lower-case letter.

    Letters beyond the first 65,535 code points share numbers; the first ones keep their code point.
    """
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            table[c] = low if low < 1 << SYMBOL_BITS else 1 + low % ((1 << SYMBOL_BITS) - 1)
    return table


def _grams(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters as 4-grams: a 64-bit key for each predicted symbol, and where rows begin.

    Anything but letters is one gap, and a gap stands before every text. Predicted are letters and the
    gap that ends a run.
    """
    symbols = _symbols()[codes]
    gap = symbols == 0
    again = gap.copy()  # gaps after gaps are left out; so are those at the start of a row
    again[1:] &= gap[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    again[begins] = gap[begins]
    kept = np.flatnonzero(~again)
    s = symbols[kept].astype(np.uint64)
    row_bounds = np.searchsorted(kept, bounds)
    within = np.arange(len(kept)) - np.repeat(row_bounds[:-1], np.diff(row_bounds))
    key = s.copy()
    for j in range(1, ORDER):
        before = np.zeros(len(s), np.uint64)
        before[j:] = s[:-j] if len(s) > j else before[j:]
        before[within < j] = 0
        key |= before << np.uint64(SYMBOL_BITS * j)
    return key, row_bounds


def _decoded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of pieces of a column, and the bounds of its rows among them."""
    for piece in pieces(column):
        codes = np.frombuffer(piece.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
        heads = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        yield codes, heads[piece.bounds]


@dataclass(frozen=True)
class LanguageModel:
    """One table for each order: sorted keys and, for each language, the log probability of the symbol
    after its context, with what was not seen taken from lower orders; for contexts, the log weight
    that a symbol not seen after them takes from there. ``limits``: the cross-entropy (per symbol)
    above which a text is taken for none of the languages."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities (rows: symbols, columns: languages)."""
        out = np.zeros((len(keys), len(self.languages)))
        open_rows = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            part = keys[open_rows] & np.uint64((1 << (SYMBOL_BITS * order)) - 1)
            found, at = _find(self.keys[order - 1], part)
            out[open_rows[found]] += self.logs[order - 1][at[found]]
            open_rows, part = open_rows[~found], part[~found]
            if order > 1 and len(open_rows):
                known, at = _find(self.contexts[order - 1], part >> np.uint64(SYMBOL_BITS))
                out[open_rows[known]] += self.backs[order - 1][at[known]]
        out[open_rows] += self.floor
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _count(batches: Batches) -> Batches:
    """(language, text) to (language, key, count), added up per batch."""
    for b in batches:
        said = np.array(b.column(0).to_pylist(), object)
        at = 0
        for codes, bounds in _decoded(b.column(1)):
            key, rows = _grams(codes, bounds)
            langs = said[at : at + len(bounds) - 1]
            at += len(bounds) - 1
            for lang in dict.fromkeys(langs):
                mine = np.repeat(langs == lang, np.diff(rows))
                k, n = np.unique(key[mine], return_counts=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "key", "n"]
                )


def _kneser_ney(key: np.ndarray, count: np.ndarray) -> tuple[list, list, float]:
    """For one language: per order (keys, log p) and (contexts, log weight), and the log of the floor."""
    tables, contexts = [], []
    levels = [(key, count.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):  # below the highest order, count the different symbols before
        k, n = np.unique(levels[-1][0] & np.uint64((1 << (SYMBOL_BITS * order)) - 1), return_counts=True)
        levels.append((k, n.astype(np.float64)))
    levels.reverse()
    symbols = levels[0][0]
    floor = 1.0 / (len(symbols) + 1)
    below = np.full(len(symbols), floor)
    for order, (k, n) in enumerate(levels, 1):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        cut = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        context, place = np.unique(k >> np.uint64(SYMBOL_BITS), return_inverse=True)
        total = np.bincount(place, n)
        weight = cut * np.bincount(place) / total
        if order > 1:
            shorter = k & np.uint64((1 << (SYMBOL_BITS * (order - 1))) - 1)
            lower_keys, lower = tables[-1]
            below = lower[np.searchsorted(lower_keys, shorter)]
        p = np.maximum(n - cut, 0) / total[place] + weight[place] * below
        tables.append((k, p))
        contexts.append((context, np.log(weight)))
    bottom = np.log(floor) + contexts[0][1][0]
    return [(k, np.log(p)) for k, p in tables], contexts, bottom


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", most_per_language: int = 2000, seed: int = 3, reject_margin: float = 1.0
) -> LanguageModel:
    """Fit a model of each language on rows with a text and a label.

    A language with more than ``most_per_language`` rows is fitted on about as many, those of lowest
    hash of their text; whole texts are used and their counts are added up by Spark. The driver gets the
    different 4-grams of that bounded sample only. The rejection limit of a language is the mean
    cross-entropy of sampled texts plus six standard deviations and ``reject_margin`` nats.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        empty = np.zeros(0, np.uint64)
        none = np.zeros((0, 0))
        return LanguageModel([], [empty] * ORDER, [none] * ORDER, [empty] * ORDER, [none] * ORDER, np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, most_per_language / n))])
    chance = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < F.element_at(share, F.col("lang")))
    counted = sample.mapInArrow(given_back(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = counted.toArrow()
    said = counted.column("lang").to_numpy()
    key = counted.column("key").to_numpy().view(np.uint64)
    count = counted.column("n").to_numpy()
    fitted = []
    for name in languages:
        mine = said == name
        order = np.argsort(key[mine])
        fitted.append(_kneser_ney(key[mine][order], count[mine][order]) if mine.any() else None)
    languages = [name for name, f in zip(languages, fitted) if f]
    fitted = [f for f in fitted if f]
    model = _joined(languages, fitted)
    spread = sample.mapInArrow(given_back(_spread(model)), "lang string, ce double").where("lang IS NOT NULL").groupBy("lang")
    moments = {r["lang"]: r for r in spread.agg(F.avg("ce").alias("m"), F.stddev_pop("ce").alias("s")).collect()}
    limits = [moments[n]["m"] + 6 * moments[n]["s"] + reject_margin if n in moments else np.inf for n in languages]
    return LanguageModel(**{**model.__dict__, "limits": np.array(limits, np.float64)})


def _joined(languages: list[str], fitted: list[tuple]) -> LanguageModel:
    """Tables over all languages; a gram that one language has not seen is worked out for it here."""
    floor = np.array([f[2] for f in fitted])
    keys, logs, contexts, backs = [], [], [], []
    for order in range(1, ORDER + 1):
        every = np.unique(np.concatenate([f[0][order - 1][0] for f in fitted]))
        held = np.unique(np.concatenate([f[1][order - 1][0] for f in fitted]))
        back = np.zeros((len(held), len(fitted)))
        log = np.zeros((len(every), len(fitted)))
        for j, (tables, weights, _) in enumerate(fitted):
            at, known = np.searchsorted(held, weights[order - 1][0]), tables[order - 1]
            back[at, j] = weights[order - 1][1]
            if order == 1:
                log[:, j] = floor[j]
            else:
                up, at = _find(held, every >> np.uint64(SYMBOL_BITS))
                _, lower = _find(keys[-1], every & np.uint64((1 << (SYMBOL_BITS * (order - 1))) - 1))
                log[:, j] = np.where(up, back[at, j], 0.0) + logs[-1][lower, j]
            log[np.searchsorted(every, known[0]), j] = known[1]
        keys.append(every)
        logs.append(log)
        contexts.append(held)
        backs.append(back)
    return LanguageModel(languages, keys, logs, contexts, backs, floor, np.full(len(languages), np.inf))


def _entropies(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol for each row and language, and the number of letters and gaps scored."""
    rows, sizes = [], []
    for codes, bounds in _decoded(column):
        key, at = _grams(codes, bounds)
        n = np.diff(at)
        different, place = np.unique(key, return_inverse=True)
        logs = model.symbols(different)
        sums = np.zeros((len(n), len(model.languages)))
        full = np.flatnonzero(n)
        if len(full):
            for j in range(len(model.languages)):
                sums[full, j] = np.add.reduceat(logs[:, j][place], at[:-1][full])
        rows.append(-sums / np.maximum(n, 1)[:, None])
        sizes.append(n)
    if not rows:
        return np.zeros((0, len(model.languages))), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sizes)


def _spread(model: LanguageModel) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        where = {n: j for j, n in enumerate(model.languages)}
        for b in batches:
            entropy, n = _entropies(model, b.column(1))
            said = b.column(0).to_pylist()
            ce = [float(entropy[i, where[s]]) if n[i] and s in where else None for i, s in enumerate(said)]
            kept = [i for i, c in enumerate(ce) if c is not None]
            yield pa.record_batch([pa.array([said[i] for i in kept], pa.string()), pa.array([ce[i] for i in kept], pa.float64())], names=["lang", "ce"])

    return run


def _predict(broadcast, first: int) -> Callable[[Batches], Batches]:
    """(key, text, other columns) to key, prediction and the columns from the one numbered ``first`` on."""

    def run(batches: Batches) -> Batches:
        model: LanguageModel = broadcast.value
        for b in batches:
            entropy, n = _entropies(model, b.column(1))
            said, score, rejected = [], [], []
            for e, size in zip(entropy, n):
                if not size or not model.languages:
                    said.append(UNDETERMINED), score.append(0.0), rejected.append(True)
                    continue
                best = int(np.argmin(e))
                said.append(model.languages[best])
                score.append(float(1.0 / np.exp((e[best] - e) * min(size, 50)).sum()))
                rejected.append(bool(e[best] > model.limits[best]))
            yield pa.record_batch(
                [*b.columns[:1], pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), *b.columns[first:]],
                names=["_key", "lang_pred", "score", "rejected", *b.schema.names[first:]],
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with (lang_pred, score, rejected).

    The language of the lowest cross-entropy per symbol over the whole text, equal ones by name; a NULL
    text or one without letters is ``und``, with score 0. The score is the weight of the language among
    all by their cross-entropies over at most 50 symbols. ``rejected``: ``und``, or a cross-entropy
    above the language's calibrated limit. A model without languages rejects all. Columns of the
    given table with the names of the new ones are left out.
    """
    new = {"lang_pred", "score", "rejected"}
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in new]
    others = [c for c in keep if c != text]  # a text that is kept goes to the task once
    held = docs.select(
        F.lit(0).alias("_key"), F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(others)]
    )
    kinds = dict(docs.dtypes)
    fields = "_key int, lang_pred string, score double, rejected boolean"
    fields += f", _text {kinds[text]}" if text in keep else ""
    fields += "".join(f", _k{i} {kinds[c]}" for i, c in enumerate(others))
    run = _predict(docs.sparkSession.sparkContext.broadcast(model), 1 if text in keep else 2)
    out = held.mapInArrow(given_back(run), fields)
    return out.select(*[F.col("_text" if c == text else f"_k{others.index(c)}").alias(c) for c in keep], "lang_pred", "score", "rejected")
