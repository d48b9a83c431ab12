"""Removal of long repeated byte strings with a family of sparse suffix arrays.

A string of ``length`` bytes is looked up by its sampled suffix: of the suffixes that begin in its first
half plus one, the one whose first half-length bytes (its head) have the lowest hash. The same string has the same sampled
suffix wherever it stands, so about one suffix in a hundred (for 400 bytes) is enough to find all
repeats. Suffixes are ordered by the hash of their head, then by that of all strings that sample them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written

from .text import mix, pieces, prefix_hash, range_hash

Batches = Iterator[pa.RecordBatch]
_ENTRY = np.dtype([("head", "<i8"), ("context", "<i8"), ("at", "<i4"), ("first", "<i4"), ("last", "<i4")])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, edge: int) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row, by runs within blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, edge, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled_suffixes(data: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    """The sampled suffixes of one text: hash of the head, of the context, place, and the first and last
    start of the strings that sample it. The context is all bytes of those strings."""
    head = length // 2
    span = length - head + 1  # heads within a string
    if len(data) < length:
        return np.zeros(0, _ENTRY)
    starts = np.arange(len(data) - head + 1)
    hashes = range_hash(sums, starts, starts + head)
    least = _sliding(hashes, span, np.minimum, (1 << 64) - 1)
    # The sampled place of each string: the first one of its least hash, which ends no earlier than it.
    change = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    out = []
    for a, b in zip(change, np.append(change[1:], len(least))):
        places = a + np.flatnonzero(hashes[a : b - 1 + span] == least[a])
        if len(places) == 1:
            out.append((places[0], a, b - 1))
        else:  # equal heads near each other: each string takes the first in it
            own = places[np.searchsorted(places, np.arange(a, b))]
            for p in np.unique(own):
                w = a + np.flatnonzero(own == p)
                out.append((p, w[0], w[-1]))
    at, first, last = (np.array(c, np.int64) for c in zip(*out))
    found = np.zeros(len(at), _ENTRY)
    found["head"] = hashes[at].view(np.int64)
    context = range_hash(sums, first, last + length)
    shape = mix((at - first).astype(np.uint64) * np.uint64(1 << 32) + (last - at + length).astype(np.uint64))
    found["context"] = mix(context ^ shape).view(np.int64)
    found["at"], found["first"], found["last"] = at, first, last
    return found


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for piece in pieces(column):
        for a, b in zip(piece.bounds[:-1], piece.bounds[1:]):
            data = piece.data[a:b]
            yield data, prefix_hash(data)


def _scan(length: int) -> Callable[[Batches], Batches]:
    """(id, text) to (id, key of the text, bytes, digest, entries)."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, sizes, digests, entries = [], [], [], []
            for data, sums in _texts(b.column(1)):
                digest = hashlib.sha256(data.tobytes()).digest()
                keys.append(int.from_bytes(digest[:8], "big", signed=True))
                digests.append(digest.hex())
                sizes.append(len(data))
                entries.append(sampled_suffixes(data, sums, length).tobytes())
            columns = [b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(entries, pa.binary())]
            yield pa.record_batch(columns, names=["id", "key", "n_bytes", "digest", "entries"])

    return run


_OPEN = "key long, head long, context long, at int, first int, last int"


def _opened(batches: Batches) -> Batches:
    for b in batches:
        raw = b.column(1).to_pylist()
        every = np.frombuffer(b"".join(raw), _ENTRY)
        keys = np.repeat(b.column(0).to_numpy(), [len(r) // _ENTRY.itemsize for r in raw])
        yield pa.record_batch([pa.array(keys), *[pa.array(np.ascontiguousarray(every[c])) for c in _ENTRY.names]], names=["key", *_ENTRY.names])


class SuffixLevels:
    """Suffix arrays of batches of texts, in levels of 1, 2, 4, ... batches.

    ``add`` sorts the suffixes of a new batch, scans them against every level for equal heads, and
    returns the heads that occur twice or more. Then the batch is a level, and as long as the last two
    levels are equally large they are merged. Every suffix is so merged a logarithmic number of times.
    A level has a row for each head, sorted, with the number of its suffixes.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, heads: DataFrame) -> DataFrame:
        array = written(heads.groupBy("head").agg(F.count("*").alias("n")).sortWithinPartitions("head"))
        found = array.where("n > 1").select("head")
        for _, level in self.levels:
            found = found.union(array.join(level.select("head"), "head").select("head"))
        found = written(found.distinct())
        size = 1
        while self.levels and self.levels[-1][0] == size:
            both = array.union(self.levels.pop()[1])
            array = written(both.groupBy("head").agg(F.sum("n").alias("n")).sortWithinPartitions("head"))
            size *= 2
        self.levels.append((size, array))
        return found


PARTS = 8  # kinds of probes: strings are told apart by an eighth of the places that their suffix can have in them


def _probes(length: int) -> Callable[[Batches], Batches]:
    """(key, text, suffixes) to the strings that sample each, a row for those whose suffix stands in the same part
    of them: the hash of the bytes they all share, and their first and last start. Strings that are equal
    have equal probes, so those whose probe stands nowhere else need not be looked at."""
    step = -(-(length - length // 2 + 1) // PARTS)

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), _texts(b.column(1))
            for key, (_, sums), suffixes in zip(keys, texts, b.column(2).to_pylist()):
                at, first, last = (np.array([s[c] for s in suffixes], np.int64)[:, None] for c in ("at", "first", "last"))
                many = np.array([s["n"] > 1 for s in suffixes])
                part = np.arange(PARTS)
                lead = at - step * part  # the last start of the part
                a, z = np.maximum(first, lead - step + 1), np.minimum(last, lead)
                which, of = np.nonzero(a <= z)
                begin = lead[which, of]  # every string of the part begins here or up to step - 1 bytes before
                probe = mix(range_hash(sums, begin, begin + length - step + 1) ^ mix(of.astype(np.uint64)))
                columns = [pa.array(probe.view(np.int64)), pa.array(np.full(len(of), key)), *[pa.array(x[which, of].astype(np.int32)) for x in (a, z)], pa.array(many[which])]
                yield pa.record_batch(columns, names=["probe", "key", "first", "last", "many"])

    return run


def _strings(length: int) -> Callable[[Batches], Batches]:
    """(key, text, ranges of starts) to a hash for each string that begins in one of them."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), _texts(b.column(1))
            for key, (_, sums), spans in zip(keys, texts, b.column(2).to_pylist()):
                p = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
                many = np.repeat([s["many"] for s in spans], [s["last"] - s["first"] + 1 for s in spans])
                hashes = range_hash(sums, p, p + length).view(np.int64)
                columns = [pa.array(hashes), pa.array(np.full(len(p), key)), pa.array(p.astype(np.int32)), pa.array(many)]
                yield pa.record_batch(columns, names=["string", "key", "at", "many"])

    return run


def _cut(batches: Batches) -> Batches:
    """(key, text, ranges) to what is left without the ranges."""
    for b in batches:
        out = []
        for key, (data, _), ranges in zip(b.column(0).to_pylist(), _texts(b.column(1)), b.column(2).to_pylist()):
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, [r["start"] for r in ranges], 1)
            np.add.at(edge, [r["end"] for r in ranges], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((key, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "n_removed", "n_spans", "left"])


def _text_key(text: str) -> F.Column:
    return F.expr(f"CAST(conv(substr(sha2({text}, 256), 1, 16), 16, -10) AS long)")


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, batches: int = 4
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): texts without bytes of strings that occur twice.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the input,
    in the same document or another; matches never cross documents. Texts are taken as UTF-8 bytes,
    NULL as empty; equal texts are repeats of each other. Rows without an id and repeated rows are
    documents like any other. Other columns are ignored. An empty table gives none.

    Each different text is indexed once. Batches of texts go through ``SuffixLevels``; suffixes whose
    head is repeated are then grouped by context. Equal contexts make all their strings repeats. Of
    heads with several contexts, one text for each context has its strings compared, which decides the ends
    of long matches exactly: first by the bytes that an eighth of a suffix's strings share, and only where
    those stand twice one by one.
    Hashes have 64 bits. All steps group or join by hashes merged map-side, and no text meets another.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = written(given.mapInArrow(_scan(length), "id long, key long, n_bytes long, digest string, entries binary"))
    copies = written(scanned.groupBy("key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")))
    unique = scanned.where(F.col("n_bytes") >= length).groupBy("key").agg(F.first("entries").alias("entries"))
    entries = unique.mapInArrow(_opened, _OPEN)

    family, repeated = SuffixLevels(), None
    heads = entries.select("key", "head")
    for i in range(batches):
        found = family.add(heads.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i).select("head"))
        repeated = found if repeated is None else repeated.union(found)
    repeated = written(repeated.distinct())
    held = written(entries.join(repeated, "head"))
    contexts = held.groupBy("head", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "first", "last")).alias("one"))
    contexts = written(contexts)
    open_heads = written(contexts.groupBy("head").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("head"))
    compared = contexts.join(open_heads, "head").select("one.*", "n")
    compared = compared.groupBy("key").agg(F.collect_list(F.struct("at", "first", "last", "n")).alias("suffixes"))

    whole = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("key")
    many = contexts.where("n > 1").select("head", "context")
    sure = held.join(many, ["head", "context"]).selectExpr("key", "first AS start", f"last + {length} AS end")
    sure = written(sure)
    touched = written(compared.select("key").union(sure.select("key")).distinct())
    texts = given.withColumn("key", _text_key("text")).join(touched, "key", "left_semi").select("key", "text")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts.join(compared, "key", "left"))

    probes = texts.where("suffixes IS NOT NULL").select("key", "text", "suffixes")
    probes = written(probes.mapInArrow(_probes(length), "probe long, key long, first int, last int, many boolean"))
    shared = probes.groupBy("probe").agg(F.count("*").alias("n")).where("n > 1").select("probe")
    spans = probes.join(shared, "probe").groupBy("key").agg(F.collect_list(F.struct("first", "last", "many")).alias("spans"))
    strings = texts.join(spans, "key").select("key", "text", "spans")
    strings = strings.mapInArrow(_strings(length), "string long, key long, at int, many boolean")
    strings = written(strings)
    twice = written(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"))
    ends = strings.where("NOT many").join(twice, "string").selectExpr("key", "at AS start", f"at + {length} AS end")
    ranges = sure.union(ends).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    cut = texts.join(ranges, "key").select("key", "text", "ranges")
    cut = cut.mapInArrow(_cut, "key long, n_removed long, n_spans long, left string")
    cut = cut.join(whole, "key", "left_anti")
    empty = hashlib.sha256(b"").hexdigest()
    gone = whole.join(copies.select("key", "n_bytes"), "key").select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("left"))
    changed = written(cut.union(gone))
    out = scanned.select("id", "key", "n_bytes", "digest").join(changed, "key", "left")
    return out.select(
        F.col("id").alias(id),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("left", "digest").alias("kept_sha256"),
    )
