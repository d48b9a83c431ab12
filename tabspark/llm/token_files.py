"""Token ids in Arrow stream files of equal-length sequences, and reading them back."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.session import fresh_dir, local_table, written

from .text import SPACES, Piece, Words, pieces, prefix_hash, range_hash, words

Batches = Iterator[pa.RecordBatch]
CACHED_WORDS = 1 << 19
_encoders: dict[str, "WordEncoder"] = {}
Encode = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def json_words(path: str) -> tuple[Encode, int, bool]:
    """From a file of the tokenizers library: what gives the ids of parts end to end and the number of
    each one's ids, the size of the vocabulary, and whether plain words may be cut into parts.

    Whole words are encoded many at a time as one text, and the ids told apart by the places they stand for.
    A run of the letters a-z, a digit or a run of signs goes to the tokenizer's model directly if that is
    what the whole tokenizer makes of plain words (tried on a few), as normalising and splitting take most
    of the time.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            found = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, places = found.ids, np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            begins = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            every.append(np.array(ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(begins, places, side="right") - 1, minlength=len(part)))
        return np.concatenate(every), np.concatenate(counts)

    def cut(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [tokenizer.model.tokenize(p) for p in parts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t.id for x in found for t in x), np.uint32, int(counts.sum())), counts

    def encode(parts: list[bytes], is_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = [(cut, ~is_whole), (whole, is_whole)]
        made = [(mine, *run([parts[i].decode("utf-8", "replace") for i in np.flatnonzero(mine)])) for run, mine in kinds]
        counts = np.zeros(len(parts), np.int64)
        for mine, _, n in made:
            counts[mine] = n
        flat = np.zeros(int(counts.sum()), np.uint32)
        for mine, ids, _ in made:
            flat[np.repeat(mine, counts)] = ids
        return flat, counts

    tried = ["a", "the", "xqzj", "word.", "it,", "a1b22c", "(end)", "--", "...", "q9-z", "%%%", "Upper", "UPPER.Case"]
    parts_of = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall
    direct = all(cut(parts_of(w.lower()))[0].tolist() == whole([w])[0].tolist() for w in tried)
    return encode, tokenizer.get_vocab_size(with_added_tokens=True), direct


# Kinds of bytes: letters, digits and signs of plain words; others (an apostrophe may begin a part, a < an added token).
LETTER, DIGIT, SIGN, OTHER, WHOLE = range(5)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[[c for c in range(ord("!"), ord("~") + 1) if chr(c) not in "'<"]] = SIGN
_KINDS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
_KINDS[ord("0") : ord("9") + 1] = DIGIT
_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32


def _room(held: np.ndarray, wanted: int) -> np.ndarray:
    """An array that begins like ``held`` and has room for ``wanted`` values, doubled so that copies stay few."""
    if wanted <= len(held):
        return held
    out = np.zeros(max(wanted, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class Known:
    """Ids of byte strings met before, by 64-bit hashes of their bytes; the memory for them is bounded.

    A slot by the low bits of a hash names the last string that took it; one that lost its slot is new again.
    """

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(4 * CACHED_WORDS, -1, np.int32)
        self.n = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.begins = np.zeros(1024, np.int64)
        self.flat = np.zeros(1024, np.uint32)

    def ids(self, piece: Piece, starts: np.ndarray, ends: np.ndarray, learn: Encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ranges of a piece end to end, and the number of each one's; new ones, and the first place of each, go to ``learn``."""
        hashes = range_hash(prefix_hash(piece.data), starts, ends)
        at = self.slots[hashes & np.uint64(len(self.slots) - 1)].astype(np.int64)
        new = np.flatnonzero((at < 0) | (self.hashes[at] != hashes))
        if len(new):
            different, first, same = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.n and self.n + len(different) > CACHED_WORDS:
                self._reset()
                new = np.arange(len(hashes))
                different, first, same = np.unique(hashes, return_index=True, return_inverse=True)
            raw, one = piece.data.tobytes(), new[first]
            flat, counts = learn([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())], one)
            n, to, used = self.n, self.n + len(one), int(self.begins[self.n])
            self.hashes, self.begins = _room(self.hashes, to), _room(self.begins, to + 1)
            self.flat = _room(self.flat, used + len(flat))
            self.hashes[n:to], self.begins[n + 1 : to + 1] = different, used + np.cumsum(counts)
            self.flat[used : used + len(flat)] = flat
            self.slots[different & np.uint64(len(self.slots) - 1)] = np.arange(n, to)
            self.n = to
            at[new] = n + same
        begins = self.begins[at]
        counts = self.begins[at + 1] - begins
        steps = np.repeat(begins - (np.cumsum(counts) - counts), counts)
        return self.flat[steps + np.arange(len(steps))], counts


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer must drop white space and never join what white space parts (``word_bpe_49k.json``
    does so), because then a text's ids are those of its words end to end. New words are taken together: plain
    ones are cut into runs of letters, single digits and runs of signs, any other is one part. Words and
    parts met before are not encoded again.
    """

    def __init__(self, encode: Encode, size: int, direct: bool):
        self.encode_parts, self.size, self.direct = encode, size, direct
        self.words, self.parts = Known(), Known()

    @classmethod
    def of(cls, path: str, kind: Callable[[str], tuple[Encode, int, bool]] = json_words) -> "WordEncoder":
        """One encoder per worker process and file."""
        if path not in _encoders:
            _encoders[path] = cls(*kind(path))
        return _encoders[path]

    def _cut(self, piece: Piece, found: Words) -> tuple[Piece, np.ndarray, np.ndarray, np.ndarray]:
        """The piece with plain words in lower case, where parts begin and end, and which are whole words."""
        kind = _KINDS[piece.data]
        others = np.append(0, np.cumsum(kind == OTHER))
        whole = others[found.ends] > others[found.starts] if self.direct else np.ones(len(found.starts), bool)
        step = np.zeros(len(kind) + 1, np.int8)
        step[found.starts[whole]] += 1
        step[found.ends[whole]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        kind[inside] = WHOLE
        begin = kind == DIGIT
        begin[1:] |= kind[1:] != kind[:-1]
        begin[_SPACE[piece.data]] = False
        begin[found.starts] = True
        starts = np.flatnonzero(begin)
        word = np.searchsorted(found.starts, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(kind)), found.ends[word])
        data = np.where(inside, piece.data, _LOWERED[piece.data])
        return Piece(piece.first, data, piece.bounds), starts, ends, whole[word]

    def _learn(self, new: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has."""
        data = np.frombuffer(b" ".join(new), np.uint8)
        piece = Piece(0, data, np.array([0, len(data)]))
        found = words(piece)
        lowered, starts, ends, whole = self._cut(piece, found)
        flat, counts = self.parts.ids(lowered, starts, ends, lambda parts, first: self.encode_parts(parts, whole[first]))
        return flat, np.add.reduceat(counts, np.searchsorted(starts, found.starts))

    def encode(self, piece: Piece, end: int, with_words: bool = False) -> tuple[np.ndarray, ...]:
        """All ids of the texts of a piece, each closed by ``end``, and where each text's ids end; if asked for,
        also where those of each word and end do."""
        found = words(piece)
        flat, counts = self.words.ids(piece, found.starts, found.ends, self._learn)
        stops = np.cumsum(counts)
        text_ends = np.append(0, stops)[found.bounds[1:]] + np.arange(1, piece.rows + 1)
        out = np.full(int(text_ends[-1]), end, np.uint32)
        place = np.ones(len(out), bool)
        place[text_ends - 1] = False
        out[place] = flat
        if not with_words:
            return out, text_ends
        word_ends = stops + np.repeat(np.arange(piece.rows), found.counts)
        return out, text_ends, np.sort(np.concatenate([word_ends, text_ends]), kind="stable")


@dataclass(frozen=True)
class TokenFiles:
    """Files in a folder: ``files`` has a row for each (number, name, documents, ids before, ids)."""

    folder: str
    files: DataFrame
    length: int


def _schema(length: int, ids: int) -> pa.Schema:
    number = pa.uint16() if ids <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(number, length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _write(folder: str, tokenizer: str, end: int, length: int, rows_per_batch: int) -> Callable[[Batches], Batches]:
    """Sorted (id, text) of one task to a pair of files; the row that names them is the commit."""

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        encoder = WordEncoder.of(tokenizer)
        schema = _schema(length, encoder.size)
        number = schema.field("ids").type.value_type.to_pandas_dtype()
        store, root = _open(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        rest, total, docs = np.zeros(0, number), 0, 0
        out = index = None

        def put(ids: np.ndarray, real: int) -> None:
            for a in range(0, len(ids) // length, rows_per_batch):
                part = ids[a * length : (a + rows_per_batch) * length]
                mask = np.arange(a * length, a * length + len(part)) < real
                rows = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (part, mask)]
                out.write_batch(pa.record_batch(rows, schema=schema))

        for batch in batches:
            if batch.num_rows and out is None:
                streams = [store.open_output_stream(f"{root}/{name}{kind}") for kind in (".ids.arrow", ".index.arrow")]
                out, index = (pa.ipc.new_stream(s, k) for s, k in zip(streams, (schema, _INDEX)))
            for piece in pieces(batch.column(1)):
                ids, ends = encoder.encode(piece, end)
                begins = np.concatenate([[0], ends[:-1]])
                keys = batch.column(0).slice(piece.first, piece.rows)
                index.write_batch(
                    pa.record_batch([keys, pa.array(total + begins), pa.array(ends - begins)], schema=_INDEX)
                )
                total, docs = total + len(ids), docs + piece.rows
                ids = np.concatenate([rest, ids.astype(number)])
                whole = len(ids) // length * length
                put(ids[:whole], whole)
                rest = ids[whole:]
        if out is None:
            return
        if len(rest):
            put(np.concatenate([rest, np.zeros(length - len(rest), number)]), len(rest))
        for writer, stream in zip((out, index), streams):
            writer.close()
            stream.close()
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([total])],
            names=["file", "name", "docs", "n_ids"],
        )

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    end: int = 1,
    length: int = 1024,
    rows_per_batch: int = 64,
    folder: str | None = None,
) -> TokenFiles:
    """Encode whole texts in ascending id order and write their ids as Arrow stream files.

    Every batch of a file is a fixed-size list of ``length`` ids and of as many mask bits, so a mapped file
    gives any sequence by its number (``Sequences``); documents run on from one sequence to the next, and
    only the last sequence of a file is filled up, with mask bits off. A second file has the first id and
    the number of ids of each document. Ids are kept in 16 bits if the vocabulary allows.

    The table is dealt out by ranges of (id, hash of the text), so a repeated id is no hot key. A task
    writes files of a new name and then a row that names them; files of a lost or repeated attempt are
    named by no row. NULL texts are empty texts (the end id alone); rows without an id come first;
    rows that share an id stand in the order of their texts' hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    run = _write(folder, tokenizer, end, length, rows_per_batch)
    files = written(ordered.mapInArrow(run, "file int, name string, docs long, n_ids long"))
    before, rows = 0, []  # one row a file: as many as Spark's driver had tasks
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        rows.append((r["file"], r["name"], r["docs"], before, r["n_ids"]))
        before += r["n_ids"]
    files = local_table(spark, rows, "file int, name string, docs long, before long, n_ids long")
    return TokenFiles(folder, files, length)


def _read(folder: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        store, root = _open(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_stream(f"{root}/{name}.ids.arrow") as raw, pa.ipc.open_stream(raw) as ids:
                    parts = ids_of(ids)
                    held, at = np.zeros(0, np.uint32), 0  # ids from place ``at`` on
                    with store.open_input_stream(f"{root}/{name}.index.arrow") as raw2, pa.ipc.open_stream(raw2) as index:
                        for docs in index:
                            sums = []
                            starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                            for s, n in zip(starts, sizes):
                                if s + n > at + len(held):
                                    more, size = [held[s - at :]], len(held) - (s - at)
                                    at = s
                                    while size < n:
                                        more.append(next(parts))
                                        size += len(more[-1])
                                    held = np.concatenate(more)
                                sums.append(zlib.crc32(held[s - at : s - at + n].astype("<u4").tobytes()))
                            yield pa.record_batch(
                                [docs.column("doc_id"), pa.array(starts + before), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                                names=["doc_id", "start", "n_tokens", "ids_crc32"],
                            )

    return run


def ids_of(stream: pa.RecordBatchReader) -> Iterator[np.ndarray]:
    """The real ids of a file, batch by batch."""
    for batch in stream:
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask"))
        yield ids[mask] if not mask.all() else ids


class Sequences:
    """The sequences of one ``.ids.arrow`` file by number, for a training loop beside Spark.

    The file is mapped, not read: opening it looks at the head of each batch (of up to ``rows_per_batch``
    sequences), and a sequence's ids are a view of the file's own bytes. Numbers below 0 count from the end, as
    in a list. The path is one that the machine can map; a file without documents does not exist.
    """

    def __init__(self, path: str):
        with pa.memory_map(path) as mapped, pa.ipc.open_stream(mapped) as stream:
            self.length = stream.schema.field("ids").type.list_size
            self._batches = list(stream)
        self._ends = np.cumsum([b.num_rows for b in self._batches], dtype=np.int64)

    def __len__(self) -> int:
        return int(self._ends[-1]) if len(self._ends) else 0

    def __getitem__(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask): ids cannot be written to; mask is False where the last sequence is filled up."""
        at = number + len(self) if number < 0 else number
        if not 0 <= at < len(self):
            raise IndexError(f"Sequence {number} of {len(self)}")
        b = int(np.searchsorted(self._ends, at, side="right"))
        batch = self._batches[b]
        begin = (at - int(self._ends[b]) + batch.num_rows) * self.length
        ids, mask = (batch.column(c).flatten().slice(begin, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, found: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all of it from the files: where its ids
    begin among those of all files, how many there are, and the crc32 of them as 32-bit little endian."""
    files = found.files.repartition(max(1, min(found.files.count(), 10_000)), "file")
    return files.mapInArrow(_read(found.folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
