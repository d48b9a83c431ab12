"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks a file.

Spark splits a text file into byte ranges that begin at a line, but a line may begin inside a quoted
cell. What a range does to that state is found without knowing it: once as if the range began outside
a cell, once as if inside. A running scan over the ranges of a file then tells how each really begins, and
every range gives the records that begin in it. Of records that reach over the end of a range the parts
are put together by their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

ENCODINGS = ("UTF-8", "ISO-8859-1")  # a line end is one byte in these, and Spark decodes them line by line


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends within a quoted cell, given how it begins.

    A quote opens a cell only as its first character, a doubled quote within is a character, and whatever
    follows a closing quote runs on to the separator.
    """
    at = 0
    while True:
        if not inside and not line.startswith('"', at):
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)
            continue
        at += not inside
        at = line.find('"', at)
        while at >= 0 and line.startswith('""', at):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)
        inside = False


def _quoted(batch: pa.RecordBatch) -> list[int]:
    """The lines of a batch that hold a quote: no other line changes the state."""
    return pc.indices_nonzero(pc.match_substring(batch.column(2), '"')).to_pylist()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of rows of one range."""
    places = pc.run_end_encode(batch.column(1)).run_ends.to_pylist() if batch.num_rows else []
    files = pc.run_end_encode(batch.column(0)).run_ends.to_pylist() if batch.num_rows else []
    first = 0
    for end in sorted({*places, *files}):
        yield (batch.column(0)[first].as_py(), batch.column(1)[first].as_py()), first, end
        first = end


def _effects(sep: str) -> Callable[[Batches], Batches]:
    """(file, start, line) to (file, start, if_out, if_in): how a range ends for either beginning."""

    def run(batches: Batches) -> Batches:
        seen: dict[tuple[str, int], list[bool]] = {}
        for b in batches:
            quoted = _quoted(b)
            lines = dict(zip(quoted, b.column(2).take(pa.array(quoted, pa.int64())).to_pylist()))
            for place, first, end in _runs(b):
                state = seen.setdefault(place, [False, True])
                for i in (i for i in quoted if first <= i < end):
                    state[0], state[1] = ends_inside(lines[i], state[0], sep), ends_inside(lines[i], state[1], sep)
        if seen:
            columns = zip(*[(f, s, out, in_) for (f, s), (out, in_) in seen.items()])
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "if_out", "if_in"])

    return run


_PARTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])
_PARTS_DDL = "file string, start long, part int, header boolean, record string"
HEAD, TAIL, WHOLE = 0, 1, 2


class _Range:
    """One byte range while its lines come by: the record in hand, and what has been put out."""

    def __init__(self, place: tuple[str, int], inside: bool, wanted: set[int]):
        self.place, self.inside, self.wanted = place, inside, wanted
        self.part = HEAD if inside else WHOLE
        self.held: list[str] = []
        self.out: list[tuple] = []
        self.headed = place[1] > 0 or inside  # the header is the first record of a file that is not empty

    @property
    def between(self) -> bool:
        """Whether lines without quotes are plain records from here on."""
        return self.headed and not self.inside and not self.held

    def put(self, part: int) -> None:
        record = "\n".join(self.held)
        header = not self.headed and record.strip("\r") != ""
        self.headed |= header
        if part in self.wanted:
            self.out.append((*self.place, part, header, record))
        self.held.clear()

    def line(self, text: str, has_quote: bool, sep: str) -> None:
        self.held.append(text)
        if has_quote:
            self.inside = ends_inside(text, self.inside, sep)
        if not self.inside:
            self.put(self.part)
            self.part = WHOLE

    def end(self) -> None:
        if self.held:
            self.put(TAIL if self.part == WHOLE else HEAD)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[]] * len(_PARTS)
        self.out.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _split(sep: str, wanted: set[int]) -> Callable[[Batches], Batches]:
    """(file, start, line, inside) to the records of a range and the parts of those at its ends."""

    def plain(b: pa.RecordBatch, first: int, end: int) -> pa.RecordBatch:
        n = end - first
        made = [pa.array([WHOLE] * n, pa.int32()), pa.array([False] * n, pa.bool_())]
        f, s, lines = (b.column(i).slice(first, n) for i in range(3))
        return pa.record_batch([f, s, *made, lines], schema=_PARTS)

    def run(batches: Batches) -> Batches:
        now: _Range | None = None
        for b in batches:
            quoted, lines, begins = set(_quoted(b)), None, b.column(3)
            for place, first, end in _runs(b):
                if now is None or place != now.place:
                    if now:
                        now.end()
                        yield now.batch()
                    now = _Range(place, begins[first].as_py(), wanted)
                if now.between and quoted.isdisjoint(range(first, end)):
                    if WHOLE in wanted:
                        yield plain(b, first, end)
                    continue
                lines = lines or b.column(2).to_pylist()
                for i in range(first, end):
                    now.line(lines[i], i in quoted, sep)
                yield now.batch()
        if now:
            now.end()
            yield now.batch()

    return run


def csv_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(file, start, record): every record but the header of the CSV files at ``path``, empty lines left out.

    ``start`` is where the byte range begins in which the record does. Lines end in ``\\n`` or ``\\r\\n``; the
    header is the first record that is not empty, and begins in the first range. Ranges are Spark's own, so a file of any size is read
    by as many tasks as it has ranges, three times: for the effect of each range, for the records within
    ranges, and for those few that reach over an end. One row a range is broadcast, and one record is the most
    that a task puts together.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    decoded = F.make_valid_utf8("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), decoded.alias("value"))
    effects = lines.mapInArrow(_effects(sep), "file string, start long, if_out boolean, if_in boolean")
    # A range keeps the state, turns it, or ends in one state either way; the last fixed one and the turns since then tell.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("if_out") & ~F.col("if_in")).cast("int")).over(before), F.lit(0))
    known = effects.withColumn("turns", turns)
    fixed = F.last(F.when(F.col("if_out") == F.col("if_in"), F.struct("if_out", "turns")), ignorenulls=True).over(before)
    fixed = known.withColumn("fixed", fixed)
    since = F.col("turns") - F.coalesce("fixed.turns", F.lit(0))
    inside = F.coalesce("fixed.if_out", F.lit(False)) != (since % 2 == 1)
    begins = fixed.select("file", "start", inside.alias("inside"), F.when(inside, F.col("if_in")).otherwise(F.col("if_out")).alias("ends_in"))

    # The hint keeps the order of lines; a range that the scan of effects did not see is an error, never a guess.
    lost = F.raise_error(F.lit("The files or their ranges changed while they were read: load the table again")).cast("boolean")
    met = lines.join(F.broadcast(begins), ["file", "start"], "left")
    placed = met.select("file", "start", "value", F.coalesce("inside", lost).alias("inside"))
    whole = placed.mapInArrow(_split(sep, {WHOLE}), _PARTS_DDL)
    cut = met.where("inside OR ends_in").select("file", "start", "value", "inside")
    cut = cut.mapInArrow(_split(sep, {HEAD, TAIL}), _PARTS_DDL)
    in_order = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("chain", F.sum((F.col("part") == TAIL).cast("int")).over(in_order))
    ordered = F.array_sort(F.collect_list(F.struct("start", "part", "record")))
    joined = cut.groupBy("file", "chain").agg(F.min("start").alias("start"), F.bool_or("header").alias("header"), F.array_join(F.transform(ordered, lambda p: p["record"]), "\n").alias("record"))
    names = ["file", "start", "header", "record"]
    found = whole.select(*names).union(joined.select(*names)).where("NOT header").drop("header")
    return found.withColumn("record", F.regexp_replace("record", r"\r$", "")).where("record <> ''")
