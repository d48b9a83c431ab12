"""How far the sources of each language lie apart in their use of terms, by cube partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.session import written

Batches = Iterator[pa.RecordBatch]

SCALE = 1_000_000_000
SMOOTHING = 5
TASK_TERMS = 200_000
CHUNK_BYTES = 1 << 20
_COUNTS = "lang string, source string, term string, n long, docs long"
_ROWS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _letters() -> bytes:
    """For every byte what a term shows of it: a-z for A-Z, a-z and bytes of longer characters as they are, else a blank."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for i in range(26):
        table[ord("A") + i] = table[ord("a") + i] = ord("a") + i
    return bytes(table)


_LETTERS = _letters()


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about a megabyte that end where a term ends."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + CHUNK_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def _term_counts(batches: Batches) -> Batches:
    """(lang, source, text) to counts of terms and of the documents that hold them, added up in the task.

    Every group that occurs also gives a row of the empty term. Counts leave the task whenever it holds
    ``TASK_TERMS`` of them, so its memory follows the longest text.
    """
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            for i, c in enumerate(([lang] * len(n), [source] * len(n), [t.decode() for t in n], n.values(), map(docs.__getitem__, n))):
                columns[i].extend(c)
        held.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    size = 0
    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            if (lang, source) not in held:
                held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
            n, docs = held[lang, source]
            before, seen = len(n), {b""}
            for chunk in _chunks(text.as_buffer().to_pybytes().translate(_LETTERS)):
                terms = chunk.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size > TASK_TERMS:
                yield flush()
                size = 0
    if held:
        yield flush()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly."""
    wide = (n + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + SMOOTHING * terms).cast("decimal(19,0)"))


_PARTIAL = "lang string, a string, b string, part long"


def _cell(batch: pa.Table) -> pa.Table:
    """The partial sums of a cell: every pair of a source of its first and one of its second block, over its terms.

    Rows with an empty term give each source and its share of a term that it lacks; the others give the
    shares of terms that it has. Terms that no source of the cell has differ by the same amount for all,
    which the cell of the first term block adds for all terms at once; other cells add what their terms
    change in that.
    """
    lang, low, high, block, terms = (batch.column(c)[0].as_py() for c in ("lang", "low", "high", "term_block", "terms"))
    own, p = batch.column("own").to_numpy(), batch.column("p").to_numpy()
    is_group = batch.column("is_group").to_numpy()
    names = batch.column("term").dictionary_encode().unify_dictionaries().combine_chunks()
    sources = batch.column("source").dictionary_encode().unify_dictionaries().combine_chunks()
    place = names.indices.fill_null(0).to_numpy()
    group, titles = sources.indices.to_numpy(), sources.dictionary.to_pylist()

    def side(which: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        mine = own == which
        heads = np.flatnonzero(mine & is_group)
        row = np.full(len(titles), -1)
        row[group[heads]] = np.arange(len(heads))
        absent = p[heads]
        table = np.repeat(absent[:, None], len(names.dictionary), axis=1)
        held = np.flatnonzero(mine & ~is_group)
        table[row[group[held]], place[held]] = p[held]
        return [titles[g] for g in group[heads]], absent, table

    left, absent_a, a = side(low)
    right, absent_b, b = side(high) if high != low else (left, absent_a, a)
    at = {t: i for i, t in enumerate(right)}
    out_a, out_b, parts = [], [], []
    for i, name in enumerate(left):
        apart = np.abs(absent_b - absent_a[i])
        sums = np.abs(b - a[i]).sum(axis=1) - a.shape[1] * apart
        if block == 0:
            sums += terms * apart
        keep = np.arange(len(right)) if high != low else np.flatnonzero(np.arange(len(right)) > at[name])
        out_a += [name] * len(keep)
        out_b += [right[j] for j in keep]
        parts.append(sums[keep])
    total = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(total), pa.string()), "a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string()), "part": pa.array(total, pa.int64())})


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = 30,
    most_terms: int = 50,
    groups_per_block: int = 256,
    terms_per_block: int = 4096,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language and their own terms.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z as a-z; NULL text, lang and source
    count as empty. A language keeps the V terms that at least ``least_docs`` of its documents hold. A group
    (lang, source), and the language itself, gives each kept term, with n >= 0 occurrences of N of all kept
    terms, the share p = 1 + floor(10^9 * (n + 5) / (N + 5 * V)), in whole numbers.

    Part ``pair``: for every other source of the language the sum of |p - q| over the kept terms (0 if there
    are none), farthest first, all ranks. Part ``term``: the kept terms that the source holds and uses more
    than its language does, by p - q, up to rank ``most_terms``. Ties go to the item first in UTF-8 order.

    Pair sums follow a cube: a task owns a cell of (source block, source block, term block) of a language,
    is sent the slices that meet there, and gives partial sums that are added up along the term axis. A
    slice goes to as many cells as there are source blocks; a cell holds about ``groups_per_block`` sources
    a side and ``terms_per_block`` terms whatever the size of the input. The result itself has a row for each
    ordered pair of sources.

    An empty table gives an empty one; repeated rows count as often as they occur; a language of one source
    has no pairs. Other columns are ignored, whatever their names.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = given.mapInArrow(_term_counts, _COUNTS)
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    real = counts.where("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = written(kept.where(F.col("docs") >= least_docs).drop("docs"))
    found = written(real.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    n_groups = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    blocks = F.ceil(F.col("n_groups") / groups_per_block).cast("int")
    groups = groups.join(n_groups, "lang").select(
        "lang", "source", "total", "terms", "lang_total", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("own"),
        F.greatest(F.ceil(F.col("terms") / terms_per_block), F.lit(1)).cast("int").alias("term_blocks"),
    )
    groups = written(groups)
    shared = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"), "blocks", "own", "term_blocks", "terms",
    )
    shared = written(shared)

    absent = F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    columns = ["lang", "source", "term", "p", "is_group", "own", "blocks", "terms", "term_block"]
    slices = shared.withColumns({"is_group": F.lit(False), "term_block": F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")})
    heads = groups.withColumns({"term": F.lit(None).cast("string"), "p": absent, "is_group": F.lit(True)})
    heads = heads.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    rows = slices.select(*columns).union(heads.select(*columns))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")
    cells = rows.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, _PARTIAL)
    sums = written(cells.groupBy("lang", "a", "b").agg(F.sum("part").alias("value")))
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    pairs = pairs.union(sums.select("lang", "b", "a", "value")).withColumn("part", F.lit("pair"))

    more = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*names).union(more.select(*names))
