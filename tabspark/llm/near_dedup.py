"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written

from .graph import components
from .text import given_back, mix, shingle_sets


@dataclass(frozen=True)
class Forest:
    """The forest: ``trees`` sorted orders of ``depth`` MinHash values each.

    Rows of an order are candidates from a common prefix of ``least_depth`` values on. A region of more
    than ``region`` documents with a common prefix is dealt to blocks, and all pairs of blocks are looked at. A candidate whose
    signatures agree in less than ``agree`` of all places is dropped. A true link of similarity 0.8
    has a common prefix of 3 in one of 14 orders with probability 0.99996, and agrees in less than
    0.62 of 84 places with probability below 0.0001.
    """

    trees: int = 14
    depth: int = 6
    least_depth: int = 3
    region: int = 1024
    agree: float = 0.62
    block: int = 256
    seed: int = 7

    @property
    def size(self) -> int:
        return self.trees * self.depth

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        flips = random.integers(0, 1 << 63, self.size, dtype=np.uint64)
        return flips, random.integers(0, 1 << 62, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


Batches = Iterator[pa.RecordBatch]


def _signatures(n: int, forest: Forest) -> Callable[[Batches], Batches]:
    """(id, text) to (id, size of the set, 128-bit key of the set, signature)."""

    def run(batches: Batches) -> Batches:
        flips, odds = forest.hashes()
        for batch in batches:
            group, total = [], 0
            sizes, keys, signatures = [], [], []

            def flush() -> None:
                nonlocal group, total
                if not group:
                    return
                lengths = np.array([len(s) for s in group])
                full = np.flatnonzero(lengths)
                every = np.concatenate(group)
                starts = (np.cumsum(lengths) - lengths)[full]
                signature = np.zeros((len(full), forest.size), ">u4")
                key = np.zeros((len(full), 2), np.uint64)
                if len(full):
                    for k in range(forest.size):
                        signature[:, k] = np.minimum.reduceat((every ^ flips[k]) * odds[k], starts) >> np.uint64(32)
                    key[:, 0] = np.add.reduceat(mix(every), starts)
                    key[:, 1] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), starts)
                rows = {int(r): i for i, r in enumerate(full)}
                for r, size in enumerate(lengths):
                    i = rows.get(r)
                    sizes.append(int(size))
                    keys.append(None if i is None else key[i].tobytes())
                    signatures.append(None if i is None else signature[i].tobytes())
                group, total = [], 0

            for s in shingle_sets(batch.column(1), n):
                group.append(s)
                total += len(s)
                if total > 1 << 17:
                    flush()
            flush()
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                names=["id", "n_shingles", "key", "signature"],
            )

    return run


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _tree_links(forest: Forest) -> Callable[[Batches], Batches]:
    """Sorted rows (tree, low, high, prefix, id, sketch) to links that join all candidates of every region or pair of its blocks."""
    least = int(np.ceil(forest.agree * forest.size))

    def spread(sketch: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
        """Links along which all rows that agree closely enough reach each other."""
        rest = rows
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                hit = (sketch[rest] == sketch[x]).sum(1) >= least
                if hit.any():
                    near, rest = rest[hit], rest[~hit]
                    out.append(np.column_stack([np.full(len(near), x), near]))
                    queue.extend(near)

    def run(batches: Batches) -> Batches:
        held = list(batches)
        if sum(b.num_rows for b in held) < 2:
            return
        table = pa.Table.from_batches(held)
        part = np.column_stack([table.column(c).to_numpy() for c in ("tree", "low", "high")])
        prefix = _matrix(table.column("prefix"), 4 * forest.depth).view(">u4")
        sketch = _matrix(table.column("sketch"), forest.size)
        ids = table.column("id").to_numpy()
        same = (prefix[1:] == prefix[:-1]) & (part[1:] == part[:-1]).all(1)[:, None]
        common = np.concatenate([[0], np.minimum.accumulate(same, axis=1).sum(1)])
        starts = np.flatnonzero(common < forest.least_depth)
        ends = np.append(starts[1:], len(ids))
        links: list[np.ndarray] = []
        adjacent = np.flatnonzero(common >= forest.least_depth)
        close = (sketch[adjacent] == sketch[adjacent - 1]).sum(1) >= least
        links.append(np.column_stack([adjacent[close] - 1, adjacent[close]]))
        for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            spread(sketch, np.arange(a, b), links)
        pairs = ids[np.concatenate(links)]
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _sets(n: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
            kept = [batch.column(c) for c in ("id", "cluster", "blocks", "own")]
            yield pa.record_batch([*kept, pa.array(sets, pa.binary())], names=["id", "cluster", "blocks", "own", "set"])

    return run


def _confirm(percent: int) -> Callable[[Batches], Batches]:
    """Rows sorted by (cluster, low, high) to links of each group, found on the full sets."""

    def group_links(ids: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(a) for a in arrays])
        _, places = np.unique(np.concatenate(arrays), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        own = np.zeros(places.max(initial=-1) + 1, np.int64)
        label = np.arange(len(ids))
        for x in range(len(ids) - 1):
            mine = places[starts[x] : starts[x] + sizes[x]]
            own[mine] = 1
            shared = np.add.reduceat(own[places[starts[x + 1] :]], starts[x + 1 :] - starts[x + 1])
            own[mine] = 0
            linked = 100 * shared >= percent * (sizes[x] + sizes[x + 1 :] - shared)
            for other in np.unique(label[x + 1 :][linked]):
                label[label == other] = label[x]
        least: dict[int, int] = {}
        for i, group in zip(ids, label):
            least[group] = min(least.get(group, i), i)
        return [(i, least[group]) for i, group in zip(ids, label) if least[group] != i]

    def run(batches: Batches) -> Batches:
        now, ids, sets = None, [], []

        def done() -> Batches:
            if len(ids) > 1 and (found := group_links(ids, sets)):
                high, low = zip(*found)
                yield pa.record_batch([pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cluster, low, high, i, s in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (cluster, low, high) != now:
                    yield from done()
                    now, ids, sets = (cluster, low, high), [], []
                ids.append(i)
                sets.append(s)
        yield from done()

    return run


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, forest: Forest = Forest()
) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents linked by the similarity of their texts.

    Two documents are linked if the distinct shingles of ``n`` words of their whole texts meet
    ``100 * intersection >= percent * union``; a component is what links reach, named by its least id,
    and only the document of that id is kept. Documents of equal sets form one class first, so copies
    cost one row each. Classes stand in the sorted orders of the forest, dealt out by range; each task
    joins up the candidates of its whole regions, or of pairs of blocks of large ones, and what is joined is a cluster. Clusters of more than
    ``forest.block`` classes are cut into blocks and all pairs of blocks are looked at, each in a task
    of its own; every link within a cluster is confirmed on full sets, and only links that join two
    groups leave the task.

    A NULL, empty or blank text has no shingles, is linked with nothing and kept. A row without an id
    is linked with nothing: its component is NULL and it is kept. Rows that share an id are one
    document: each of them has its own n_shingles, and a link of one is a link of all. Other columns
    are ignored, whatever their names.
    """
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    marked = written(given.mapInArrow(given_back(_signatures(n, forest)), "id long, n_shingles long, key binary, signature binary"))
    some = marked.where("id IS NOT NULL AND key IS NOT NULL")
    first = F.min(F.struct("id", "signature"))
    classes = written(some.groupBy("key").agg(first.alias("x")).select("key", "x.id", "x.signature"))

    sketch = F.col("sketch")
    orders = (
        classes.select(
            "id", "signature", F.expr(f"transform(sequence(1, {forest.size}), i -> substring(signature, 4 * i, 1))").alias("s")
        )
        .select("id", "signature", F.concat(*[F.col("s")[i] for i in range(forest.size)]).alias("sketch"))
        .select("id", "signature", sketch, F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
        .selectExpr("tree", f"substring(signature, tree * {4 * forest.depth} + 1, {4 * forest.depth}) AS prefix", "id", "sketch")
    )
    placed = _in_blocks(orders, forest)
    # No region, or pair of its blocks, is divided among tasks.
    candidates = placed.repartitionByRange("tree", "start", "low", "high").sortWithinPartitions("tree", "start", "low", "high", "prefix", "id")
    candidates = candidates.select("tree", "low", "high", "prefix", "id", "sketch")
    near = components(candidates.mapInArrow(given_back(_tree_links(forest)), "a long, b long"))
    clusters = written(near.select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    sizes = written(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / forest.block).cast("int").alias("blocks")))
    members = written(
        clusters.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )
    sets = given.join(members, "id").select("id", "text", "cluster", "blocks", "own")
    sets = sets.mapInArrow(given_back(_sets(n)), "id long, cluster long, blocks int, own int, set binary")
    sets = sets.withColumn("other", F.explode(F.expr("IF(blocks = 1, array(0), array_remove(sequence(0, blocks - 1), own))")))
    sets = sets.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "set")
    group = ["cluster", "low", "high"]
    links = sets.repartition(*group).sortWithinPartitions(*group).mapInArrow(given_back(_confirm(percent)), "a long, b long")

    # A class whose id occurs in another class too is the same document.
    found = components(links.union(_shared_ids(some, classes)))
    named = classes.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    named = written(named.select("key", F.coalesce("component", "id").alias("component_id")))
    linked = some.select("id", "n_shingles", "key").join(named, "key").select("id", "n_shingles", "component_id")
    alone = marked.where("id IS NULL OR key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(
        F.col("id").alias(id),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _in_blocks(orders: DataFrame, forest: Forest) -> DataFrame:
    """Add ``start``, the prefix of a region, and the blocks ``low`` and ``high`` that a row meets: its own region is one block
    up to ``forest.region`` rows; beyond, a row stands in every pair of blocks that its own block is in."""
    started = orders.withColumn("start", F.substring("prefix", 1, 4 * forest.least_depth))
    crowded = started.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > forest.region)
    crowded = written(crowded.select("tree", "start", F.ceil(F.col("n") * 2 / forest.region).cast("int").alias("blocks")))
    dealt = started.join(crowded, ["tree", "start"], "left").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.expr("IF(blocks IS NULL, array(0), array_remove(sequence(0, blocks - 1), own))")
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("own", F.coalesce("own", F.lit(0)))
    return dealt.select("tree", "start", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "prefix", "id", "sketch")


def _shared_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    repeated = some.groupBy("id").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1 AND k1 <> k2").select("id"))
    keys = some.select("id", "key").join(repeated, "id").select(F.col("id").alias("own"), "key").distinct()
    return keys.join(classes.select("key", "id"), "key").selectExpr("own AS a", "id AS b")
