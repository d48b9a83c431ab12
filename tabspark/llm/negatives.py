"""Hard negatives for anchors, found by walking lists that clusters of anchors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.session import written

Batches = Iterator[pa.RecordBatch]

MOST_CLUSTERS = 8  # a row is in as many lists at most, whatever the size of the input
MEMBERS_PER_CLUSTER = 8
SAMPLE_ANCHORS = 8192
SAFE_ANGLE = 1e-6
STEP = 512
EXACT_IN_DOUBLE = float(1 << 53)


def _integer(batches: Batches) -> Batches:
    """(id, label, vector) to (id, label, dims, exact, norm): floor(256 * x) of each component, as integers of
    16 bits where all fit, else of 64."""
    for b in batches:
        exact = [np.floor(256.0 * np.array(v, np.float64)) for v in b.column(2).to_pylist()]
        exact = [e.astype("<i2" if np.abs(e).max(initial=0) < 1 << 15 else "<i8") for e in exact]
        norms = [float(np.sqrt(np.square(e.astype(np.float64)).sum())) for e in exact]
        columns = [pa.array([len(e) for e in exact], pa.int32()), pa.array([e.tobytes() for e in exact], pa.binary()), pa.array(norms, pa.float64())]
        yield pa.record_batch([b.column(0), b.column(1), *columns], names=["id", "label", "dims", "exact", "norm"])


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return _stack(column.to_pylist(), dims)


def _stack(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    short = np.array([len(r) == 2 * dims for r in rows], bool)
    for kind, which in (("<i2", short), ("<i8", ~short)):
        at = np.flatnonzero(which)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dims)
    return out


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """All inner products as 64-bit integers: in doubles while every sum fits one exactly."""
    if largest < EXACT_IN_DOUBLE:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Clusters:
    """Directions to which anchors and candidates are compared, for each length of vectors.

    Fitted by a few rounds of spherical k-means on a sample of anchors. Vectors of a length that the sample
    lacks have one cluster without a direction, whose bound is the product of norms.
    """

    def __init__(self, sample: list[tuple[int, bytes]], n_anchors: int):
        self.first: dict[int, int] = {}  # of each length: the number of its first cluster
        self.centres: dict[int, np.ndarray] = {}
        by_dims: dict[int, list[bytes]] = {}
        for dims, exact in sample:
            by_dims.setdefault(dims, []).append(exact)
        number = 1  # 0 is the cluster of lengths that the sample lacks
        for dims in sorted(by_dims):
            x = _stack(by_dims[dims], dims).astype(np.float64)
            x = x[np.square(x).sum(axis=1) > 0]
            wanted = min(MOST_CLUSTERS, -(-n_anchors * len(by_dims[dims]) // (len(sample) * MEMBERS_PER_CLUSTER)), len(x))
            if wanted:
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                self.first[dims], self.centres[dims] = number, self._fit(x, wanted)
                number += len(self.centres[dims])

    @staticmethod
    def _fit(x: np.ndarray, k: int) -> np.ndarray:
        centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
        for _ in range(8):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        return centres

    def angles(self, x: np.ndarray, norms: np.ndarray) -> tuple[int, np.ndarray]:
        """The first cluster of this length and the angle of every vector to each of them (0 for zero vectors)."""
        centres = self.centres.get(x.shape[1])
        if centres is None:
            return 0, np.zeros((len(x), 1))
        cosine = (x.astype(np.float64) @ centres.T) / np.maximum(norms, 1e-300)[:, None]
        return self.first[x.shape[1]], np.arccos(np.clip(np.where(norms[:, None] > 0, cosine, 1.0), -1.0, 1.0))


def _assign(clusters: Clusters) -> Callable[[Batches], Batches]:
    """Every anchor to its nearest direction, with the angle to it."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            dims = b.column(2).to_numpy()
            cluster, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                first, turn = clusters.angles(_vectors(b.column(3).take(pa.array(at)), int(d)), b.column(4).to_numpy()[at])
                near = np.argmin(turn, axis=1)
                cluster[at], angle[at] = first + near, turn[np.arange(len(at)), near]
            yield pa.record_batch([*b.columns, pa.array(cluster), pa.array(angle)], names=["id", "label", "dims", "exact", "norm", "cluster", "angle"])

    return run


def _listed(clusters: Clusters) -> Callable[[Batches], Batches]:
    """Candidates to the lists that need them, with the bound that orders a list.

    No member of a cluster, taken as of norm 1, has a higher product with a candidate than the candidate's
    norm times the cosine of its angle to the direction less the cluster's radius. A row tells the clusters
    to try, their radii, and the least score a norm of 1 that any member still needs.
    """

    def run(batches: Batches) -> Batches:
        for b in batches:
            dims = b.column(2).to_numpy()
            rows, numbers, bounds = [], [], []
            tried, radii, needs = (b.column(i).to_pylist() for i in (5, 6, 7))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                norms = b.column(4).to_numpy()[at]
                first, turn = clusters.angles(_vectors(b.column(3).take(pa.array(at)), int(d)), norms)
                known = clusters.centres.get(int(d)) is not None
                for i, r in enumerate(at):
                    of = np.array(tried[r], np.int64) - first
                    fits = (of >= 0) & (of < turn.shape[1])
                    if not fits.any():
                        continue
                    of, radius, need = of[fits], np.array(radii[r])[fits], np.array(needs[r])[fits]
                    apart = np.maximum(turn[i, of] - radius - SAFE_ANGLE, 0.0) if known else np.zeros(len(of))
                    bound = norms[i] * (np.cos(apart) + 1e-12)
                    for j in np.flatnonzero(bound >= need):
                        rows.append(r)
                        numbers.append(first + of[j])
                        bounds.append(bound[j])
            names = ["cluster", "id", "label", "dims", "exact", "norm", "bound"]
            rows = pa.array(rows, pa.int64())
            kept = [b.column(c).take(rows) for c in range(5)]
            yield pa.record_batch([pa.array(numbers, pa.int32()), *kept, pa.array(bounds, pa.float64())], names=names)

    return run


def _by_length(members: pa.Table, listed: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table, pa.Table, float]]:
    """The members of a cell and its sorted list, for each length of vectors, with the largest product of norms."""
    for d in np.unique(members.column("dims").to_numpy()):
        ours = members.filter(pc.equal(members.column("dims"), int(d)))
        rows = listed.filter(pc.equal(listed.column("dims"), int(d)))
        if rows.num_rows:
            rows = rows.take(pa.array(np.lexsort((rows.column("id").to_numpy(), -rows.column("bound").to_numpy()))))
            a = _vectors(ours.column("exact").combine_chunks(), int(d))
            largest = float(ours.column("norm").to_numpy().max()) * float(rows.column("norm").to_numpy().max())
            yield a, ours, rows, largest


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class _Wanted:
    """What a member still looks for: its k best scores in a range, and when no later score can matter."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.low) & (scores <= self.high)
        if fit.any():
            both = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
            self.scores, self.ids = _best(*both, self.k)
            if len(self.scores) == self.k:
                self.low = max(self.low, int(self.scores[-1]))  # an equal score may have a smaller id


def _walk(members: pa.Table, listed: pa.Table, wanted: list[list[_Wanted]], same_label: bool) -> None:
    """Every member reads the list in order of the shared bound until no later row can be among its own."""
    at = {int(i): n for n, i in enumerate(members.column("id").to_pylist())}
    for a, ours, rows, largest in _by_length(members, listed):
        places = [at[int(i)] for i in ours.column("id").to_pylist()]
        norms, labels, own = (ours.column(c).to_numpy() for c in ("norm", "label", "id"))
        bounds, row_labels, ids = (rows.column(c).to_numpy() for c in ("bound", "label", "id"))
        exact = rows.column("exact").combine_chunks()
        active = [n for n, p in enumerate(places) if wanted[p]]
        for start in range(0, len(ids), STEP):
            reach = bounds[start]
            limits = norms * reach + 1e-9 * np.abs(norms * reach)
            active = [n for n in active if any(limits[n] >= w.low for w in wanted[places[n]])]
            if not active:
                break
            part = slice(start, start + STEP)
            scores = _products(a[active], _vectors(exact[part], a.shape[1]), largest)
            for row, n in zip(scores, active):
                fits = (row_labels[part] == labels[n]) == same_label
                fits &= ids[part] != own[n]
                fits &= row >= min(w.low for w in wanted[places[n]])
                if fits.any():
                    for w in wanted[places[n]]:
                        w.offer(row[fits], ids[part][fits])


_POSITIVES = "anchor_id long, positive_id long, positive_score long"
_NEGATIVES = "anchor_id long, positive_score long, negative_id long, negative_score long"
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)


def _find_positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(members: pa.Table, listed: pa.Table) -> pa.Table:
        wanted = [[_Wanted(k, floor, HIGHEST)] for floor in members.column("floor").to_pylist()]
        if members.num_rows and listed.num_rows:
            _walk(members, listed, wanted, same_label=True)
        rows = [(a, int(i), int(s)) for a, (w,) in zip(members.column("id").to_pylist(), wanted) for s, i in zip(w.scores, w.ids)]
        return _table(rows, ["anchor_id", "positive_id", "positive_score"])

    return run


def _find_negatives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(members: pa.Table, listed: pa.Table) -> pa.Table:
        wanted = [[_Wanted(k, r["low"], r["high"]) for r in ranges] for ranges in members.column("ranges").to_pylist()]
        scores = [[r["positive_score"] for r in ranges] for ranges in members.column("ranges").to_pylist()]
        if members.num_rows and listed.num_rows:
            _walk(members, listed, wanted, same_label=False)
        rows = [
            (a, p, int(i), int(s))
            for a, ws, ps in zip(members.column("id").to_pylist(), wanted, scores)
            for w, p in zip(ws, ps)
            for s, i in zip(w.scores, w.ids)
        ]
        return _table(rows, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    every: int = 100,
    low_percent: int = 30,
    high_percent: int = 90,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    rows_per_list: int = 8192,
    members_per_list: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly.

    Components count as floor(256 * x) of x as a double; a score is the integer inner product, higher ones
    come first, ties go to the smaller id. Anchors are the rows whose id is divisible by ``every``; their
    positives are the first ``positives`` other rows of the same label. For each of these come the first
    ``negatives`` rows of another label whose score is ``low_percent`` to ``high_percent`` of the positive's
    (so none for a positive score below 0). Fewer are all.

    Rows without an id, label or vector, or with a NULL or not finite component, take no part; only vectors
    of equal length meet. Rows of one id are one row: equal ones count once, of different ones the first in
    order of vector and label. Of equal vectors with one label only the least ids can be among the first,
    so the others are left out of the lists. Products of norms must be below 2^62. Other columns are ignored.

    Anchors are clustered by direction, on at most ``SAMPLE_ANCHORS`` of them (this fits an index and loses
    nothing). For each cluster the candidates are sorted once by an upper bound that holds for all members, and
    every member walks that list until its bound proves that no later row can matter. Lists are dealt out
    by a hash of the id into parts of about ``rows_per_list`` rows, members into groups of about
    ``members_per_list``, so a cell is bounded however large a cluster is. A first walk, over a share of the
    rows drawn by hash that fills one part, gives every anchor a floor; the lists of the second walk hold, of
    all other rows, those whose bound reaches the lowest floor of the cluster.
    """
    value = F.col(vector)
    given = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), value.cast("array<double>").alias("v"))
    given = given.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    given = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    shape = "id long, label long, dims int, exact binary, norm double"
    whole = given.mapInArrow(_integer, shape)
    whole = whole.groupBy("id").agg(F.min(F.struct("dims", "exact", "label", "norm")).alias("x"))
    whole = written(whole.select("id", "x.label", "x.dims", "x.exact", "x.norm"))

    anchors = whole.where(F.col("id") % every == 0)
    sample = anchors.select("dims", "exact").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ANCHORS).collect()
    n_anchors = anchors.count()
    clusters = Clusters([(r["dims"], r["exact"]) for r in sample], n_anchors)
    shape += ", cluster int, angle double"
    anchors = written(anchors.mapInArrow(_assign(clusters), shape))

    # An anchor's own row may be one of its equals, so one more is kept than can be wanted.
    equals = Window.partitionBy("dims", "exact", "label").orderBy("id")
    most = max(positives + 1, negatives)
    rows = whole.withColumn("_r", F.row_number().over(equals)).where(F.col("_r") <= most).drop("_r")
    n_parts = max(1, -(-whole.count() // rows_per_list))
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_parts)).cast("int")))
    listed_shape = "cluster int, id long, label long, dims int, exact binary, norm double, bound double"

    def lists(members: DataFrame, by_label: bool, first: bool) -> DataFrame:
        """Rows of the first part, or of the others, to the clusters whose members may need them."""
        need = F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm") - 1e-9 * F.abs(F.col("floor") / F.col("norm"))).otherwise(float(LOWEST)))
        of = members.groupBy("cluster", *(["label"] if by_label else [])).agg(F.max("angle").alias("radius"), need.alias("need"))
        routes = of.groupBy("label") if by_label else of.groupBy()
        routes = routes.agg(F.collect_list(F.struct("cluster", "radius", "need")).alias("to"))
        part = rows.where("shard = 0" if first else "shard > 0")
        if by_label:
            sent = part.join(routes, "label")
        else:  # one row, held by the plan
            to = routes.first()["to"]
            sent = part.withColumn("to", F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(r).alias("radius"), F.lit(n).alias("need")) for c, r, n in to]))
            if not to:
                sent = sent.where(F.lit(False)).withColumn("to", F.lit(None).cast("array<struct<cluster:int,radius:double,need:double>>"))
        sent = sent.select("id", "label", "dims", "exact", "norm", "to.cluster", "to.radius", "to.need")
        return sent.mapInArrow(_listed(clusters), listed_shape)

    def walked(members: DataFrame, by_label: bool, first: bool, find: Callable, out: str) -> DataFrame:
        sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / members_per_list).cast("int").alias("groups"))
        listed = lists(members, by_label, first)
        if first:
            sizes = written(sizes.withColumn("parts", F.lit(1)))
        else:
            parts = listed.groupBy("cluster").agg(F.ceil(F.count("*") / rows_per_list).cast("int").alias("parts"))
            sizes = written(sizes.join(parts, "cluster"))
        cell = ["cluster", "group", "part"]
        dealt = members.join(sizes, "cluster").withColumn("group", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("groups", "parts")
        sent = listed.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
        sent = sent.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "parts")
        return dealt.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(find, out)

    def first_of(found: DataFrame, group: list[str], score: str, other: str, k: int) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col(score).desc(), other)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def both(members: Callable[[DataFrame | None], DataFrame], by_label: bool, find: Callable, out: str, group: list[str], score: str, other: str, k: int) -> DataFrame:
        found = written(walked(members(None), by_label, True, find, out))
        if n_parts > 1:
            full = found.groupBy(*group).agg(F.count("*").alias("n"), F.min(score).alias("kth")).where(F.col("n") == k).drop("n")
            found = written(found.union(walked(members(written(full)), by_label, False, find, out)))
        return written(first_of(found, group, score, other, k))

    def with_floor(full: DataFrame | None) -> DataFrame:
        if full is None:
            return anchors.withColumn("floor", F.lit(LOWEST).cast("long"))
        found = anchors.join(full.withColumnRenamed("anchor_id", "id"), "id", "left")
        return written(found.withColumn("floor", F.coalesce("kth", F.lit(LOWEST).cast("long"))).drop("kth"))

    chosen = both(with_floor, True, _find_positives(positives), _POSITIVES, ["anchor_id"], "positive_score", "positive_id", positives)

    score = F.col("positive_score").cast("decimal(38,0)")
    low = F.ceil(score * low_percent / 100).cast("long")
    high = F.floor(score * high_percent / 100).cast("long")
    wanted = chosen.select("anchor_id", "positive_score", low.alias("low"), high.alias("high")).distinct()
    wanted = written(wanted.where(f"{low_percent} * CAST(positive_score AS decimal(38,0)) <= {high_percent} * CAST(positive_score AS decimal(38,0)) AND low <= high"))

    def with_ranges(full: DataFrame | None) -> DataFrame:
        ranges = wanted.withColumn("kth", F.lit(None).cast("long")) if full is None else wanted.join(full, ["anchor_id", "positive_score"], "left")
        ranges = ranges.withColumn("low", F.greatest("low", "kth"))
        ranges = ranges.groupBy(F.col("anchor_id").alias("id")).agg(
            F.min("low").alias("floor"), F.collect_list(F.struct("positive_score", "low", "high")).alias("ranges")
        )
        return written(anchors.join(ranges, "id"))

    group = ["anchor_id", "positive_score"]
    found = both(with_ranges, False, _find_negatives(negatives), _NEGATIVES, group, "negative_score", "negative_id", negatives)
    out = chosen.drop("rank").join(found, group)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
