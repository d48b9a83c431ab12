"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.session import written

from .text import word_count

WEIGHTS = (1.0, 2.0, 3.0)
TOLERANCE = 1e-12
ROUNDS = 60
CELL_BITS = 12


def _source_key(source: Column) -> Column:
    """A key that has a value for NULL too, after all others in code point order."""
    return F.struct(source.isNull().alias("no"), F.coalesce(source, F.lit("")).alias("name"))


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above ``most`` times its source's size.

    Sources are numbered by counting those before each in ranges of the sorted table, so the table of
    sources is neither on the driver nor in one task. Excess is dealt out again by weight until no
    target is above its limit; each round is one aggregate of three sums.
    """
    ordered = written(sources.sort("key").withColumn("_i", F.monotonically_increasing_id()))
    position = F.col("_i") % (1 << 33)
    part = F.floor(F.col("_i") / (1 << 33))
    ends = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row a task
    before, starts = 0, []
    for r in ends:
        starts += [F.lit(r["p"]), F.lit(before)]
        before += r["n"]
    if not starts:
        return sources.select("*", F.lit(0.0).alias("target"), F.lit(1.0).alias("weight"))
    number = F.element_at(F.create_map(*starts), part) + position
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights)).cast("int") + 1)
    table = written(ordered.select("key", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("limit")))
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, free = 0.0, -1
    while True:  # each round fixes one source at least, or ends
        full = F.col("limit") <= F.col("weight") * level if free >= 0 else F.lit(False)
        fixed, open_weight, n_open = table.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(F.when(full, 0).otherwise(1)),
        ).first()
        if not open_weight or n_open == free:
            break
        level, free = max(level, (total - fixed) / open_weight), n_open
    return table.select("key", "source_size", "weight", F.least("limit", F.col("weight") * level).alias("target"))


def _rates(sized: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(key, tilt) such that the rates ``min(most, exp(tilt))`` meet each source's target of words.

    Entropy balancing takes the rates nearest to one copy each, in relative entropy of words, that meet
    the constraints; its convex dual has one multiplier a source. A Newton step needs, per source,
    the words at the present rates (gradient) and those at rates below the limit (curvature): one
    distributed sum over all documents, merged before the shuffle.
    """
    tilts = written(sources.select("key", "target", F.lit(0.0).alias("tilt")))
    for _ in range(ROUNDS):
        now = sized.join(tilts.select("key", "tilt"), "key")
        rate = F.least(F.lit(most), F.exp("tilt"))
        sums = now.groupBy("key").agg(F.sum(F.col("size") * rate).alias("words"))
        step = F.col("target") / F.greatest(F.col("words"), F.lit(1e-300)) - 1
        # A source of no words, or without a target, keeps no copy; steps are held so that exp() stays tame.
        new = F.when((F.col("target") <= 0) | (F.col("words") <= 0), F.lit(-745.0)).otherwise(
            F.col("tilt") + F.least(F.greatest(step, F.lit(-1.0)), F.lit(1.0))
        )
        moved = tilts.join(sums, "key").select("key", "target", new.alias("tilt"), F.abs(new - F.col("tilt")).alias("moved"))
        tilts = written(moved)
        far = tilts.agg(F.max(F.when(F.col("tilt") > -745.0, F.col("moved")).otherwise(0.0))).first()[0]
        if far is None or far <= TOLERANCE:
            break
    return tilts.select("key", "tilt")


def _cuts(sized: DataFrame, extra: DataFrame) -> DataFrame:
    """(key, cut): the place in a source's random order up to which one more copy is taken.

    Places are 60 random bits; words are added up in cells of 12 bits, then in those of the cell that
    the wanted sum falls into, and so on. So no source is sorted, and no more than 4,096 rows of a
    source meet in a task. The cut is before or after the document that crosses, whichever is nearer.
    """
    state = written(extra.select("key", "wanted", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("below")))
    running = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, 60 // CELL_BITS + 1):
        down = 60 - level * CELL_BITS
        parent = F.shiftright("u", down + CELL_BITS)
        inside = sized.join(state.select("key", F.col("cell").alias("up")), "key").where(parent == F.col("up"))
        cells = inside.groupBy("key", F.shiftright("u", down).alias("cell")).agg(F.sum("size").cast("double").alias("words"))
        summed = cells.select("key", "cell", "words", F.sum("words").over(running).alias("to"))
        crossing = summed.join(state.select("key", "wanted", "below"), "key")
        at = F.min_by(F.struct("cell", "words", "to"), "cell")
        crossing = crossing.where(F.col("below") + F.col("to") >= F.col("wanted")).groupBy("key").agg(
            at.alias("x"), F.first("wanted").alias("wanted"), F.first("below").alias("was")
        )
        state = written(
            crossing.select(
                "key", "wanted", F.col("x.cell").alias("cell"), (F.col("was") + F.col("x.to") - F.col("x.words")).alias("below"), F.col("x.words").alias("words")
            )
        )
    after = F.col("below") + F.col("words") - F.col("wanted") < F.col("wanted") - F.col("below")
    return state.select("key", (F.col("cell") + F.when(after, 1).otherwise(0)).alias("cut"))


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = 3,
    seed: int = 11,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row: how often the mix takes it; or the
    columns ``keep`` of every row and its copies.

    The size is the number of words of the whole text (NULL: 0). Sources in code point order, NULL last,
    weigh ``weights`` in turn and share ``share`` of all words; no target is above ``most`` times its
    source's words. Rates of documents come from entropy balancing and are rounded into copies: every
    document has the whole part, and as many as needed, in an order fixed by a hash of id, text
    size and seed, have one more, so a source's words are within half a document of its target and
    reruns agree. Equal rows have equal places and are rounded together. A row without an id, an
    empty text and a source without words are defined like any other (the latter's target is 0).
    Other columns are ignored.
    """
    placed = F.expr(f"shiftright(xxhash64(`{id}`, `{text}`, {seed}L) & 9223372036854775807L, 3)")
    kept = F.struct(*[F.col(c) for c in keep or []]) if keep else F.lit(True)
    sized = written(
        docs.select(
            F.col(id).cast("long").alias("id"),
            _source_key(F.col(source).cast("string")).alias("key"),
            placed.alias("u"),
            word_count(F.col(text)).alias("size"),
            kept.alias("kept"),
        )
    )
    sources = written(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    targets = written(_targets(sources, weights, share, float(most)))
    tilts = _rates(sized, targets, float(most))
    rate = F.least(F.lit(float(most)), F.exp("tilt"))
    whole = F.floor(rate + 1e-9)
    plan = written(targets.join(tilts, "key").select("key", "source_size", "target", rate.alias("rate"), whole.alias("whole")))
    extra = plan.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted"))
    cuts = _cuts(sized, extra.where("wanted > 0"))
    plan = written(plan.join(cuts, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")))
    copies = F.least(F.lit(most), F.col("whole") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)).cast("int")
    if keep:  # rows carry their decision, whatever their ids
        return sized.join(plan, "key").select("kept", copies.alias("_copies")).select(*[F.col("kept")[c].alias(c) for c in keep], F.col("_copies").alias("copies"))
    return (
        sized.join(plan, "key")
        .select(F.col("id").alias(id), "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
