"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0..1. Its share of the demand at any time is its
weight over the sum of weights; integrating it gives the cumulative number of words wanted by then. The words a source
supplies are laid end to end in a keyed random order, and inverting the cumulative demand at a copy's midpoint gives its
training position. Documents are range-sorted by that position. Schedules go to sources in code point order, repeating, as
weights do; sources without words demand nothing.

A word is ``[^\\x20\\x09-\\x0D]+``. A null text has size 0. Null is a source of its own, ordered last. Equal rows are
copies like any others and may be taken differently; rows with size 0 are taken 0 times. An empty table gives no rows. Columns of the input
are carried along where stated; helper columns have names that start with ``__mix_``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often.
MOST_EPOCHS = 3.0
#: Steps of the tabulated demand curve.
GRID = 256
Schedule = Sequence[tuple[float, float]]
#: What a source's weight is multiplied by over time, in code point order, repeating; the mean of each is 1.
SHAPES: Sequence[Schedule] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def schedules_of(weights: Sequence[float] = WEIGHTS) -> list[Schedule]:
    """The schedules that are used if none are given: weights times SHAPES, until both repeat."""
    n = math.lcm(len(weights), len(SHAPES))
    return [[(t, float(weights[i % len(weights)]) * x) for t, x in SHAPES[i % len(SHAPES)]] for i in range(n)]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, rank, target) from (source, source_size), rank being that in code point order: the whole size dealt out by weight, no source
    above most times its own size, the excess dealt again by weight until none is above.

    Sorted by the level at which a source is full, the ones that fill up form a prefix; running sums find it. It works on
    one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(ws, (F.pmod("rank", F.lit(n)) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    upto, everything = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    full_before = F.sum("cap").over(upto) - F.col("cap")
    weight_left = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    s = s.withColumn("rate", (F.col("total") - full_before) / weight_left)
    # the first source in order of level that is not full at the rate then left sets the rate of all that follow
    s = s.withColumn("final", F.min(F.when(F.col("level") >= F.col("rate"), F.struct("level", "source", "rate"))).over(everything)["rate"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return s.select("source", "source_size", "weight", "rank", target.alias("target"))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, __mix_digest, __mix_size), a row per row of docs, kept in the shared folder: words are counted once,
    and texts take no part in what follows."""
    text = F.col("text")
    return cut(docs.select("doc_id", "source", F.xxhash64(text).alias("__mix_digest"), words(text).alias("__mix_size")))


def taken(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, seed: int = 7, bucket_words: int = 1 << 20) -> DataFrame:
    """rows_of() docs with __mix_source_size, __mix_target, __mix_rank, __mix_copies (whole copies), __mix_part (words of one
    more, partial copy), __mix_start (words of its source before its first copy, in the keyed order).

    Every row gets floor(target / source_size) whole copies. For the rest, rows are put in a keyed order and taken whole
    while they fit; the row at the boundary is taken in part. Order and running sums come from two levels: sums of
    buckets of the key, then within buckets, so no source meets one task.
    """
    d = rows.withColumns({"__mix_key": F.xxhash64(F.lit(seed), F.col("doc_id")), "__mix_source": F.col("source")})
    sizes = d.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_size").alias("source_size"))
    t = targets(sizes, weights, most).withColumn("__mix_buckets", F.greatest(F.lit(1), (F.col("source_size") / bucket_words).cast("long")))
    t = t.select(F.col("source").alias("__mix_name"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), F.col("rank").alias("__mix_rank"), "__mix_buckets")
    d = d.join(t, F.col("__mix_source").eqNullSafe(F.col("__mix_name"))).drop("__mix_name")
    # keys are uniform: bucket = floor(key's fraction of the range * buckets)
    fraction = F.shiftrightunsigned("__mix_key", 11) / F.lit(float(1 << 53))
    d = d.withColumn("__mix_bucket", F.floor(fraction * F.col("__mix_buckets")))
    sums = d.groupBy("__mix_source", "__mix_bucket").agg(F.sum("__mix_size").alias("__mix_words"))
    before = Window.partitionBy("__mix_source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__mix_source").alias("__mix_s"), F.col("__mix_bucket").alias("__mix_b"), F.coalesce(F.sum("__mix_words").over(before), F.lit(0)).alias("__mix_before"))
    d = d.join(sums, F.col("__mix_source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_bucket") == F.col("__mix_b"))).drop("__mix_s", "__mix_b")
    # rows that are equal in all of these are interchangeable
    within = Window.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_key", "doc_id", "__mix_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__mix_offset", F.col("__mix_before") + F.sum("__mix_size").over(within) - F.col("__mix_size"))
    epochs = F.floor(F.col("__mix_target") / F.col("__mix_source_size") + 1e-12)
    whole = F.when(F.col("__mix_source_size") > 0, epochs).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("__mix_target") - whole * F.col("__mix_source_size")).cast("long")
    more = F.least(F.col("__mix_size"), F.greatest(F.lit(0), rest - F.col("__mix_offset")))
    fits = (more > 0) & (more == F.col("__mix_size"))
    d = d.withColumns({"__mix_copies": (whole + fits.cast("long")).cast("long"), "__mix_part": F.when(fits, F.lit(0)).otherwise(more).cast("long"), "__mix_start": F.col("__mix_offset")})
    return d.drop("__mix_bucket", "__mix_key", "__mix_before", "__mix_offset", "__mix_source")


def demand(schedule: Schedule, others: Sequence[Schedule] = (), grid: int = GRID) -> list[float]:
    """Cumulative share of the demand at grid + 1 even times, scaled to end at 1: the integral of this source's weight
    over the sum of all weights, by Simpson's rule on each step. A schedule is (time, weight) knots; a missing one is flat."""

    def weight(knots: Schedule, t: float) -> float:
        if t <= knots[0][0]:
            return knots[0][1]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0) if t1 > t0 else w1
        return knots[-1][1]

    def share(t: float) -> float:
        own = weight(schedule, t)
        whole = own + sum(weight(o, t) for o in others)
        return own / whole if whole > 0 else 0.0

    out, h = [0.0], 1 / grid
    for i in range(grid):
        out.append(out[-1] + h / 6 * (share(i * h) + 4 * share((i + 0.5) * h) + share((i + 1) * h)))
    if not math.isfinite(out[-1]) or out[-1] <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    return [x / out[-1] for x in out]


def _table(numbers: Sequence[float], kind: str) -> Column:
    """An array of these numbers as one literal: an expression per number would make plans large, and the driver copies plans."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which stands in the plan once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inverse(progress: Column, curve: Sequence[float]) -> Column:
    """Time at which this tabulated curve, which does not fall, reaches progress. A table by even steps of progress says between
    which grid points to look, so that a row compares with a few of them only."""
    grid = len(curve) - 1
    below = [bisect.bisect_right(curve, i / grid) for i in range(grid + 1)]
    steps, least = _table([float(x) for x in curve], "double"), _table(below, "int")

    def above(p: Column) -> Column:
        """Number of the grid point that begins the step which p falls into, from 1."""
        cell = F.least(F.floor(p * grid), F.lit(grid - 1)).cast("int")
        ends = F.slice(least, cell + 1, F.lit(2))
        return _let(ends, lambda e: F.least(F.greatest(e[0] + F.size(F.filter(F.slice(steps, e[0] + 1, e[1] - e[0]), lambda x: x <= p)), F.lit(1)), F.lit(grid)))

    def within(p: Column, k: Column, ends: Column) -> Column:
        inner = F.when(ends[1] > ends[0], (p - ends[0]) / (ends[1] - ends[0])).otherwise(F.lit(0.0))
        return (k - 1 + F.least(inner, F.lit(1.0))) / grid

    return _let(progress, lambda p: _let(above(p), lambda k: _let(F.slice(steps, k, F.lit(2)), lambda ends: within(p, k, ends))))


def position(progress: Column, source: Column, schedules: Mapping[str, Schedule] | None = None, grid: int = GRID) -> Column:
    """Time at which the source's cumulative demand reaches this fraction of its words. Sources without a schedule have a
    flat one, whose demand is inverted by itself."""
    out = progress
    for name, knots in (schedules or {}).items():
        curve = demand(knots, [k for n, k in schedules.items() if n != name], grid)
        out = F.when(source == name, inverse(progress, curve)).otherwise(out)
    return out


def curves(rows: DataFrame, schedules: Sequence[Schedule], grid: int = GRID) -> dict[int, list[float]]:
    """The demand curve of each schedule that sources with words have, by its place. All sources of one schedule have the
    same, so that only their number is needed: rows to the driver are as many as schedules."""
    sources = rows.groupBy("source").agg((F.max("__mix_size") > 0).alias("some"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # as in targets()
    ranked = sources.select("some", F.pmod(rank, F.lit(len(schedules))).alias("at"))
    counts = {r["at"]: r["count"] for r in ranked.where("some").groupBy("at").count().collect()}
    times = lambda at, n: [(t, n * x) for t, x in schedules[at]]
    return {at: demand(schedules[at], [times(o, n - (o == at)) for o, n in counts.items()], grid) for at in counts}


def placed(rows: DataFrame, done: Column, schedules: Mapping[str, Schedule] | Sequence[Schedule] | None, weights: Sequence[float]) -> Column:
    """Training position of a copy in whose source this many words are done at its midpoint."""
    progress = F.least(F.lit(1.0), done / F.col("__mix_target"))
    if isinstance(schedules, Mapping):
        return position(progress, F.col("source"), schedules)
    each = schedules_of(weights) if schedules is None else schedules
    out = F.lit(None).cast("double")
    for at, curve in curves(rows, each).items():
        out = F.when(F.pmod("__mix_rank", F.lit(len(each))) == at, inverse(progress, curve)).otherwise(out)
    return out


def curriculum(docs: DataFrame, schedules: Mapping[str, Schedule] | Sequence[Schedule] | None = None, weights: Sequence[float] = WEIGHTS, **how: object) -> DataFrame:
    """One row per copy that the mix takes, in order of training: the columns of docs, with text cut after the last word
    that is taken, then __mix_position (0..1), __mix_copy and __mix_words. schedules: by name, or repeating, as weights do;
    schedules_of(weights) if there are none. What is taken is planned on narrow rows, which the texts join afterwards."""
    rows = rows_of(docs)
    d = taken(rows, weights, **how)
    # rows of one doc_id, source and text are numbered, so that each joins one of its kind
    same = ["__mix_id", "__mix_source", "__mix_digest"]
    d = d.where((F.col("__mix_copies") > 0) | (F.col("__mix_part") > 0)).withColumns({"__mix_id": F.col("doc_id"), "__mix_source": F.col("source")})
    plan = d.withColumn("__mix_nth", F.row_number().over(Window.partitionBy(*same).orderBy("__mix_start")))
    plan = plan.select(*same, "__mix_nth", "source", *[c for c in d.columns if c.startswith("__mix_") and c not in same])
    plan = plan.withColumnsRenamed({c: f"{c}_p" for c in [*same, "__mix_nth", "source"]})
    texts = docs.withColumns({"__mix_id": F.col("doc_id"), "__mix_source": F.col("source"), "__mix_digest": F.xxhash64("text")})
    texts = texts.withColumn("__mix_nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(*docs.columns))))
    on = F.col("__mix_nth") == F.col("__mix_nth_p")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_p"))
    d = texts.join(plan, on)
    epochs = F.col("__mix_copies") + (F.col("__mix_part") > 0).cast("long")
    d = d.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), epochs.cast("int"))))
    partial = F.col("__mix_copy") > F.col("__mix_copies")
    used = F.when(partial, F.col("__mix_part")).otherwise(F.col("__mix_size"))
    done = (F.col("__mix_copy") - 1) * F.col("__mix_source_size") + F.col("__mix_start") + used / 2
    d = d.withColumns({"__mix_words": used, "__mix_position": placed(rows, done, schedules, weights)})
    d = d.withColumn("text", F.when(partial, _first_words()).otherwise(F.col("text")))
    d = d.select(*docs.columns, "__mix_position", "__mix_copy", "__mix_words")
    return d.repartitionByRange(F.col("__mix_position"), F.col("doc_id")).sortWithinPartitions("__mix_position", "doc_id", "__mix_copy")


def _first_words() -> Column:
    """The text up to the end of its word number __mix_words; the pattern's possessive loops do not go deep."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("__mix_words"), F.lit("}+"))
    return F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))


def mix(docs: DataFrame, schedules: Mapping[str, Schedule] | Sequence[Schedule] | None = None, weights: Sequence[float] = WEIGHTS, **how: object) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, and position (of its first copy; null if not taken), in
    order of position, rows that are not taken last. schedules: see curriculum()."""
    rows = rows_of(docs)
    d = taken(rows, weights, **how)
    first = F.when(F.col("__mix_copies") > 0, F.col("__mix_size")).otherwise(F.col("__mix_part"))
    got = F.col("__mix_copies") * F.col("__mix_size") + F.col("__mix_part")
    at = F.when(got > 0, placed(rows, F.col("__mix_start") + first / 2, schedules, weights))
    d = d.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), got.alias("taken"), at.alias("position"))
    by = F.col("position").asc_nulls_last(), F.col("doc_id")
    return d.repartitionByRange(*by).sortWithinPartitions(*by)
