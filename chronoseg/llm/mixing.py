"""Mixing sources to target weights, in the order of a curriculum.

Each source has a weight schedule over the training run, t from 0 to 1, given by its values at equally spaced times and
linear between them. Its integral, scaled to the source's target, is the number of words that the mix demands of the
source up to t. A document stands where that demand reaches the words taken from its source before it: its position is
the inverse of the integral. Sorting all by position (a range partitioning, no global task) gives the training order.

Within a source, documents come in the order of md5 of their id (without one, of their text); running sums over that order are made in two steps, of
hash ranges of some thousand rows each, so that a source with most of the rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows of a source that one hash range has about.
RANGE_ROWS = 4096
#: A source gives at most so many times its size.
MOST = 3


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; null counts as 0."""
    flat = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sizes: source, source_size, one row each. Adds source_rank, weight and target: sources by code point, null last,
    take the weights in turn and share the sum of all sizes by them; what exceeds `most` times a size is shared again
    by weight among the others. The share at which the sums agree is found from the sources in the order in which they
    reach their limit. One row for each source meets in one task here, never one for each document."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("limit", (most * F.col("source_size")).cast("double"))
    reach = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before, after = reach.rowsBetween(Window.unboundedPreceding, -1), reach.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source in that order whose limit isn't reached sets the level for it and all after it
    open_level = F.when(level * F.col("weight") <= F.col("limit"), level)
    ranked = ranked.withColumn("level", F.first(open_level, ignorenulls=True).over(reach.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "source_rank", "weight", target.alias("target"))


def _inverse_demand(share: Column, rank: Column, schedules: list[tuple[float, ...]]) -> Column:
    """The time at which a source's scaled demand reaches `share` of its target. Sources take the schedules in turn."""
    out = F.lit(None).cast("double")
    for k, values in enumerate(schedules):
        step, total, pieces = 1 / (len(values) - 1), 0.0, []
        for a, b in zip(values, values[1:], strict=False):
            pieces.append((total, a, b))
            total += step * (a + b) / 2
        t = F.lit(1.0)
        for i, (start, a, b) in reversed(list(enumerate(pieces))):
            # a x + (b - a) x^2 / (2 step) = needed; the root in a form that has no division by b - a
            needed = F.greatest(share * total - start, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / step) * needed, F.lit(0.0)))
            x = F.when(needed > 0, 2 * needed / (F.lit(a) + root)).otherwise(F.lit(0.0))
            end = start + step * (a + b) / 2
            t = F.when(share * total <= end, i * step + F.least(x, F.lit(step))).otherwise(t)
        out = F.when(rank % len(schedules) == k, t).otherwise(out)
    return out


#: Weights of a source at the run's begin, middle and end, relative to each other; sources take them in turn.
SCHEDULES = [(1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0)]


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), schedules: list[tuple[float, ...]] | None = None, whole: bool = False, id_column: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """One row for each row of docs: the id, size, source, source_size, target, taken, position (of its first word), and
    copy_positions, that of its first word in each pass that takes any of it; with carry, carried: the whole row.

    taken: the words the mix takes of the document, repeats counted; the source's whole passes and then, in the order of
    md5 of the id (or text), what is left of its target, so that a source's taken words add up to its target, rounded. whole: the
    last pass takes whole documents only, each if the half of it is within what is left. Null and empty texts have size
    0 and take nothing; a null source is a source; ties of id are ordered by size; an empty table gives no rows."""
    rows = stash(
        docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("#"), F.coalesce(F.col(text), F.lit("")))).cast("binary")).alias("h"), *[F.struct("*").alias("carried")] * carry),
        "sizes",
    )
    totals = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).select("source", "source_size"), weights)
    ranges = rows.groupBy("source").agg(F.greatest(F.ceil(F.count(F.lit(1)) / RANGE_ROWS), F.lit(1)).cast("long").alias("n_ranges"))
    per_source = stash(totals.join(ranges, totals.source.eqNullSafe(ranges.source)).drop(ranges.source), "sources")
    spread = rows.join(F.broadcast(per_source), rows.source.eqNullSafe(per_source.source)) if per_source.count() <= 100_000 else rows.join(per_source, rows.source.eqNullSafe(per_source.source))
    head = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    spread = spread.drop(per_source.source).withColumn("bin", F.floor(head * F.col("n_ranges") / F.lit(2**32)).cast("long"))
    bins = spread.groupBy("source_rank", "bin").agg(F.sum("size").alias("bin_size"))
    earlier = Window.partitionBy("source_rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source_rank", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("bin_before"))
    inside = Window.partitionBy("source_rank", "bin").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = spread.withColumn("in_bin", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bins, ["source_rank", "bin"])
    before = F.col("in_bin") + F.col("bin_before")
    goal = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - passes * F.col("source_size") - before
    last = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("size"), left))
    schedules = schedules or SCHEDULES
    share = lambda words: F.when(F.col("target") > 0, F.least(words / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    copies = (passes + F.when(last > 0, 1).otherwise(0)).cast("int")
    run = run.withColumns({"before": before, "copies": F.when(F.col("size") > 0, copies).otherwise(F.lit(0))})
    each = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: _inverse_demand(share(p * F.col("source_size") + F.col("before")), F.col("source_rank"), schedules))
    return run.select(
        F.col("id").alias(id_column),
        "size",
        F.col("source"),
        "source_size",
        "target",
        (passes * F.col("size") + last).cast("long").alias("taken"),
        _inverse_demand(share(before), F.col("source_rank"), schedules).alias("position"),
        F.when(F.col("copies") > 0, each).otherwise(F.array().cast("array<double>")).alias("copy_positions"),
        *["carried"] * carry,
    )


def training_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, whole, once for each copy, range-sorted by position over all partitions."""
    mixed = mix_documents(docs, whole=True, carry=True, **options)
    rows = mixed.select(F.explode("copy_positions").alias("position"), "carried")
    return rows.orderBy("position").select("carried.*")


def by_position(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All rows of mix_documents(), those that the mix takes nothing of too, range-sorted by position over all
    partitions; ties by source (null first) and id."""
    return mixed.orderBy("position", "source", id_column)


def training_order(mixed: DataFrame) -> DataFrame:
    """Documents that the mix takes, range-sorted by position over all partitions."""
    return mixed.filter("taken > 0").orderBy("position", "source")
