"""Ordered sequences: differences, cuts, shots, islands, runs and peaks. All windows are partitioned by video."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = "video_id"


def over(order: str = "frame", *more):
    return Window.partitionBy(V).orderBy(order, *more)


def adjacent_difference(frames: DataFrame) -> DataFrame:
    """Absolute difference of each score to the one before; null on the first frame."""
    return frames.withColumn("diff", F.abs(F.col("score") - F.lag("score").over(over())))


def cut_scores(frames: DataFrame) -> DataFrame:
    """A frame's cut score is the smaller of its score and of its jump; 0 on the first frame."""
    jump = F.abs(F.col("score") - F.lag("score").over(over()))
    return frames.withColumn("cut_score", F.when(jump.isNull(), 0.0).otherwise(F.least("score", jump)))


def threshold_cuts(frames: DataFrame, threshold: float) -> DataFrame:
    """Frames before those whose cut score exceeds the threshold, strictly inside (1, total)."""
    total = F.count(F.lit(1)).over(Window.partitionBy(V))
    scored = cut_scores(frames).withColumn("total", total)
    return scored.filter((F.col("frame") > 0) & (F.col("cut_score") > threshold)).select(V, (F.col("frame") - 1).alias("cut"), "total").filter("cut > 1 AND cut < total")


def times_to_cuts(times: DataFrame, fps: float) -> DataFrame:
    """Cut times in seconds to frames before the cut, strictly inside (1, total)."""
    return times.select(V, (F.round(F.col("seconds") * fps).cast("long") - 1).alias("cut"), "total").filter("cut > 1 AND cut < total")


def drop_near_cuts(cuts: DataFrame, least: int = 2) -> DataFrame:
    """Drops a cut nearer than `least` to the one before it, kept or not: a chain collapses to its first."""
    gap = F.col("cut") - F.lag("cut").over(over("cut"))
    return cuts.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= least)).drop("gap")


def cuts_to_shots(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """Shots [start, end] that tile [0, total - 1]: videos has video_id and total; cuts outside (0, total) and repeats do
    not count. A video without cuts is one shot, one without frames none."""
    inner = cuts.select(V, "cut").join(videos.select(V, "total"), V).filter("cut > 0 AND cut < total").select(V, F.col("cut").cast("long").alias("b"))
    ends = videos.filter("total > 0").select(V, F.explode(F.array(F.lit(0).cast("long"), F.col("total").cast("long"))).alias("b"))
    bounds = inner.unionByName(ends).distinct()
    shots = bounds.withColumn("end", F.lead("b").over(over("b")) - 1).filter("end IS NOT NULL")
    return shots.select(V, (F.row_number().over(over("b")) - 1).alias("shot_id"), F.col("b").alias("start"), "end")


def segment_plan(cuts: DataFrame, videos: DataFrame, style: str = "tiles") -> DataFrame:
    """What a renderer would cut: near cuts dropped, `tiles` [prev, cut - 1], `inner` without the first and last frame,
    `left` with the cut frame in the left segment."""
    shots = cuts_to_shots(drop_near_cuts(cuts), videos)
    if style == "inner":
        shots = shots.withColumns({"start": F.col("start") + 1, "end": F.col("end") - 1}).filter("end >= start")
    if style == "left":
        last = F.lead("start").over(over("start")).isNull()
        shots = shots.withColumns({"start": F.when(F.col("start") > 0, F.col("start") + 1).otherwise(F.col("start")), "end": F.when(last, F.col("end")).otherwise(F.col("end") + 1)})
    return shots.withColumn("n", F.col("end") - F.col("start") + 1)


def islands(rows: DataFrame, flag: Column, order: str = "frame") -> DataFrame:
    """Numbers the runs of consecutive rows where flag holds; other rows go."""
    w = over(order)
    rows = rows.withColumn("_n", F.row_number().over(w)).filter(flag)
    return rows.withColumn("island", F.col("_n") - F.row_number().over(over(order))).drop("_n")


def block_max_cuts(frames: DataFrame, threshold: float) -> DataFrame:
    """One cut for each run of frames whose cut score exceeds the threshold: the frame before the best, the first of
    equals; cuts at or before 0 go. (With suppression between blocks see sequential.block_max_cuts.)"""
    runs = islands(cut_scores(frames), F.col("cut_score") > threshold)
    best = runs.groupBy(V, "island").agg(F.max(F.struct("cut_score", (-F.col("frame")).alias("f"))).alias("best"))
    return best.select(V, (-F.col("best.f") - 1).alias("cut"), (-F.col("best.f")).alias("raw_frame"), F.col("best.cut_score").alias("score")).filter("cut > 0")


def normalize_by_percentile(frames: DataFrame, p: float = 0.99) -> DataFrame:
    """Scores over their percentile in the video; 0 where that is not positive."""
    top = frames.groupBy(V).agg(F.percentile("score", F.lit(p)).alias("top"))
    return frames.join(top, V).withColumn("norm", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).drop("top")


def normalize_by_max(frames: DataFrame) -> DataFrame:
    """Scores over the largest of frames from 1 on, and the frame's time."""
    top = frames.filter("frame >= 1").groupBy(V).agg(F.max("score").alias("top"))
    return frames.join(top, V, "left").withColumn("normalized_score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).drop("top")


def local_maxima(frames: DataFrame, threshold: float, radius: int = 12, column: str = "score") -> DataFrame:
    """Frames that are largest within the radius and at least the threshold; all of a plateau; none in the margins."""
    w = over().rowsBetween(-radius, radius)
    place = F.row_number().over(over()) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(V))
    rows = frames.withColumns({"_best": F.max(column).over(w), "_place": place, "_total": total})
    return rows.filter((F.col(column) == F.col("_best")) & (F.col(column) >= threshold) & (F.col("_place") >= radius) & (F.col("_place") < F.col("_total") - radius)).drop("_best", "_place", "_total")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-x * x / (2 * sigma * sigma)) for x in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_smooth(frames: DataFrame, sigma: float = 3.0, by: tuple[str, ...] = (V,)) -> DataFrame:
    """Gaussian smoothing with edges mirrored, the edge sample included. One window reads a frame's neighbours and the
    mirrored ones are taken from the sequence's ends, so nothing is joined; sequences shorter than the kernel fold as often
    as needed."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    w = Window.partitionBy(*by).orderBy("frame")
    whole = Window.partitionBy(*by)
    rows = frames.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})
    near = F.collect_list("score").over(w.rowsBetween(-2 * r, 2 * r))
    rows = rows.withColumns({"_near": near, "_first": F.greatest(F.col("_i") - 2 * r, F.lit(0))})

    def at(j: Column) -> Column:
        m = F.pmod(j, 2 * F.col("_n"))
        m = F.when(m >= F.col("_n"), 2 * F.col("_n") - 1 - m).otherwise(m)
        return F.element_at("_near", (m - F.col("_first") + 1).cast("int"))

    weights = F.array(*[F.lit(x) for x in kernel])
    terms = F.zip_with(F.sequence(F.col("_i") - r, F.col("_i") + r), weights, lambda j, x: at(j) * x)
    return rows.withColumn("smooth", F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)).drop("_i", "_n", "_near", "_first")


def moving_average(frames: DataFrame) -> DataFrame:
    """Average over a window of 6 % of the sequence, 5 to 31 frames, made odd; what lies outside counts as 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(V))
    size = F.greatest(F.lit(5), F.least(F.lit(31), F.rint(n * 0.06).cast("int")))
    size = size + (size % 2 == 0).cast("int")
    near = F.collect_list("score").over(over().rowsBetween(-15, 15))
    rows = frames.withColumns({"_size": size, "_near": near, "_at": F.least(F.row_number().over(over()), F.lit(16))})
    half = F.floor(F.col("_size") / 2).cast("int")
    first = F.greatest(F.lit(1), F.col("_at") - half)
    part = F.slice("_near", first, F.col("_at") + half - first + 1)
    return rows.withColumn("smooth", F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / F.col("_size")).drop("_size", "_near", "_at")


def stable_runs(frames: DataFrame, least: int, p: float = 0.35, column: str = "smooth", by: tuple[str, ...] = (V,)) -> DataFrame:
    """Runs of at least `least` frames whose score is strictly below its percentile in the group. A group without one
    gets a run around its smallest frame, half of `least` to either side, within the group."""
    w = Window.partitionBy(*by).orderBy("frame")
    level = frames.groupBy(*by).agg(F.percentile(column, F.lit(p)).alias("_level"), F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.min(F.struct(column, "frame")).alias("_low"))
    rows = frames.join(level.select(*by, "_level"), list(by)).withColumn("_n", F.row_number().over(w)).filter(F.col(column) < F.col("_level"))
    rows = rows.withColumn("island", F.col("_n") - F.row_number().over(w))
    runs = rows.groupBy(*by, "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).filter(F.col("end") - F.col("start") + 1 >= least).select(*by, "start", "end", F.lit(False).alias("fallback"))
    half = max(least // 2, 1)
    alone = level.join(runs.select(*by).distinct(), list(by), "left_anti")
    alone = alone.select(*by, F.greatest(F.col("_low.frame") - half, F.col("_a")).alias("start"), F.least(F.col("_low.frame") + half, F.col("_b")).alias("end"), F.lit(True).alias("fallback"))
    return runs.unionByName(alone)


def first_runs(runs: DataFrame, k: Column | int, by: tuple[str, ...] = (V,)) -> DataFrame:
    """The first k runs of each group in time."""
    w = Window.partitionBy(*by).orderBy("start")
    return runs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def stable_samples(frames: DataFrame, least_frames: int, most_step: int, p: float = 0.25) -> DataFrame:
    """Frames sampled from runs of at least `least_frames` below a percentile of the positive scores: from the run's
    begin, every half of the run (or of most_step, if that is less)."""
    level = frames.filter("score > 0").groupBy(V).agg(F.percentile("score", F.lit(p)).alias("_level"))
    rows = frames.join(level, V).withColumn("_n", F.row_number().over(over())).filter("score < _level")
    rows = rows.withColumn("island", F.col("_n") - F.row_number().over(over()))
    runs = rows.groupBy(V, "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).filter(F.col("end") - F.col("start") + 1 >= least_frames)
    length = F.least(F.lit(most_step), F.col("end") - F.col("start") + 1)
    step = F.greatest(F.lit(1), F.floor(length / 2)).cast("long")
    return runs.select(V, "start", "end", F.explode(F.sequence("start", "end", step)).alias("frame"))


def heartbeat_cuts(segments: DataFrame, least: int = 200, similar: float = 0.70) -> DataFrame:
    """Bounds at 20, 40, 60 and 80 % of segments longer than `least` whose ends' cosine (similarity) is below `similar`."""
    long_ones = segments.filter((F.col("end") - F.col("start") + 1 > least) & (F.col("similarity") < similar))
    at = F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)]))
    return long_ones.select(V, "start", "end", at.alias("share")).select(V, (F.col("start") + ((F.col("end") - F.col("start")) * F.col("share")).cast("long")).alias("cut"))


def segment_samples(segments: DataFrame) -> DataFrame:
    """The frames at 25, 50 and 75 % of each segment."""
    at = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return segments.select("*", at.alias("share")).withColumn("frame", F.col("start") + ((F.col("end") - F.col("start")) * F.col("share")).cast("long"))


def consecutive_runs(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Splits each group's ids into runs of consecutive ones."""
    w = Window.partitionBy(V, group).orderBy(item)
    return rows.withColumn("run", F.col(item) - F.row_number().over(w))


def adjacent_groups(rows: DataFrame, order: str, score: str, threshold: float, name: str = "group_id") -> DataFrame:
    """A new group begins where the score to the row before is below the threshold (null: the first row)."""
    starts = F.when(F.col(score) < threshold, 1).otherwise(0)
    return rows.withColumn(name, F.sum(starts).over(over(order).rowsBetween(Window.unboundedPreceding, 0)))


def key_frame_tier(start: str, end: str, fps: float) -> Column:
    """How many key frames a shot gets: 2 below 2 s, 4 below 30 s, else 8."""
    seconds = (F.col(end) - F.col(start) + 1) / fps
    return F.when(seconds < 2, 2).when(seconds < 30, 4).otherwise(8)


def key_frames_or_middle(key_frames: str, representative: str, start: str, end: str) -> Column:
    """The key frames, else the representative frame, else the middle."""
    listed = F.when(F.size(F.col(key_frames)) > 0, F.col(key_frames))
    one = F.when(F.col(representative).isNotNull(), F.array(F.col(representative)))
    return F.coalesce(listed, one, F.array(F.floor((F.col(start) + F.col(end)) / 2).cast("long")))


def window_around(frame: str, radius: int, start: str, end: str) -> Column:
    """Frames within the radius, clamped to [start, end]."""
    return F.sequence(F.greatest(F.col(frame) - radius, F.col(start)), F.least(F.col(frame) + radius, F.col(end)))


def even_subsample(items: Column, k: int) -> Column:
    """All items if k or fewer, else those at int(i n / k)."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(items, (F.floor(i * F.size(items) / k) + 1).cast("int")))
    return F.when(F.size(items) <= k, items).otherwise(picked)


def merge_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidate frames (video_id, frame, reason, score) of two kinds; a frame of both keeps the first kind's row."""
    both = first.withColumn("_kind", F.lit(0)).unionByName(second.withColumn("_kind", F.lit(1)))
    w = Window.partitionBy(V, "frame").orderBy("_kind", F.desc("score"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_kind")


def add_cuts(cuts: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of cuts, each cut once."""
    return cuts.select(V, "cut").union(more.select(V, "cut")).distinct()
