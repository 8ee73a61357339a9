"""Intervals in time: merging, assignment by overlap, and look-ups in windows.

Joins on overlap are equi-joins on video and time bin: an interval is listed in every bin it meets, and a pair is kept
only in the bin in which its common part begins, so that no pair appears twice and none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import overlap

V = "video_id"


def min_duration(segments: DataFrame, least_s: float = 0.3) -> DataFrame:
    return segments.filter((F.col("end_ms") - F.col("start_ms")) / 1000 >= least_s)


def gap_merge(segments: DataFrame, gap: int = 500, start: str = "start_ms", end: str = "end_ms", by: tuple[str, ...] = (V,)) -> DataFrame:
    """Merges segments that begin at most `gap` after the latest end so far; the end is the largest."""
    w = Window.partitionBy(*by).orderBy(start, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("_new", F.when(so_far.isNull() | (F.col(start) - so_far > gap), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_group")


def _bins(start: Column, end: Column, width: float) -> Column:
    first = F.floor(start / width).cast("long")
    return F.sequence(first, F.greatest(first, F.floor(end / width).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, bin_width: float, left_range=("start_ms", "end_ms"), right_range=("scene_start_ms", "scene_end_ms")) -> DataFrame:
    """Pairs of the same video whose intervals have a common part of positive length. Columns other than the video's must
    differ between the sides."""
    ls, le, rs, re = (F.col(c) for c in (*left_range, *right_range))
    a = left.withColumn("_bin", F.explode(_bins(ls, le, bin_width)))
    b = right.withColumn("_bin", F.explode(_bins(rs, re, bin_width)))
    both = a.join(b, [V, "_bin"]).filter((ls < re) & (rs < le) & (F.col("_bin") == F.floor(F.greatest(ls, rs) / bin_width)))
    return both.drop("_bin")


def with_text(segments: DataFrame) -> DataFrame:
    return segments.filter(F.length(F.trim("text")) > 0)


def assign_by_overlap(segments: DataFrame, scenes: DataFrame, bin_width: float = 60_000.0) -> DataFrame:
    """Each segment with text to the scene that it overlaps most, the earliest of equals; segments without overlap are
    left out (see orphans). scenes: video_id, scene_id, scene_start_ms, scene_end_ms."""
    pairs = overlap_join(with_text(segments), scenes, bin_width).withColumn("overlap_ms", overlap("start_ms", "end_ms", "scene_start_ms", "scene_end_ms"))
    best = Window.partitionBy(V, "seg_id").orderBy(F.desc("overlap_ms"), "scene_start_ms", "scene_id")
    return pairs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(V, "seg_id", "scene_id", "overlap_ms", "start_ms", "text")


def orphans(segments: DataFrame, scenes: DataFrame, bin_width: float = 60_000.0) -> DataFrame:
    """Segments with text that overlap no scene, and whether they lie within the scenes' hull or at its boundary."""
    segments = with_text(segments)
    hit = overlap_join(segments, scenes, bin_width).select(V, "seg_id").distinct()
    hull = scenes.groupBy(V).agg(F.min("scene_start_ms").alias("_a"), F.max("scene_end_ms").alias("_b"))
    lost = segments.join(hit, [V, "seg_id"], "left_anti").join(hull, V, "left")
    inside = (F.col("start_ms") >= F.col("_a")) & (F.col("end_ms") <= F.col("_b"))
    return lost.select(V, "seg_id", "start_ms", "end_ms", "text", F.when(inside, "interior").otherwise("boundary").alias("reason"))


def contained(segments: DataFrame, scenes: DataFrame, bin_width: float = 60_000.0) -> DataFrame:
    """Segments that overlap any scene."""
    hit = overlap_join(segments, scenes, bin_width).select(V, "seg_id").distinct()
    return segments.join(hit, [V, "seg_id"], "left_semi")


def ordered_concat(text: str, order: Column, separator: str, trim_stop: bool = False) -> Column:
    """An aggregate: texts in order, joined; with trim_stop, all but the last without full stops at their end."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t"))))
    texts = F.transform(rows, lambda r: r["t"])
    if trim_stop:
        texts = F.transform(texts, lambda t, i: F.when(i < F.size(texts) - 1, F.regexp_replace(t, "。+$", "")).otherwise(t))
    return F.array_join(texts, separator)


def scene_text(assigned: DataFrame, separator: str = "。") -> DataFrame:
    """The text of each scene, its segments by start."""
    return assigned.groupBy(V, "scene_id").agg(ordered_concat("text", F.struct("start_ms", "seg_id"), separator).alias("asr_text"), F.count(F.lit(1)).alias("n_segments"))


def context_text(shots: DataFrame, context_s: float, fps: float, bin_s: float = 60.0) -> DataFrame:
    """For each shot the texts of all shots of the video that overlap it widened by the context, in shot order, and
    whether that has more than one character. shots: video_id, shot_id, start, end, text."""
    seconds = lambda c, k: (F.col(c) + k) / fps
    around = shots.select(V, "shot_id", (seconds("start", 0) - context_s).alias("_a"), (seconds("end", 1) + context_s).alias("_b"))
    said = shots.filter(F.length(F.trim("text")) > 0).select(V, F.col("shot_id").alias("_other"), seconds("start", 0).alias("_c"), seconds("end", 1).alias("_d"), F.trim("text").alias("_t"))
    pairs = overlap_join(around, said, bin_s, ("_a", "_b"), ("_c", "_d"))
    texts = pairs.groupBy(V, "shot_id").agg(ordered_concat("_t", F.col("_other"), "。").alias("context"))
    out = shots.join(texts, [V, "shot_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))
    return out.withColumn("text_valid", F.length(F.trim("context")) > 1)


def frames_near(events: DataFrame, frames: DataFrame, half: int, most: int = 100) -> DataFrame:
    """For each event (video_id, event_id, center) the frames within `half` of its center, the first `most` of them."""
    width = float(2 * half + 1)
    a = events.select(V, "event_id", "center", (F.col("center") - half).alias("_a"), (F.col("center") + half + 1).alias("_b"))
    b = frames.select(V, "frame", F.col("frame").alias("_c"), (F.col("frame") + 1).alias("_d"))
    near = overlap_join(a, b, width, ("_a", "_b"), ("_c", "_d")).select(V, "event_id", "center", "frame")
    w = Window.partitionBy(V, "event_id").orderBy("frame")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def reinsert_cuts(segments: DataFrame, cuts: DataFrame, longer_than: int, bin_width: float = 1000.0) -> DataFrame:
    """Cuts strictly inside segments of more than so many frames."""
    long_ones = segments.filter(F.col("end") - F.col("start") + 1 > longer_than).select(V, "start", "end")
    at = cuts.select(V, "cut", F.col("cut").alias("_c"), (F.col("cut") + 1).alias("_d"))
    inside = overlap_join(long_ones, at, bin_width, ("start", "end"), ("_c", "_d"))
    return inside.filter("cut > start AND cut < end").select(V, "cut", "start", "end")


def previous_batch_value(rows: DataFrame, order: str, value: str, batch: int = 4) -> DataFrame:
    """The last non-null value of the rows before the row's batch of so many rows."""
    w = Window.partitionBy(V).orderBy(order)
    rows = rows.withColumn("_batch", F.floor((F.row_number().over(w) - 1) / batch))
    earlier = Window.partitionBy(V).orderBy("_batch").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))).over(earlier)
    return rows.withColumn("previous", last[value]).drop("_batch")
