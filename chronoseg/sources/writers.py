"""Writing what stages exchange; tables are Parquet by video, documents JSON, one line for each video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params

V = "video_id"


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(V).parquet(path)


def _listed(rows: DataFrame, fields: list, order: str, name: str) -> DataFrame:
    return rows.groupBy(V).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("id"), *fields))).alias(name))


def raw_cuts(videos: DataFrame, cuts: DataFrame) -> DataFrame:
    """One document for each video with its sorted cuts, and empty events."""
    listed = cuts.groupBy(V).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    out = videos.join(listed, V, "left")
    return out.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>"))).withColumn("events", F.array().cast("array<string>"))


def signal_documents(videos: DataFrame, events: DataFrame, cuts: DataFrame, params: Params = Params()) -> DataFrame:
    """One document for each video: its events with their sampled frames (at most params.window_most each) and its cuts, by
    the frame before and the first frame after; at most params.cuts_most and params.nms_most of them, in order."""
    span = F.struct("event_id", "center", "start", "end", F.slice(F.sequence("start", "end"), 1, params.window_most).alias("frames"))
    listed = events.groupBy(V).agg(F.slice(F.sort_array(F.collect_list(span)), 1, params.nms_most).alias("events"))
    cut = cuts.groupBy(V).agg(F.slice(F.sort_array(F.collect_list("cut")), 1, params.cuts_most).alias("cuts"))
    out = videos.join(listed, V, "left").join(cut, V, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
    return out.withColumn("first_frames", F.transform("cuts", lambda c: c + 1))


def skeleton(videos: DataFrame, shots: DataFrame | None = None, scenes: DataFrame | None = None, events: DataFrame | None = None, chapters: DataFrame | None = None) -> DataFrame:
    """The hierarchy as one document for each video; levels that are not given are left out."""
    out, span = videos, F.struct("start", "end").alias("range")
    levels = [(shots, "shots", "shot_id", ["representative_frame", "key_frames"]), (scenes, "scenes", "scene_id", ["shot_ids", "representative_frame", "asr_text"]), (events, "events", "event_id", ["scene_ids"]), (chapters, "chapters", "chapter_id", ["event_ids", "scene_ids", "title"])]
    for rows, name, order, extra in levels:
        if rows is not None:
            out = out.join(_listed(rows, [span, *[F.col(c) for c in extra if c in rows.columns]], order, name), V, "left")
    return out


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    documents.write.mode(mode).json(path)


def write_curve(frames: DataFrame, path: str, fps: float, mode: str = "overwrite") -> None:
    """CSV of frame, time, raw and max-normalised score."""
    from ..operators.sequence import normalize_by_max

    rows = normalize_by_max(frames)
    rows.select(V, "frame", F.round(F.col("frame") / fps, 6).alias("timestamp_sec"), F.col("score").alias("raw_score"), "normalized_score").write.mode(mode).option("header", True).partitionBy(V).csv(path)


def frame_roles(events: DataFrame) -> DataFrame:
    """For each sample frame of events (representative_frames) the events that it stands for."""
    each = events.select(V, "event_id", F.explode("representative_frames").alias("frame"))
    return each.groupBy(V, "frame").agg(F.sort_array(F.collect_set("event_id")).alias("events"), F.count(F.lit(1)).alias("n"))
