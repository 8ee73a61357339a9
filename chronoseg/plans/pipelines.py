"""From change scores to shots and scenes, from scenes to events and chapters, and the signal pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import TextEmbedding
from ..operators import graph, intervals, profiles, sequence, sequential, vectors
from ..params import Params

V = "video_id"


def shots_of(frames: DataFrame, videos: DataFrame, params: Params = Params()) -> DataFrame:
    """Frames to shots that tile each video."""
    cuts = sequence.drop_near_cuts(sequence.threshold_cuts(frames, params.cut_threshold), params.near_cut_gap)
    return sequence.cuts_to_shots(cuts, videos)


def scenes_of(shots: DataFrame, shot_vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """Shots (representative_frame included) and their vectors to scenes: edges, components, runs, cohesion."""
    edges = vectors.banded_edges(shot_vectors, params.edge_similarity, params.band)
    runs = graph.contiguous_runs(graph.components(shots, edges))
    return graph.scenes(runs, shot_vectors, shots, params.cohesion_mean, params.cohesion_p10)


def without_fragments(scenes: DataFrame, shots: DataFrame, shot_vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """Scenes with short ones absorbed."""
    members = scenes.select(V, "scene_id", F.explode("shot_ids").alias("shot_id"))
    rows = members.join(shots.select(V, "shot_id", "start", "end"), [V, "shot_id"]).join(shot_vectors.select(V, "shot_id", "embedding"), [V, "shot_id"])
    return sequential.absorb_fragments(rows, int(params.fragment_seconds * params.fps), params.fragment_passes)


def spoken_scenes(scenes: DataFrame, segments: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Scenes with the text of the segments that overlap them most, and the segments that overlap none."""
    ms = 1000.0 / params.fps
    timed = scenes.select(V, "scene_id", (F.col("start") * ms).alias("scene_start_ms"), ((F.col("end") + 1) * ms).alias("scene_end_ms"))
    text = intervals.scene_text(intervals.assign_by_overlap(segments, timed))
    return scenes.join(text.select(V, "scene_id", "asr_text"), [V, "scene_id"], "left"), intervals.orphans(segments, timed)


def events_and_chapters(scenes: DataFrame, params: Params = Params(), visual: DataFrame | None = None, embed: TextEmbedding | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiled scenes to events (video_id, event_id, scene_ids, start, end) and chapters with titles."""
    grouped = profiles.event_groups(scenes, params.event_score, visual, embed=embed).select(V, "scene_id", "event_id")
    members = scenes.join(grouped, [V, "scene_id"])
    events = profiles.group_profiles(members, [V, "event_id"])
    placed = profiles.chapter_groups(events, params.chapter_score, embed=embed)
    chapters = placed.groupBy(V, "chapter_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list("event_id")).alias("event_ids"), F.sort_array(F.flatten(F.collect_list("scene_ids"))).alias("scene_ids"))
    topics = members.join(placed.select(V, "event_id", "chapter_id"), [V, "event_id"])
    titles = profiles.dominant_value(topics, [V, "chapter_id"], "topic", "scene_id")
    return events.select(V, "event_id", "scene_ids", "start", "end"), chapters.join(titles, [V, "chapter_id"])


def signal_events(frames: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Cuts and events of a change curve alone: block-max cuts with short segments dropped, and suppressed peaks."""
    total = frames.groupBy(V).agg(F.count(F.lit(1)).alias("total"))
    cuts = sequential.block_max_cuts(sequence.cut_scores(frames), params.cut_threshold, params.cut_min_gap)
    cuts = sequential.min_segment(cuts.join(total, V), int(params.fps + 0.5))
    peaks = sequence.local_maxima(sequence.normalize_by_percentile(frames), params.peak_threshold, params.peak_radius, "norm")
    events = sequential.greedy_nms(peaks.join(total, V), int(params.event_half_seconds * params.fps), params.nms_radius, params.nms_most)
    return cuts, events
