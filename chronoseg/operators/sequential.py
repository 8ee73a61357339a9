"""The kernels by video (or shot), as grouped Arrow functions: a group is one sequence's ids, ranges, scores and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

V = "video_id"


def _vectors(df: pd.DataFrame, column: str = "embedding") -> np.ndarray:
    return np.array(df[column].tolist(), float) if len(df) else np.zeros((0, 1))


def block_max_cuts(frames: DataFrame, threshold: float = 10.0, min_gap: int = 5) -> DataFrame:
    """frames: video_id, frame, cut_score. One cut for each run above the threshold, with suppression between runs."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        taken = K.suppressed_blocks(df["cut_score"].to_numpy(float), threshold, min_gap)
        rows = df.iloc[taken]
        out = pd.DataFrame({V: df[V].iloc[0], "cut": rows["frame"].to_numpy() - 1, "raw_frame": rows["frame"].to_numpy(), "score": rows["cut_score"].to_numpy()})
        return out[out["cut"] > 0].drop_duplicates("cut")

    return frames.select(V, "frame", "cut_score").groupBy(V).applyInPandas(run, f"{V} long, cut long, raw_frame long, score double")


def min_segment(cuts: DataFrame, least: int) -> DataFrame:
    """cuts: video_id, cut, total."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        kept = K.min_segment(df["cut"].tolist(), int(df["total"].iloc[0]), least)
        return pd.DataFrame({V: df[V].iloc[0], "cut": kept, "total": df["total"].iloc[0]})

    return cuts.select(V, "cut", "total").groupBy(V).applyInPandas(run, f"{V} long, cut long, total long")


def greedy_nms(peaks: DataFrame, half: int, radius: int = 72, most: int = 200) -> DataFrame:
    """peaks: video_id, frame, norm, total. Events in the order in which they are taken, from 1."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        taken = df.iloc[K.greedy_nms(df["frame"].to_numpy(), df["norm"].to_numpy(float), radius, most)]
        f, last = taken["frame"].to_numpy(), int(df["total"].iloc[0]) - 1
        start, end = np.maximum(f - half, 0), np.minimum(f + half, last)
        return pd.DataFrame({V: df[V].iloc[0], "event_id": np.arange(1, len(f) + 1), "center": f, "start": start, "end": end, "score": taken["norm"].to_numpy(), "representative_frame": (start + end) // 2})

    return peaks.select(V, "frame", "norm", "total").groupBy(V).applyInPandas(run, f"{V} long, event_id long, center long, start long, end long, score double, representative_frame long")


def peak_candidates(frames: DataFrame, distance: int = 30) -> DataFrame:
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        x = df["score"].to_numpy(float)
        at = K.adaptive_peaks(x, distance)
        return pd.DataFrame({V: df[V].iloc[0], "frame": df["frame"].to_numpy()[at], "score": x[at].round(6)})

    return frames.select(V, "frame", "score").groupBy(V).applyInPandas(run, f"{V} long, frame long, score double")


def peak_zones(frames: DataFrame, distance: int = 30, least: int = 15, most: int = 3) -> DataFrame:
    """frames: video_id, frame, smooth."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        x, f = df["smooth"].to_numpy(float), df["frame"].to_numpy()
        zones = K.peak_zones(x, K.adaptive_peaks(x, distance) if len(x) >= 2 * distance else [], least, most)
        return pd.DataFrame({V: df[V].iloc[0], "start": [f[a] for a, _, _ in zones], "end": [f[b] for _, b, _ in zones], "score": [s for _, _, s in zones]})

    return frames.select(V, "frame", "smooth").groupBy(V).applyInPandas(run, f"{V} long, start long, end long, score double")


def ema_boundaries(vectors: DataFrame, similar: float = 0.70, keep: float = 0.9, reset: bool = False) -> DataFrame:
    """vectors: video_id, shot_id, embedding. Adds boundary and the scene that each row belongs to, the last included."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("shot_id")
        cut = np.array(K.ema_boundaries(_vectors(df), similar, keep, reset), bool)
        return pd.DataFrame({V: df[V], "shot_id": df["shot_id"], "boundary": cut, "scene_id": np.cumsum(cut)})

    return vectors.select(V, "shot_id", "embedding").groupBy(V).applyInPandas(run, f"{V} long, shot_id long, boundary boolean, scene_id long")


def leader_dedup(vectors: DataFrame, similar: float = 0.95) -> DataFrame:
    """vectors: video_id, shot_id, frame, embedding. The key frames that stay; fewer than two stay as they are."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        kept = df.iloc[K.leader_dedup(_vectors(df), similar)]
        return pd.DataFrame({V: kept[V], "shot_id": kept["shot_id"], "frame": kept["frame"], "n_regions": len(kept), "n_dropped": len(df) - len(kept)})

    return vectors.select(V, "shot_id", "frame", "embedding").groupBy(V, "shot_id").applyInPandas(run, f"{V} long, shot_id long, frame long, n_regions long, n_dropped long")


def content_dedup(frames: DataFrame, most_mse: float = 50.0) -> DataFrame:
    """frames: video_id, shot_id, frame, score, embedding. The frames that stay, and the best as representative."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        kept = df.iloc[K.content_dedup(_vectors(df), df["score"].to_numpy(float), most_mse)].sort_values("frame")
        best = kept.sort_values(["score", "frame"], ascending=[False, True])["frame"].iloc[0]
        return pd.DataFrame({V: kept[V], "shot_id": kept["shot_id"], "frame": kept["frame"], "score": kept["score"], "representative": kept["frame"] == best})

    return frames.select(V, "shot_id", "frame", "score", "embedding").groupBy(V, "shot_id").applyInPandas(run, f"{V} long, shot_id long, frame long, score double, representative boolean")


def _pieces(df: pd.DataFrame, each: str = "shot_id") -> tuple[list[K.Piece], pd.DataFrame]:
    df = df.sort_values([each, "shot_id"] if each != "shot_id" else "shot_id").reset_index(drop=True)
    x = K.unit_rows(_vectors(df))
    out = []
    for _, rows in df.groupby(each, sort=False):
        i = rows.index
        words = frozenset(w for ws in rows["words"] for w in ws) if "words" in df else frozenset()
        out.append(K.Piece(int(i[0]), int(i[-1]), int(rows["start"].min()), int(rows["end"].max()), x[i].sum(0), words))
    return out, df


def _as_groups(df: pd.DataFrame, pieces: list[K.Piece], name: str) -> pd.DataFrame:
    return pd.DataFrame(
        {V: df[V].iloc[0], name: range(len(pieces)), "shot_ids": [df["shot_id"].iloc[p.first : p.last + 1].tolist() for p in pieces], "start": [p.start for p in pieces], "end": [p.end for p in pieces]}
    )


def short_merge(shots: DataFrame, least: int, similar: float = 0.3) -> DataFrame:
    """shots: video_id, shot_id, start, end, embedding."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pieces, df = _pieces(df)
        x = K.unit_rows(_vectors(df))
        return _as_groups(df, K.short_merge(pieces, lambda i, j: float(x[i] @ x[j]), least, similar), "scene_id")

    return shots.select(V, "shot_id", "start", "end", "embedding").groupBy(V).applyInPandas(run, f"{V} long, scene_id long, shot_ids array<long>, start long, end long")


def absorb_fragments(shots: DataFrame, least: int, passes: int = 100, ratio: float | None = None, enough: int | None = None) -> DataFrame:
    """shots: video_id, shot_id, scene_id, start, end, embedding. Short scenes (fewer frames than `least`, or than `ratio`
    of the median scene) join their neighbours; a run of them of `enough` frames (else `least`) stands for itself. No shot
    is lost."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pieces, df = _pieces(df, "scene_id")
        short = (lambda ps: float(np.median([p.frames for p in ps])) * ratio) if ratio else (lambda _: least)
        return _as_groups(df, K.absorb_fragments(pieces, short, enough or least, passes), "scene_id")

    return shots.select(V, "shot_id", "scene_id", "start", "end", "embedding").groupBy(V).applyInPandas(run, f"{V} long, scene_id long, shot_ids array<long>, start long, end long")


def absorb_by_words(shots: DataFrame, ratio: float = 0.35, passes: int = 100) -> DataFrame:
    """shots: video_id, shot_id, scene_id, start, end, words (keywords). Scenes shorter than `ratio` of the median scene
    join the neighbour with which they have more keywords in common (overlap coefficient)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pieces, df = _pieces(df.assign(embedding=[[0.0]] * len(df)), "scene_id")
        median = float(np.median([p.frames for p in pieces])) * ratio
        short = lambda ps: float(np.median([p.frames for p in ps])) * ratio
        return _as_groups(df, K.absorb_fragments(pieces, short, median, passes, K.Piece.common_words), "scene_id")

    return shots.select(V, "shot_id", "scene_id", "start", "end", "words").groupBy(V).applyInPandas(run, f"{V} long, scene_id long, shot_ids array<long>, start long, end long")


def best_pair_merge(segments: DataFrame, similar: float = 0.5) -> DataFrame:
    """segments: video_id, start, end, embedding."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("start")
        spans = K.best_pair_merge(_vectors(df), similar)
        a, b = df["start"].to_numpy(), df["end"].to_numpy()
        return pd.DataFrame({V: df[V].iloc[0], "start": [a[i] for i, _ in spans], "end": [b[j] for _, j in spans]})

    return segments.select(V, "start", "end", "embedding").groupBy(V).applyInPandas(run, f"{V} long, start long, end long")


def shortest_first(shots: DataFrame, least: int = 200) -> DataFrame:
    """shots: video_id, start, end, tiling the video."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        bounds = K.shortest_first([*df["start"].tolist(), int(df["end"].max()) + 1], least)
        return pd.DataFrame({V: df[V].iloc[0], "start": bounds[:-1], "end": [b - 1 for b in bounds[1:]]})

    return shots.select(V, "start", "end").groupBy(V).applyInPandas(run, f"{V} long, start long, end long")


def hac(vectors: DataFrame, least: float = 0.25) -> DataFrame:
    """vectors: video_id, shot_id, embedding; average linkage on cosine similarity."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("shot_id")
        x = K.unit_rows(_vectors(df))
        return pd.DataFrame({V: df[V], "shot_id": df["shot_id"], "cluster": K.average_linkage(x @ x.T, least)})

    return vectors.select(V, "shot_id", "embedding").groupBy(V).applyInPandas(run, f"{V} long, shot_id long, cluster long")


def density_frames(vectors: DataFrame, eps: float = 0.25, least: int = 2, most: int = 6) -> DataFrame:
    """vectors: video_id, scene_id, frame, embedding."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        at, n = K.density_frames(_vectors(df), eps, least, most)
        return pd.DataFrame({V: df[V].iloc[0], "scene_id": df["scene_id"].iloc[0], "frame": df["frame"].to_numpy()[at], "n_groups": n})

    return vectors.select(V, "scene_id", "frame", "embedding").groupBy(V, "scene_id").applyInPandas(run, f"{V} long, scene_id long, frame long, n_groups long")


def key_frames(scored: DataFrame, runs: DataFrame, radius: int = 15) -> DataFrame:
    """For each stable run of a shot the best frame within the radius of its smallest change; a single candidate scores
    0. scored: video_id, shot_id, frame, score (change), sharpness, brightness; runs: video_id, shot_id, start, end."""
    from ..functions.score import frame_score
    from .sequence import window_around

    inside = scored.join(runs, [V, "shot_id"]).filter("frame BETWEEN start AND end")
    low = inside.groupBy(V, "shot_id", "start", "end").agg(F.min(F.struct("score", "frame")).alias("_low"))
    near = low.withColumn("frame", F.explode(window_around("_low.frame", radius, "start", "end"))).drop("_low")
    rows = near.join(scored, [V, "shot_id", "frame"])
    by = [V, "shot_id", "start", "end"]
    top = rows.groupBy(*by).agg(F.max("score").alias("_m"), F.max("sharpness").alias("_s"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(top, by).withColumn("value", F.when(F.col("_n") == 1, 0.0).otherwise(frame_score("score", "_m", "sharpness", "_s", "brightness")))
    best = rows.groupBy(*by).agg(F.max(F.struct("value", (-F.col("frame")).alias("f"))).alias("best"))
    return best.select(*by, (-F.col("best.f")).alias("frame"), F.col("best.value").alias("value"))
