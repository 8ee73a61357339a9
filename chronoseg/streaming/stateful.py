"""Operators on frames that arrive one by one. State is kept for each video and is of bounded size."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

V = "video_id"


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values("frame")


def cut_scores(frames: DataFrame) -> DataFrame:
    """frames: video_id, frame, score. Each frame's cut score, from the last score seen."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = _ordered(parts)
        before = [state.get[0] if state.exists else np.nan, *df["score"][:-1]]
        jump = (df["score"] - np.array(before)).abs()
        state.update((float(df["score"].iloc[-1]),))
        yield pd.DataFrame({V: df[V], "frame": df["frame"], "cut_score": np.where(jump.isna(), 0.0, np.minimum(df["score"], jump))})

    return frames.groupBy(V).applyInPandasWithState(step, f"{V} long, frame long, cut_score double", "last double", "append", GroupStateTimeout.NoTimeout)


def ema_boundaries(vectors: DataFrame, similar: float = 0.70, keep: float = 0.9) -> DataFrame:
    """vectors: video_id, frame, embedding. Whether each frame is a boundary; the state is the moving centre."""
    from ..operators.kernels import unit_rows

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df, out = _ordered(parts), []
        centre = pickle.loads(state.get[0]) if state.exists else None
        for x in unit_rows(np.array(df["embedding"].tolist(), float)):
            out.append(centre is not None and float(centre @ x) < similar)
            centre = x if centre is None else unit_rows(keep * centre + (1 - keep) * x)
        state.update((pickle.dumps(centre),))
        yield pd.DataFrame({V: df[V], "frame": df["frame"], "boundary": out})

    return vectors.groupBy(V).applyInPandasWithState(step, f"{V} long, frame long, boundary boolean", "centre binary", "append", GroupStateTimeout.NoTimeout)


def ring_buffer(frames: DataFrame, size: int) -> DataFrame:
    """frames: video_id, frame, score. After each batch the last `size` frames of each video: the batch's newest frame and
    the buffer's frames and scores."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = _ordered(parts)
        held = list(zip(state.get[0], state.get[1], strict=True)) if state.exists else []
        held = (held + list(zip(df["frame"].tolist(), df["score"].tolist(), strict=True)))[-size:]
        state.update(([f for f, _ in held], [s for _, s in held]))
        yield pd.DataFrame({V: [key[0]], "frame": [held[-1][0]], "frames": [[f for f, _ in held]], "scores": [[s for _, s in held]]})

    return frames.groupBy(V).applyInPandasWithState(step, f"{V} long, frame long, frames array<long>, scores array<double>", "frames array<long>, scores array<double>", "append", GroupStateTimeout.NoTimeout)


def speech_sessions(segments: DataFrame, gap_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """segments: video_id, begin, end (timestamps). Segments merged while the gap is at most gap_ms; session windows that
    touch are one session."""
    length = (F.unix_millis("end") - F.unix_millis("begin") + gap_ms).cast("string")
    rows = segments.withWatermark("begin", late)
    merged = rows.groupBy(V, F.session_window("begin", F.concat(length, F.lit(" milliseconds")))).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_merged"))
    return merged.select(V, "begin", "end", "n_merged")
