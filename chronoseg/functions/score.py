"""Weighted scores of frames, scenes and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import jaccard
from .vec import cosine

#: The weights; each set sums to 1.
FRAME_WEIGHTS = {"stability": 0.5, "sharpness": 0.3, "brightness": 0.2}
CHANGE_WEIGHTS = {"hist": 0.6, "resize": 0.4}
EVENT_WEIGHTS = {"topic": 0.35, "visual": 0.25, "characters": 0.20, "environment": 0.10, "asr": 0.10}
CHAPTER_WEIGHTS = {"topic": 0.25, "environment": 0.15, "characters": 0.15, "narrative": 0.15, "time": 0.10, "visual": 0.20}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * parts[name]
    return out


def change_score(hist, resize) -> Column:
    return weighted({"hist": _c(hist), "resize": _c(resize)}, CHANGE_WEIGHTS)


def frame_score(mafd, most_mafd, sharpness, most_sharpness, brightness) -> Column:
    """Stability and sharpness relative to the candidates' largest; brightness best in the middle."""
    parts = {
        "stability": 1 - _c(mafd) / (_c(most_mafd) + 1e-6),
        "sharpness": _c(sharpness) / (_c(most_sharpness) + 1e-6),
        "brightness": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 3 * F.abs(_c(brightness) - 0.5))),
    }
    return weighted(parts, FRAME_WEIGHTS)


def frame_score_old(mafd, sharpness, distance) -> Column:
    parts = {"stability": 1 / (1 + _c(mafd)), "sharpness": _c(sharpness), "brightness": 1 / (1 + _c(distance))}
    return weighted(parts, FRAME_WEIGHTS)


def event_score(a: str, b: str, visual) -> Column:
    """Of two scenes: structs with environments, topics, characters, topic_vec, asr, asr_vec. Parts that cannot be
    compared count environment 0.3, topic 0.1, characters, speech and visual 0."""
    has = lambda f: (F.size(F.col(f"{a}.{f}")) > 0) & (F.size(F.col(f"{b}.{f}")) > 0)
    said = (F.length(F.col(f"{a}.asr")) > 0) & (F.length(F.col(f"{b}.asr")) > 0)
    parts = {
        "topic": F.when(has("topics"), cosine(F.col(f"{a}.topic_vec"), F.col(f"{b}.topic_vec"))).otherwise(0.1),
        "visual": F.coalesce(_c(visual), F.lit(0.0)),
        "characters": jaccard(f"{a}.characters", f"{b}.characters", 0.0, 0.0),
        "environment": jaccard(f"{a}.environments", f"{b}.environments", 0.3, 0.3),
        "asr": F.when(said, cosine(F.col(f"{a}.asr_vec"), F.col(f"{b}.asr_vec"))).otherwise(0.0),
    }
    return weighted(parts, EVENT_WEIGHTS)


def chapter_score(a: str, b: str) -> Column:
    """Of two events: structs with topics, environments, characters, story_roles, events, summary, summary_vec. Adjacent
    events count as continuous in time; two wholly empty ones score 0.45."""
    same = lambda f: jaccard(f"{a}.{f}", f"{b}.{f}")
    told = (F.length(F.col(f"{a}.summary")) > 0) & (F.length(F.col(f"{b}.summary")) > 0)
    parts = {
        "topic": same("topics"),
        "environment": same("environments"),
        "characters": same("characters"),
        "narrative": (same("story_roles") + same("events")) / 2,
        "time": F.lit(1.0),
        "visual": F.when(told, cosine(F.col(f"{a}.summary_vec"), F.col(f"{b}.summary_vec"))).otherwise(0.0),
    }
    return weighted(parts, CHAPTER_WEIGHTS)
