"""Profiles of groups: top values, topics, speech, and the events and chapters that their scores make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import TextEmbedding, hashed_ngrams
from ..functions.score import chapter_score, event_score
from .intervals import ordered_concat
from .sequence import adjacent_groups

V = "video_id"


def top_values(rows: DataFrame, by: list[str], value: str, order: str, k: int = 3) -> DataFrame:
    """The k most frequent values of each group, blanks apart; of equals, the first to appear."""
    counted = rows.filter(F.length(F.col(value)) > 0).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    kept = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(value))


def dominant_value(rows: DataFrame, by: list[str], value: str, order: str, length: int = 30) -> DataFrame:
    """The most frequent value, the first of equals, cut to a length; an empty string where there is none."""
    best = top_values(rows, by, value, order, 1).select(*by, F.substring(F.col(value)[0], 1, length).alias("title"))
    return rows.select(*by).distinct().join(best, by, "left").withColumn("title", F.coalesce("title", F.lit("")))


def ordered_values(value: str, order: str):
    """An aggregate: the values in order, blanks apart."""
    rows = F.array_sort(F.collect_list(F.when(F.length(F.col(value)) > 0, F.struct(F.col(order), F.col(value)))))
    return F.transform(rows, lambda r: r[value])


def group_profiles(scenes: DataFrame, by: list[str], order: str = "scene_id") -> DataFrame:
    """Profiles of groups of scenes (environment, characters, event, story_role, topic, visual_summary, asr_text): the
    three most frequent of each, all distinct topics and the texts in order."""
    out = scenes.groupBy(*by).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sort_array(F.collect_list("scene_id")).alias("scene_ids"),
        F.array_distinct(ordered_values("topic", order)).alias("topics"),
        F.array_join(ordered_values("visual_summary", order), " ").alias("summary"),
        F.substring(F.array_join(ordered_values("asr_text", order), " "), 1, 500).alias("asr"),
    )
    for value, name in (("environment", "environments"), ("characters", "characters"), ("story_role", "story_roles"), ("event", "events")):
        top = top_values(scenes, by, value, order).withColumnRenamed(value, name)
        out = out.join(top, by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def scene_profiles(scenes: DataFrame, embed: TextEmbedding | None = None) -> DataFrame:
    """A scene's own values as sets, with the vectors that scores compare (of texts, by embed)."""
    embed = embed or hashed_ngrams()
    one = lambda c: F.when(F.length(F.col(c)) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    said = F.substring(F.coalesce("asr_text", F.lit("")), 1, 500)
    return scenes.select(
        V, "scene_id", "start", "end",
        F.struct(one("environment").alias("environments"), one("topic").alias("topics"), one("characters").alias("characters"), embed(F.col("topic")).alias("topic_vec"), said.alias("asr"), embed(said).alias("asr_vec")).alias("profile"),
    )


def event_groups(scenes: DataFrame, threshold: float = 0.17, visual: DataFrame | None = None, digits: int = 6, embed: TextEmbedding | None = None) -> DataFrame:
    """Scenes by start with the score to the one before and the event they belong to. visual: video_id, scene_id, visual
    (similarity to the scene before); without it that part is 0."""
    rows = scene_profiles(scenes, embed)
    rows = rows.join(visual, [V, "scene_id"], "left") if visual is not None else rows.withColumn("visual", F.lit(0.0))
    before = F.lag("profile").over(Window.partitionBy(V).orderBy("start", "scene_id"))
    rows = rows.withColumn("before", before)
    scored = rows.withColumn("score", F.when(F.col("before").isNotNull(), F.round(event_score("before", "profile", "visual"), digits)))
    return adjacent_groups(scored, "start", "score", threshold, "event_id").drop("before", "profile", "visual")


def chapter_groups(event_profiles: DataFrame, threshold: float = 0.40, digits: int = 6, embed: TextEmbedding | None = None) -> DataFrame:
    """Events (group_profiles by event_id) with the score to the one before and the chapter they belong to."""
    fields = ["topics", "environments", "characters", "story_roles", "events", "summary"]
    rows = event_profiles.withColumn("_p", F.struct(*fields, (embed or hashed_ngrams())(F.col("summary")).alias("summary_vec")))
    rows = rows.withColumn("_b", F.lag("_p").over(Window.partitionBy(V).orderBy("event_id")))
    scored = rows.withColumn("score", F.when(F.col("_b").isNotNull(), F.round(chapter_score("_b", "_p"), digits)))
    return adjacent_groups(scored, "event_id", "score", threshold, "chapter_id").drop("_p", "_b")


def group_ranges(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """Range, members and number of members of each group."""
    return rows.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(item)).alias("members"), F.count(F.lit(1)).alias("n"))


def joined_texts(rows: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    return rows.groupBy(*by).agg(ordered_concat(text, F.col(order), "。", trim_stop=True).alias(text))
