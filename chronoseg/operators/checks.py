"""Integrity constraints as tables of violations: none is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

V = "video_id"


def overlapping(rows: DataFrame) -> DataFrame:
    """Rows that end at or after the begin of the next."""
    w = Window.partitionBy(V).orderBy("start")
    return rows.withColumn("next_start", F.lead("start").over(w)).filter("end >= next_start").select(V, "start", "end", "next_start")


def not_tiling(shots: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos whose shots do not begin at 0, end at total - 1 and follow each other without gap."""
    w = Window.partitionBy(V).orderBy("start")
    gap = F.lead("start").over(w) - F.col("end")
    seen = shots.withColumn("gap", gap).groupBy(V).agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count_if(F.col("gap") != 1).alias("gaps"))
    joined = videos.select(V, "total").join(seen, V, "full")
    bad = (F.col("first") != 0) | (F.col("last") != F.col("total") - 1) | (F.col("gaps") > 0) | (F.col("first").isNull() & (F.col("total") > 0)) | F.col("total").isNull()
    return joined.filter(F.coalesce(bad, F.lit(False)))


def gaps_in_ids(rows: DataFrame, item: str) -> DataFrame:
    """Ids that are not 0, 1, 2, ... in order."""
    w = Window.partitionBy(V).orderBy(item)
    return rows.withColumn("expected", F.row_number().over(w) - 1).filter(F.col(item) != F.col("expected")).select(V, item, "expected")


def owned_twice(groups: DataFrame, members: str = "shot_ids") -> DataFrame:
    each = groups.select(V, F.explode(members).alias("member"))
    return each.groupBy(V, "member").count().filter("count > 1")


def not_owned(items: DataFrame, item: str, groups: DataFrame, members: str = "shot_ids") -> DataFrame:
    each = groups.select(V, F.explode(members).alias(item)).distinct()
    return items.select(V, item).join(each, [V, item], "left_anti")


def wrong_range(groups: DataFrame, items: DataFrame, item: str = "shot_id", members: str = "shot_ids", group: str = "scene_id") -> DataFrame:
    """Groups whose range is not that of their members."""
    each = groups.select(V, group, F.explode(members).alias(item)).join(items.select(V, item, F.col("start").alias("s"), F.col("end").alias("e")), [V, item])
    seen = each.groupBy(V, group).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return groups.select(V, group, "start", "end").join(seen, [V, group], "left").filter("s IS NULL OR s <> start OR e <> end")


def assignment_totals(segments: DataFrame, assigned: DataFrame, orphans: DataFrame) -> DataFrame:
    """Videos in which assigned and orphan segments are not all segments with text."""
    text = segments.filter(F.length(F.trim("text")) > 0).groupBy(V).agg(F.count(F.lit(1)).alias("n"))
    a = assigned.groupBy(V).agg(F.count(F.lit(1)).alias("n_assigned"))
    o = orphans.groupBy(V).agg(F.count(F.lit(1)).alias("n_orphans"))
    counts = text.join(a, V, "left").join(o, V, "left").fillna(0, ["n_assigned", "n_orphans"])
    return counts.filter("n <> n_assigned + n_orphans")


def extra_fields(table: DataFrame, forbidden: list[str]) -> list[str]:
    """Columns that a stage's output must not have."""
    return [c for c in table.columns if c in forbidden]


def verify_counts(expected: DataFrame, got: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Rows whose rendered count differs from the plan, or that were not rendered."""
    seen = got.select(*keys, F.col(value).alias("got"))
    return expected.select(*keys, F.col(value).alias("expected")).join(seen, keys, "left").filter(F.col("got").isNull() | (F.col("got") != F.col("expected")))


def summary(rows: DataFrame) -> DataFrame:
    """Number, smallest, largest and mean size of groups (start, end), for a stage's report."""
    n = F.col("end") - F.col("start") + 1
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))
