"""Vectors: banded and adjacent similarity, means, nearest to the centroid, medoids, similarity of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import cosine, dot, mean_absolute, mean_vector, sum_vector, unit

V = "video_id"


def banded_edges(vectors: DataFrame, least: float, band: int = 30, digits: int | None = None) -> DataFrame:
    """Pairs src < dst <= src + band of a video with cosine of at least `least`. vectors: video_id, shot_id, embedding.
    Ids are cut into blocks of `band`, and each vector is sent to its block and the next, so the join is an equi-join on
    video and block."""
    block = lambda c: F.floor(F.col(c) / band)
    a = vectors.select(V, F.col("shot_id").alias("src"), unit("embedding").alias("_a"))
    near = a.withColumn("_block", F.explode(F.array(block("src"), block("src") + 1)))
    b = vectors.select(V, F.col("shot_id").alias("dst"), unit("embedding").alias("_b")).withColumn("_block", block("dst"))
    sim = dot("_a", "_b")
    within = near.join(b, [V, "_block"]).filter((F.col("dst") > F.col("src")) & (F.col("dst") <= F.col("src") + band))
    pairs = within.withColumn("sim", F.round(sim, digits) if digits is not None else sim)
    return pairs.filter(F.col("sim") >= least).select(V, "src", "dst", "sim")


def adjacent_similarity(vectors: DataFrame, digits: int = 4, clamp: bool = True, valid: str | None = None) -> DataFrame:
    """Cosine to the next shot, rounded; null on the last one. clamp: not below 0. valid: 0 unless both rows have it."""
    w = Window.partitionBy(V).orderBy("shot_id")
    nxt = F.lead("embedding").over(w)
    sim = cosine(F.col("embedding"), nxt)
    sim = F.greatest(sim, F.lit(0.0)) if clamp else sim
    if valid:
        sim = F.when(F.col(valid) & F.lead(valid).over(w), sim).otherwise(0.0)
    return vectors.withColumn("next_similarity", F.when(nxt.isNotNull(), F.round(sim, digits)))


def frame_difference(vectors: DataFrame) -> DataFrame:
    """Mean absolute difference of each frame's vector to the one before; 0 on the first."""
    w = Window.partitionBy(V).orderBy("frame")
    before = F.lag("embedding").over(w)
    return vectors.withColumn("mafd", F.when(before.isNull(), 0.0).otherwise(mean_absolute(F.col("embedding"), before)))


def group_mean(vectors: DataFrame, by: list[str], dim: int) -> DataFrame:
    """The mean of unit vectors of each group, and the group's size."""
    rows = vectors.withColumn("_u", unit("embedding"))
    return rows.groupBy(*by).agg(mean_vector("_u", dim).alias("embedding"), F.count(F.lit(1)).alias("n"))


def nearest_to_centroid(vectors: DataFrame, by: list[str], dim: int, item: str, digits: int = 9) -> DataFrame:
    """The item of each group with the largest cosine to the group's mean of unit vectors; the first of equals."""
    rows = vectors.withColumn("_u", unit("embedding"))
    center = rows.groupBy(*by).agg(mean_vector("_u", dim).alias("_c"))
    scored = rows.join(center, by).withColumn("sim", F.round(cosine("_u", "_c"), digits))
    best = scored.groupBy(*by).agg(F.max(F.struct("sim", (-F.col(item)).alias("i"))).alias("best"))
    return best.select(*by, (-F.col("best.i")).alias(item), F.col("best.sim").alias("sim"))


def medoid(vectors: DataFrame, by: list[str], dim: int, item: str, digits: int = 9) -> DataFrame:
    """The item with the least sum of 1 - cosine to all of its group, the first of equals, and its score 1 - sum / n. The
    sum is n less the product with the sum of the vectors, so no pairs are made."""
    rows = vectors.withColumn("_u", unit("embedding"))
    total = rows.groupBy(*by).agg(sum_vector("_u", dim).alias("_s"), F.count(F.lit(1)).alias("n"))
    scored = rows.join(total, by).withColumn("cost", F.round(F.col("n") - dot("_u", "_s"), digits))
    best = scored.groupBy(*by).agg(F.min(F.struct("cost", F.col(item).alias("i"), "n")).alias("best"))
    return best.select(*by, F.col("best.i").alias(item), F.round(1 - F.col("best.cost") / F.col("best.n"), digits).alias("score"))


def set_similarity(vectors: DataFrame, members: DataFrame, pairs: DataFrame, dim: int, digits: int = 9) -> DataFrame:
    """Mean cosine between the members of two groups, for pairs (video_id, a, b) of group ids; 0 where either is empty.
    As the mean of products of unit vectors is the product of their means, each group is summed once."""
    means = members.join(vectors.withColumn("_u", unit("embedding")), [V, "shot_id"]).groupBy(V, "group_id").agg(mean_vector("_u", dim).alias("_m"))
    a = means.select(V, F.col("group_id").alias("a"), F.col("_m").alias("_ma"))
    b = means.select(V, F.col("group_id").alias("b"), F.col("_m").alias("_mb"))
    return pairs.join(a, [V, "a"], "left").join(b, [V, "b"], "left").select(V, "a", "b", F.round(F.coalesce(dot("_ma", "_mb"), F.lit(0.0)), digits).alias("sim"))
