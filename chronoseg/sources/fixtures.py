"""The test tables as sequences, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 10.0
#: Vectors of a video of the embeddings table.
VIDEO = 100


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    rows = _read(spark, d, "events").withColumn("video_id", F.col("user_id") % 8)
    return rows.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("score"), "event_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


def videos(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").groupBy((F.col("user_id") % 8).alias("video_id")).agg(F.count(F.lit(1)).alias("total"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.expr(f"vec_id div {VIDEO}").alias("video_id"), F.col("vec_id").alias("shot_id"), F.col("vec_id").alias("frame"), "embedding", F.col("label").cast("long").alias("label"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).filter("event_type = 'view'")
    text = F.when(F.col("k") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit("w"), F.col("k").cast("string")))
    return f.select("video_id", F.col("event_id").alias("seg_id"), (F.col("frame") * 100).alias("start_ms"), (F.col("frame") * 100 + F.floor(F.col("score") * 40).cast("long")).alias("end_ms"), text.alias("text"))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """A scene of eight frames for each event, with its profile."""
    f = frames(spark, d)
    named = lambda p, m: F.concat(F.lit(p), (F.col("k") % m).cast("string"))
    return f.select(
        "video_id", F.col("frame").alias("scene_id"), (F.col("frame") * 8).alias("start"), (F.col("frame") * 8 + 7).alias("end"),
        F.col("event_type").alias("environment"), named("hero", 3).alias("characters"), named("act", 4).alias("event"), named("role", 2).alias("story_role"),
        F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.element_at(F.array(*[F.lit(x) for x in TOPICS]), F.col("k") % 5 + 1)).alias("topic"),
        F.concat_ws(" ", F.col("event_type"), named("act", 4)).alias("visual_summary"),
        F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.concat_ws(" ", F.lit("said"), F.col("event_type"))).alias("asr_text"),
    )


TOPICS = ["harbour", "market", "storm", "journey", "feast"]

#: The same views for DuckDB, to stand after WITH.
FRAMES = """fr AS (SELECT user_id % 8 AS video_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame,
  value AS score, event_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
videos AS (SELECT user_id % 8 AS video_id, count(*) AS total FROM events GROUP BY 1)"""
VECTORS = f"""vec AS (SELECT vec_id // {VIDEO} AS video_id, vec_id AS shot_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
un AS (SELECT video_id, shot_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM vec)"""
SEGMENTS = """seg AS (SELECT video_id, event_id AS seg_id, frame * 100 AS start_ms, frame * 100 + CAST(floor(score * 40) AS BIGINT) AS end_ms,
  CASE WHEN k % 10 = 0 THEN '  ' ELSE 'w' || k END AS text FROM fr WHERE event_type = 'view')"""
SCENES = """sc AS (SELECT video_id, frame AS scene_id, frame * 8 AS "start", frame * 8 + 7 AS "end", event_type AS environment, 'hero' || (k % 3) AS characters,
  'act' || (k % 4) AS event, 'role' || (k % 2) AS story_role, CASE WHEN k % 11 = 0 THEN '' ELSE ['harbour', 'market', 'storm', 'journey', 'feast'][k % 5 + 1] END AS topic,
  event_type || ' act' || (k % 4) AS visual_summary, CASE WHEN k % 7 = 0 THEN '' ELSE 'said ' || event_type END AS asr_text FROM fr)"""
