"""Reading the documents, logs, curves, records and arrays that stages exchange."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rational

RAW_CUTS = "video string, total_frames int, duration double, fps double, width int, height int, cuts array<int>"
SHOT = "struct<id:int,range:struct<start:int,end:int>,representative_frame:int,key_frames:array<int>,visual_cluster:struct<next_similarity:double>,text_cluster:struct<next_similarity:double>,text_valid:boolean,asr_contextual:string>"
PROFILE = "struct<environment:string,characters:string,actions:string,objects:string,event:string,story_role:string,topic:string,visual_summary:string,_raw:string>"
SCENE = f"struct<id:int,shot_ids:array<int>,range:struct<start:int,end:int>,representative_frame:int,asr_text:string,key_frames:array<int>,profile:{PROFILE}>"
EVENT = "struct<id:int,scene_ids:array<int>,range:struct<start:int,end:int>>"
CHAPTER = "struct<id:int,event_ids:array<int>,scene_ids:array<int>,range:struct<start:int,end:int>,title:string>"
SKELETON = f"video string, fps double, width int, height int, total_frames int, duration double, shots array<{SHOT}>, scenes array<{SCENE}>, events array<{EVENT}>, chapters array<{CHAPTER}>"
TIMELINE = "step string, n_segments int, results array<struct<start_ms:int,end_ms:int,text:string,lang:string>>"
CURVE = "frame int, timestamp_sec double, raw_score double, normalized_score double"
CURVE_DOCUMENT = "video string, total_frames int, fps double, stride int, method string, weights struct<hist:double,resize:double>, curve array<double>"
#: Bytes of a motion record and its little-endian layout: frame, two counts, two means, time.
MOTION_BYTES, MOTION = 20, [("frame", "<u4"), ("n_vectors", "<u2"), ("n_zero", "<u2"), ("mean", "<f4"), ("most", "<f4"), ("pts", "<u4")]


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file; malformed ones have null fields."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, in whatever store they are."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def videos(documents: DataFrame) -> DataFrame:
    """Metadata with fallbacks: a missing frame count from duration at 24 frames a second, a missing rate from both."""
    fps = F.coalesce(F.nullif("fps", F.lit(0.0)), F.nullif(F.try_divide(F.col("total_frames").cast("double"), F.nullif("duration", F.lit(0.0))), F.lit(0.0)), F.lit(24.0))
    total = F.coalesce(F.nullif("total_frames", F.lit(0)), (F.col("duration") * 24).cast("int"))
    return documents.select(F.col("video").alias("video_id"), "width", "height", total.alias("total"), "duration", fps.alias("fps"))


def probed(rows: DataFrame) -> DataFrame:
    """video_id, rate (a/b), nb_frames, duration: the same from a probe's raw strings."""
    duration = F.col("duration").try_cast("double")
    total = F.coalesce(F.nullif(F.col("nb_frames").try_cast("int"), F.lit(0)), (duration * 24).cast("int"))
    return rows.select("video_id", rational("rate").alias("fps"), duration.alias("duration"), total.alias("total"))


def cuts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("video").alias("video_id"), F.explode("cuts").alias("cut"))


def shots_of(documents: DataFrame) -> DataFrame:
    """The valid shots of skeleton documents: none with a negative id or start or an end before the start."""
    shots = documents.select(F.col("video").alias("video_id"), F.explode("shots").alias("s"))
    rows = shots.select("video_id", F.col("s.id").alias("shot_id"), F.col("s.range.start").alias("start"), F.col("s.range.end").alias("end"), "s.representative_frame", "s.key_frames")
    return rows.filter("shot_id >= 0 AND start >= 0 AND end >= start")


def segments_of(documents: DataFrame, video_id: str) -> DataFrame:
    each = documents.select(F.posexplode("results").alias("seg_id", "r"))
    return each.select(F.lit(video_id).alias("video_id"), "seg_id", "r.start_ms", "r.end_ms", "r.text", "r.lang")


def read_cut_log(spark: SparkSession, path: str) -> DataFrame:
    """The cut times in a detector's log, and the file of each."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"scd\.time:\s*([\d.]+)", 1).alias("t"))
    return lines.filter("t <> ''").select("path", F.col("t").try_cast("double").alias("seconds"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVE).option("header", True).csv(path)


def curve_frames(documents: DataFrame) -> DataFrame:
    """A sampled curve document as frames: position times stride."""
    return documents.select(F.col("video").alias("video_id"), "stride", F.posexplode("curve").alias("i", "score")).select("video_id", (F.col("i") * F.col("stride")).cast("long").alias("frame"), "score")


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-size motion records; the files are splittable."""
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, MOTION_BYTES).map(lambda b: (bytearray(b),)), "raw binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = np.frombuffer(b"".join(bytes(b) for b in df["raw"]), np.dtype(MOTION))
            yield pd.DataFrame({name: x[name].astype("f8" if kind == "<f4" else "i8") for name, kind in MOTION})

    return raw.mapInPandas(decode, "frame long, n_vectors long, n_zero long, mean double, most double, pts long")


def motion_stats(vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """Per video and frame the number of motion vectors (x, y), of those shorter than 1, and the mean and largest length."""
    size = F.hypot(F.col("x") / scale, F.col("y") / scale)
    rows = vectors.withColumn("m", size)
    return rows.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.col("m") < 1).alias("n_zero"), F.avg("m").alias("mean"), F.max("m").alias("most"))


def read_arrays(spark: SparkSession, path: str, missing_zero: bool = False) -> DataFrame:
    """Rows of .npy files, and of each array of .npz files: path, name (of the array, empty for .npy), row, embedding.
    missing_zero: where no file matches, one row of a single 0."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if missing_zero and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([(path, "", 0, [0.0])], _ARRAYS)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at, content in zip(df["path"], df["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                for name, x in held.items() if hasattr(held, "items") else [("", held)]:
                    x = np.atleast_1d(x)
                    x = x.reshape(len(x), -1).astype("f4")
                    for i in range(0, len(x), 1000):
                        yield pd.DataFrame({"path": at, "name": name, "row": range(i, min(i + 1000, len(x))), "embedding": list(x[i : i + 1000])})

    return files.mapInPandas(decode, _ARRAYS)


_ARRAYS = "path string, name string, row long, embedding array<float>"


def timed(frames: DataFrame, fps: float) -> DataFrame:
    """Decoded frames with their time in seconds."""
    return frames.withColumn("seconds", F.col("frame") / fps)


def scaled_crop(frames: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """RGB frames scaled by the nearest pixel so that the short side is `size`, and their centre of size x size."""
    short = min(width, height)
    left, top = (width - short) // 2, (height - short) // 2
    at = (np.arange(size) * 2 + 1) * short // (2 * size)

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            cut = [np.frombuffer(p, np.uint8).reshape(height, width, 3)[top + at][:, left + at].tobytes() for p in df["pixels"]]
            yield df.assign(pixels=cut)

    return frames.select("path", "frame", "pixels").mapInPandas(crop, "path string, frame long, pixels binary")


def read_raw_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 3) -> DataFrame:
    """Frames of fixed-size raw video files; a short last frame is padded with zeros."""
    size = width * height * channels
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at, content in zip(df["path"], df["content"], strict=True):
                for i in range(0, len(content), size):
                    part = bytes(content[i : i + size])
                    yield pd.DataFrame({"path": [at], "frame": [i // size], "pixels": [part.ljust(size, b"\0")]})

    return files.mapInPandas(cut, "path string, frame long, pixels binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images named frame_<number>.png: frame, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").load(path)
    return files.select(F.regexp_extract("path", r"frame_(\d+)\.png$", 1).cast("long").alias("frame"), "content")


def selected_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames that are wanted, on an explicit key."""
    return frames.join(wanted.select("video_id", "frame").distinct(), ["video_id", "frame"], "left_semi")


def mono(samples: DataFrame, channels: str = "channels") -> DataFrame:
    """The mean of the channels of each sample."""
    mean = F.aggregate(F.col(channels), F.lit(0.0), lambda a, x: a + x) / F.size(channels)
    return samples.withColumn("sample", mean)


def pixel_stats(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Luma mean (0 to 1), population variance of the Laplacian and a 256-bin histogram of each frame of RGB pixels."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for pixels in df["pixels"]:
                x = np.frombuffer(pixels, np.uint8).reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])
                lap = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
                rows.append((x.mean() / 255, lap.var() if lap.size else 0.0, np.histogram(x, 256, (0, 256))[0].astype("i8")))
            yield pd.DataFrame({"path": df["path"], "frame": df["frame"], "brightness": [r[0] for r in rows], "sharpness": [r[1] for r in rows], "histogram": [r[2] for r in rows]})

    return frames.select("path", "frame", "pixels").mapInPandas(stats, "path string, frame long, brightness double, sharpness double, histogram array<long>")


def histogram_distance(a, b):
    """Half the chi-squared distance of two histograms, as a column."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    terms = F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) * 0.5
