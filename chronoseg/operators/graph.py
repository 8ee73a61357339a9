"""Graphs of shots: components, scenes of consecutive shots, and cohesion."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import unit
from .kernels import run_cohesion
from .sequence import consecutive_runs

V = "video_id"
#: Shots in which the runs begin that one task judges together.
RUNS_BLOCK = 1000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's component: its smallest node, by union-find in one group for each video."""
    rows = nodes.select(V, F.col("shot_id").alias("a"), F.col("shot_id").alias("b")).unionByName(edges.select(V, F.col("src").alias("a"), F.col("dst").alias("b")))

    def find(df: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(df["a"], df["b"], strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        ids = sorted(root)
        return pd.DataFrame({V: df[V].iloc[0], "shot_id": ids, "component": [top(i) for i in ids]})

    return rows.groupBy(V).applyInPandas(find, f"{V} long, shot_id long, component long")


def components_at_scale(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """The same by rounds of joins, for videos of more edges than one task holds: each node, and the node that it points to,
    takes the smallest label next to it, then the label of its label, so long chains take few rounds too. The edges, once, and
    the rounds are written to the shared folder, which cuts their lineage; only the last round stays."""
    spark = nodes.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{at.rstrip('/')}/chronoseg-components-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def dropped(path: str) -> None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    links, links_path = written(edges.select(V, "src", "dst"))
    both = links.select(V, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(V, F.col("dst").alias("a"), F.col("src").alias("b")))
    labels = nodes.select(V, F.col("shot_id").alias("a"), F.col("shot_id").alias("label"))
    before = None
    for _ in range(most_rounds):
        near = both.join(labels.select(V, F.col("a").alias("b"), F.col("label").alias("l")), [V, "b"]).groupBy(V, "a").agg(F.min("l").alias("l"))
        held = labels.join(near, [V, "a"], "left").select(V, "a", "label", F.least("label", F.coalesce("l", "label")).alias("l"))
        hooks = held.filter("l < label").select(V, F.col("label").alias("a"), F.expr("nullif(label, label)").alias("label"), "l")
        new = held.unionByName(hooks).groupBy(V, "a").agg(F.max("label").alias("label"), F.min("l").alias("l"))
        jump = new.select(V, F.col("a").alias("l"), F.col("l").alias("ll"))
        labels, path = written(new.join(jump, [V, "l"]).select(V, "a", F.least("l", "ll").alias("new"), "label"))
        if before:
            dropped(before)
        before = path
        settled = not labels.filter("new <> label").take(1)
        labels = labels.select(V, "a", F.col("new").alias("label"))
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    dropped(links_path)
    return labels.select(V, F.col("a").alias("shot_id"), F.col("label").alias("component"))


def contiguous_runs(components_: DataFrame) -> DataFrame:
    """Splits components where shot ids are not consecutive: video_id, shot_id, component, run (first shot of the run)."""
    runs = consecutive_runs(components_, "component", "shot_id")
    first = Window.partitionBy(V, "component", "run")
    return runs.withColumn("run", F.min("shot_id").over(first))


def cohesion(runs: DataFrame, vectors: DataFrame, least_mean: float = 0.70, least_p10: float = 0.55, digits: int = 9) -> DataFrame:
    """Mean and 10th percentile of the similarities of all pairs of a run, whether the run holds together (both strictly
    above; one shot always does; null if no pair has a similarity), and the later shot of its weakest pair, the first of
    equals with a similarity below 1. A shot that a run repeats is one shot; if it has several vectors, each counts. A group
    holds the runs that begin within a block of shots of a video."""
    u = F.when(~F.exists("u", lambda x: x.isNull()), F.col("u")).alias("u")
    known = vectors.select(V, "shot_id", unit("embedding").alias("u")).select(V, "shot_id", u, F.lit(True).alias("known"))
    rows = runs.select(V, "run", "shot_id").distinct().join(known, [V, "shot_id"], "left")

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["run", "shot_id"])
        begins = np.flatnonzero(~df["run"].duplicated().to_numpy())
        run, ids, known, u, out = df["run"].to_numpy(), df["shot_id"].to_numpy(), df["known"].notna().to_numpy(), df["u"].to_numpy(), []
        for a, b in zip(begins, [*begins[1:], len(df)], strict=True):
            at = a + np.flatnonzero(known[a:b])
            found = run_cohesion(ids[at], list(u[at]), digits)
            mean, p10, later = found or (None, None, None)
            holds = not (mean <= least_mean or p10 <= least_p10) if found else None if len(set(ids[at])) > 1 else True
            out.append((df[V].iloc[0], run[a], mean, p10, holds, None if holds is not False else later))
        return pd.DataFrame(out, columns=[V, "run", "mean", "p10", "holds", "split_at"], dtype=object)

    return rows.groupBy(V, F.floor(F.col("run") / RUNS_BLOCK)).applyInPandas(judge, f"{V} long, run long, mean double, p10 double, holds boolean, split_at long")


def scenes(runs: DataFrame, vectors: DataFrame, shots: DataFrame, least_mean: float = 0.70, least_p10: float = 0.55, recursive: bool = False, most_rounds: int = 20) -> DataFrame:
    """Scenes from runs of shots: a run that does not hold together is split once, at its weakest pair (recursive: until
    all parts hold). Scenes are numbered by their first shot; range from their shots, representative frame of the first."""
    parts = runs.select(V, "run", "shot_id")
    for _ in range(most_rounds if recursive else 1):
        checked = cohesion(parts, vectors, least_mean, least_p10).filter("split_at IS NOT NULL")
        if recursive and not checked.take(1):
            break
        parts = parts.join(checked.select(V, "run", "split_at"), [V, "run"], "left").select(V, F.when(F.col("shot_id") >= F.col("split_at"), F.col("split_at")).otherwise(F.col("run")).alias("run"), "shot_id")
    rows = parts.join(shots, [V, "shot_id"])
    out = rows.groupBy(V, "run").agg(F.sort_array(F.collect_list("shot_id")).alias("shot_ids"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("representative_frame", "shot_id").alias("representative_frame"))
    return out.withColumn("scene_id", F.row_number().over(Window.partitionBy(V).orderBy("run")) - 1).drop("run")


