"""The engine's operators on hand-made cases."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoseg.functions import scalar, score
from chronoseg.operators import checks, graph, intervals, profiles, sequence, sequential, vectors
from chronoseg.operators import kernels as K
from chronoseg.params import Params
from chronoseg.plans import pipelines
from chronoseg.sources import readers, writers

V = "video_id"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cuts_to_shots(spark):
    videos = spark.createDataFrame([(1, 10), (2, 5), (3, 0)], "video_id long, total long")
    cuts = spark.createDataFrame([(1, 0), (1, 4), (1, 4), (1, 10), (1, 99), (1, 7)], "video_id long, cut long")
    shots = sequence.cuts_to_shots(cuts, videos)
    assert rows(shots, V, "shot_id", "start", "end") == [(1, 0, 0, 3), (1, 1, 4, 6), (1, 2, 7, 9), (2, 0, 0, 4)]
    assert checks.not_tiling(shots, videos).count() == 0
    assert checks.not_tiling(shots.filter("shot_id <> 1"), videos).count() == 1
    assert checks.gaps_in_ids(shots, "shot_id").count() == 0
    assert rows(sequence.drop_near_cuts(spark.createDataFrame([(1, c) for c in (5, 6, 7, 9)], "video_id long, cut long")), "cut") == [(5,), (9,)]


def test_empty_inputs(spark):
    frames = spark.createDataFrame([], "video_id long, frame long, score double")
    videos = spark.createDataFrame([], "video_id long, total long")
    segments = spark.createDataFrame([], "video_id long, seg_id long, start_ms long, end_ms long, text string")
    scenes = spark.createDataFrame([], "video_id long, scene_id long, scene_start_ms double, scene_end_ms double")
    for df in (
        pipelines.shots_of(frames, videos), sequence.gaussian_smooth(frames), sequence.stable_runs(frames.withColumn("smooth", F.col("score")), 5), sequence.local_maxima(frames, 1.0), intervals.gap_merge(segments),
        intervals.assign_by_overlap(segments, scenes), intervals.orphans(segments, scenes), sequential.peak_candidates(frames), *pipelines.signal_events(frames),
    ):
        assert df.count() == 0 and df.columns


def test_gap_merge(spark):
    segments = spark.createDataFrame([(1, 0, 100), (1, 600, 700), (1, 650, 660), (1, 1201, 1300), (2, 5, 6)], "video_id long, start_ms long, end_ms long")
    assert rows(intervals.gap_merge(segments), V, "start_ms", "end_ms", "n_merged") == [(1, 0, 700, 3), (1, 1201, 1300, 1), (2, 5, 6, 1)]


def test_overlap_ties_and_touching_ends(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 100.0), (1, 1, 100.0, 200.0)], "video_id long, scene_id long, scene_start_ms double, scene_end_ms double")
    segments = spark.createDataFrame([(1, 1, 50, 150, "tie"), (1, 2, 200, 300, "touches"), (1, 3, 90, 150, "second"), (1, 4, 10, 20, "  "), (1, 5, -50, 0, "before")], "video_id long, seg_id long, start_ms long, end_ms long, text string")
    for width in (7.0, 60_000.0):
        assert rows(intervals.assign_by_overlap(segments, scenes, width), "seg_id", "scene_id") == [(1, 0), (3, 1)]
        assert rows(intervals.orphans(segments, scenes, width), "seg_id") == [(2,), (5,)]
    a, o = intervals.assign_by_overlap(segments, scenes), intervals.orphans(segments, scenes)
    assert checks.assignment_totals(segments, a, o).count() == 0
    assert checks.assignment_totals(segments, a, o.limit(1)).count() == 1


def test_components_join_through_a_third(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "video_id long, shot_id long")
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 3, 5)], "video_id long, src long, dst long")
    want = [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 3)]
    assert rows(graph.components(nodes, edges), "shot_id", "component") == want
    assert rows(graph.components_at_scale(nodes, edges), "shot_id", "component") == want
    runs = graph.contiguous_runs(graph.components(nodes, edges))
    assert rows(runs, "shot_id", "run") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5)]


def test_components_at_scale_reads_its_edges_once(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(40)], "video_id long, shot_id long")
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(1, i, i + 1) for i in range(39)], "video_id long, src long, dst long").withColumn("dst", seen("dst"))
    assert {r["component"] for r in graph.components_at_scale(nodes, edges).collect()} == {0}
    assert made.value == 39


def test_components_at_scale_of_chains_that_meet_at_the_far_end(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(200)] + [(1, 7)], "video_id long, shot_id long")
    edges = spark.createDataFrame([(1, i, i + 2) for i in range(198)] + [(1, 198, 199)], "video_id long, src long, dst long")
    assert rows(graph.components_at_scale(nodes, edges, 12), "shot_id", "component") == [(i, 0) for i in range(200)]


def test_banded_edges_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    at = [(v, s, rng.normal(size=3).tolist()) for v in (1, 2) for s in range(-9, 12) if rng.random() < 0.9] + [(3, 0, [0.0, 0.0, 0.0]), (3, 1, None)]
    size = lambda x: np.linalg.norm(x)
    want = [(v, s, t) for v, s, x in at for w, t, y in at if v == w < 3 and s < t <= s + 4 and np.dot(x, y) / size(x) / size(y) >= 0.3]
    got = vectors.banded_edges(spark.createDataFrame(at, "video_id long, shot_id long, embedding array<double>"), 0.3, 4)
    assert rows(got, V, "src", "dst") == want


def test_cohesion_is_strict(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.7, (1 - 0.49) ** 0.5]), (1, 2, [0.0, 1.0])], "video_id long, shot_id long, embedding array<double>")
    runs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 2, 2)], "video_id long, run long, shot_id long")
    got = {r["run"]: (r["holds"], r["split_at"]) for r in graph.cohesion(runs, v).collect()}
    assert got == {0: (False, 1), 2: (True, None)}
    shots = v.select(V, "shot_id", (F.col("shot_id") * 10).alias("start"), (F.col("shot_id") * 10 + 9).alias("end"), F.lit(0).alias("representative_frame"))
    scenes = graph.scenes(runs, v, shots)
    assert rows(scenes, "scene_id", "start", "end") == [(0, 0, 9), (1, 10, 19), (2, 20, 29)]
    assert graph.scenes(runs, v, shots, recursive=True).count() == 3
    assert checks.owned_twice(scenes).count() == 0 and checks.not_owned(shots, "shot_id", scenes).count() == 0 and checks.wrong_range(scenes, shots).count() == 0


def test_cohesion_of_null_vectors_and_copies(spark):
    at = [(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, [0.6, 0.8]), (1, 3, [1.0, 0.0]), (1, 5, [None, 1.0]), (1, 6, [1.0, 0.0]), (1, 8, [1.0, 0.0])]
    v = spark.createDataFrame(at, "video_id long, shot_id long, embedding array<double>")
    runs = spark.createDataFrame([(1, 0, i) for i in range(4)] + [(1, 5, 5), (1, 5, 6), (1, 8, 8), (1, 9, 9)], "video_id long, run long, shot_id long")
    got = rows(graph.cohesion(runs, v), "run", "mean", "p10", "holds", "split_at")
    assert got == [(0, 0.733333333, 0.6, True, None), (5, None, None, None, None), (8, None, None, True, None), (9, None, None, True, None)]
    assert rows(graph.cohesion(runs, v, 0.8), "run", "split_at")[0] == (0, 2)


def test_rounded_as_the_sql_rounds(spark):
    duckdb = pytest.importorskip("duckdb")
    # ties of the scaled double; of some, the shortest decimal lies on the other side
    xs = [k / 1e6 + 5e-7 for k in range(-2000, 2000)] + [0.0, -0.25, float("nan")]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest($xs::DOUBLE[]) AS x)", params={"xs": xs}).fetchall()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(scalar.rounded("x", 6)).collect()]
    assert np.array_equal(got, want, equal_nan=True) and np.array_equal(K.rounded(np.array(xs), 6), want, equal_nan=True)


@pytest.mark.parametrize("name", ["cohesion_split", "scene_assembly"])
def test_cohesion_queries_are_their_sql_with_a_run_of_one_shot(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from chronoseg.queries import QUERIES

    rng = np.random.default_rng(2)
    at = [(i, [float(x) for x in rng.normal(size=64)], 0) for i in [*range(14), 15, 17, 20, 27, 28, 121]]
    spark.createDataFrame(at, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    f, sql = QUERIES[name]
    want = con.sql(sql)
    assert rows(f(spark, str(tmp_path)), *want.columns) == sorted(want.fetchall())


@pytest.mark.parametrize("odd", ["repeated", "far", "vectors"])
def test_scene_assembly_is_its_sql_on_odd_rows(spark, tmp_path, odd):
    duckdb = pytest.importorskip("duckdb")
    from chronoseg.queries import QUERIES

    rng = np.random.default_rng(3)
    at = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)], 0) for i in [*range(60), 3, 7, 7, *range(40, 45), 100, 100, None]]
    if odd == "repeated":
        at += at[:12]
    elif odd == "far":
        at = [(i and (i - 30 if i < 55 else i + 10**17), e, n) for i, e, n in at]
    else:
        other = {3: None, 12: [0.0] * 64, 17: [None], 20: [], 21: [], 25: [float("nan")] * 64}
        at = [(i, other[i] if i in other else [None, *e[1:]] if i in (31, 32) else e[:32] if i in (36, 38) else e, n) for i, e, n in at]
    spark.createDataFrame(at, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ["scene_assembly"] if odd == "vectors" else ["cohesion_split", "scene_assembly"]:
        f, sql = QUERIES[name]
        want = con.sql(sql)
        assert rows(f(spark, str(tmp_path)), *want.columns) == sorted(want.fetchall())


def test_texts(spark):
    df = spark.createDataFrame([("一个。第二.\nrest",), (".only",), ("none",), ("我们 学习 学习 été ETE the",), (None,)], "t string")
    got = [r[0] for r in df.select(scalar.trim_to_sentence("t")).collect()]
    assert got == ["一个。第二.", ".only", "none", "我们 学习 学习 été ETE the", None]
    words = [r[0] for r in df.select(scalar.keywords("t", 3)).collect()]
    assert words[3] == ["学习", "我们", "été"] and words[4] == []
    said = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("{bad",), ("none",)], "t string")
    assert [r[0] for r in said.select(scalar.json_object("t", "a struct<b:int>")["a"]["b"]).collect()] == [1, None, None]
    names = spark.createDataFrame([("/a/b.c.mp4", "30000/1001"), ("x", "0/0"), (".hid", "25")], "p string, r string")
    assert [tuple(r) for r in names.select(scalar.base_name("p"), F.round(scalar.rational("r"), 3)).collect()] == [("b.c", 29.97), ("x", 24.0), (".hid", 25.0)]


def test_weights_sum_to_one():
    for weights in (score.FRAME_WEIGHTS, score.CHANGE_WEIGHTS, score.EVENT_WEIGHTS, score.CHAPTER_WEIGHTS):
        assert sum(weights.values()) == pytest.approx(1.0)


def test_empty_events_make_one_chapter(spark):
    scenes = spark.createDataFrame([(1, i, 10 * i, 10 * i + 9, "", "", "", "", "", "", "") for i in range(3)], "video_id long, scene_id long, start long, end long, environment string, characters string, event string, story_role string, topic string, visual_summary string, asr_text string")
    events, chapters = pipelines.events_and_chapters(scenes)
    assert events.count() == 3  # no part of the score can be compared: 0.35 * 0.1 + 0.1 * 0.3
    assert rows(chapters, "chapter_id", "start", "end", "title") == [(0, 0, 29, "")]


def test_nearest_and_medoid_ties(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.0, 0.0])], "video_id long, shot_id long, embedding array<double>")
    assert rows(vectors.nearest_to_centroid(v, [V], 2, "shot_id"), "shot_id") == [(0,)]
    assert rows(vectors.medoid(v, [V], 2, "shot_id"), "shot_id") == [(0,)]
    assert rows(vectors.adjacent_similarity(v), "shot_id", "next_similarity")[0] == (0, 0.0)


# sequential kernels


def test_min_segment():
    assert K.min_segment([3, 20, 25, 60, 95], 100, 10) == [20, 60]
    assert K.min_segment([3], 100, 10) == [3]


def test_suppressed_blocks():
    x = np.array([0, 9, 9, 0, 8, 0, 0, 0, 0, 0, 7, 0], float)
    assert K.suppressed_blocks(x, 5, 0) == [1, 4, 10]
    assert K.suppressed_blocks(x, 5, 5) == [1, 10]


def test_greedy_nms():
    frames, scores = np.array([10, 50, 90, 200]), np.array([1.0, 3.0, 3.0, 2.0])
    assert K.greedy_nms(frames, scores, 72, 200) == [1, 3]
    assert K.greedy_nms(frames, scores, 30, 2) == [1, 2]


def test_find_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 1.9, 2.1, 0], float)
    assert K.find_peaks(x, 1, 0, 0) == [1, 4, 7, 9]
    assert K.find_peaks(x, 3, 0, 0) == [1, 4, 9]
    assert K.find_peaks(x, 1, 0.5, 1.5) == [4, 9]


def test_peak_zones():
    x = np.arange(10, dtype=float)
    assert K.peak_zones(x, [], 3, 3) == [(0, 9, 0.0)]
    assert K.peak_zones(x, [1, 6], 3, 3) == [(0, 1, 0.0), (1, 6, 6.0), (6, 9, 9.0)]
    assert K.peak_zones(x, [4, 8], 3, 3) == [(0, 4, 4.0), (4, 9, 8.0)]


def test_leaders():
    a, b, c = [1.0, 0.0], [0.97, 0.243], [0.88, 0.475]
    assert K.leaders(np.array([a, b, c]), 0.95) == [0, 0, 2]
    assert K.leaders(np.array([[0.0, 0.0], [0.0, 0.0]]), 0.95) == [0, 1]


def test_content_dedup_keeps_slots():
    x = np.array([[0.0], [1.0], [100.0], [2.0]])
    assert K.content_dedup(x, np.array([1.0, 2.0, 1.0, 2.0]), 50) == [1, 2]


def piece(i, start, end, vector):
    return K.Piece(i, i, start, end, np.array(vector, float))


def test_absorb_single_prefers_left_on_ties():
    ps = [piece(0, 0, 99, [1, 0]), piece(1, 100, 109, [0, 1]), piece(2, 110, 209, [1, 0])]
    assert [(p.first, p.last) for p in K.absorb_fragments(ps, lambda _: 50, 50)] == [(0, 1), (2, 2)]


def test_absorb_run_with_enough_frames_goes_together():
    ps = [piece(0, 0, 99, [1, 0]), piece(1, 100, 139, [0.6, 0.8]), piece(2, 140, 179, [0.1, 0.99]), piece(3, 180, 299, [0, 1])]
    assert [(p.first, p.last) for p in K.absorb_fragments(ps, lambda _: 50, 50)] == [(0, 0), (1, 3)]


def test_absorb_all_short_and_alone():
    ps = [piece(0, 0, 9, [1, 0]), piece(1, 10, 19, [0, 1])]
    assert [(p.first, p.last) for p in K.absorb_fragments(ps, lambda _: 50, 50)] == [(0, 0), (1, 1)]
    assert K.absorb_fragments(ps[:1], lambda _: 50, 50) == ps[:1]


vectors_ = st.lists(st.sampled_from([(1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (0.8, 0.6)]), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(vectors_, st.lists(st.integers(1, 80), min_size=12, max_size=12), st.integers(1, 60))
def test_merges_lose_no_shot(vs, sizes, least):
    ps, at = [], 0
    for i, v in enumerate(vs):
        ps.append(piece(i, at, at + sizes[i] - 1, v))
        at += sizes[i]
    x = np.array(vs)
    for out in (K.absorb_fragments(ps, lambda _: least, least), K.short_merge(ps, lambda i, j: float(x[i] @ x[j]), least, 0.3)):
        assert [i for p in out for i in range(p.first, p.last + 1)] == list(range(len(vs)))
        assert out[0].start == 0 and out[-1].end == at - 1
        assert all(a.end + 1 == b.start for a, b in zip(out, out[1:], strict=False))


def test_short_merge_needs_similarity():
    ps = [piece(0, 0, 99, [1, 0]), piece(1, 100, 109, [0, 1]), piece(2, 110, 209, [0.6, 0.8])]
    x = np.array([p.total for p in ps])
    edge = lambda i, j: float(x[i] @ x[j])
    assert [(p.first, p.last) for p in K.short_merge(ps, edge, 50, 0.3)] == [(0, 0), (1, 2)]
    assert len(K.short_merge(ps, edge, 50, 0.9)) == 3


def test_hac_shortest_and_pairs():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert K.average_linkage(s, 0.25) == [0, 0, 1]
    assert K.average_linkage(s, 0.1) == [0, 0, 0]
    assert K.shortest_first([0, 50, 60, 200], 40) == [0, 60, 200]
    assert K.best_pair_merge(np.array([[1, 0], [0.9, 0.1], [0, 1]], float), 0.5) == [(0, 1), (2, 2)]


def test_density_frames():
    assert K.density_frames(np.eye(2)) == ([0, 1], 1)
    assert K.density_frames(np.eye(5)) == ([2], 1)
    x = np.array([[1, 0]] * 4 + [[0, 1]] * 3 + [[-1, 0]], float)
    assert K.density_frames(x) == ([0, 4], 2)
    assert K.density_frames(np.eye(7))[1] == 1


def test_ema_keeps_the_last_scene():
    x = np.array([[1, 0], [1, 0.1], [0, 1], [0, 1]], float)
    assert K.ema_boundaries(x, 0.7, 0.9) == [False, False, True, True]
    assert K.ema_boundaries(x, 0.7, 0.9, reset=True) == [False, False, True, False]


def test_short_sequences_smooth(spark):
    frames = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 2.0)], "video_id long, frame long, score double")
    got = {(r.video_id, r.frame): r.smooth for r in sequence.gaussian_smooth(frames).collect()}
    kernel = sequence.gaussian_kernel(3.0)
    assert len(kernel) == 25 and got[1, 0] == pytest.approx(5.0)
    want = sum(w * [1, 2, 2, 1][(o - 12) % 4] for o, w in enumerate(kernel))
    assert got[2, 0] == pytest.approx(want)


def test_stable_run_fallback(spark):
    frames = spark.createDataFrame([(1, i, 3.0) for i in range(8)] + [(2, 0, 1.0)], "video_id long, frame long, smooth double")
    assert rows(sequence.stable_runs(frames, 5), V, "start", "end", "fallback") == [(1, 0, 2, True), (2, 0, 0, True)]


def test_readers_and_writers(spark, tmp_path):
    doc = {"video": "a", "total_frames": 0, "duration": 2.0, "fps": 0.0, "width": 4, "height": 3, "cuts": [3, 7]}
    (tmp_path / "raw.json").write_text(json.dumps(doc, indent=1))
    docs = readers.read_document(spark, str(tmp_path / "raw.json"), readers.RAW_CUTS)
    assert rows(readers.cuts_of(docs), "cut") == [(3,), (7,)]
    assert rows(readers.videos(docs), "total", "fps") == [(48, 24.0)]
    skeleton = {"video": "a", "shots": [{"id": 0, "range": {"start": 0, "end": 5}}, {"id": 1, "range": {"start": 9, "end": 5}}, {"id": -1, "range": {"start": 0, "end": 5}}]}
    (tmp_path / "sk.json").write_text(json.dumps(skeleton))
    assert rows(readers.shots_of(readers.read_document(spark, str(tmp_path / "sk.json"), readers.SKELETON)), "shot_id") == [(0,)]
    (tmp_path / "log.txt").write_text("frame: 1\nlavfi.scd.time: 2.54\nscd.time:7\n")
    assert rows(readers.read_cut_log(spark, str(tmp_path / "log.txt")), "seconds") == [(2.54,), (7.0,)]
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    assert [r.embedding for r in readers.read_arrays(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    np.savez(tmp_path / "y.npz", a=np.ones((2, 2)), b=np.arange(3))
    assert sorted((r.name, r.row, r.embedding) for r in readers.read_arrays(spark, str(tmp_path / "y.npz")).collect()) == [("a", 0, [1, 1]), ("a", 1, [1, 1]), ("b", 0, [0]), ("b", 1, [1]), ("b", 2, [2])]
    assert [r.embedding for r in readers.read_arrays(spark, str(tmp_path / "none.npy"), missing_zero=True).collect()] == [[0]]
    motion = np.zeros(2, np.dtype(readers.MOTION))
    motion["frame"], motion["mean"] = [4, 5], [0.5, 1.5]
    (tmp_path / "m.bin").write_bytes(motion.tobytes())
    assert rows(readers.read_motion(spark, str(tmp_path / "m.bin")), "frame", "mean") == [(4, 0.5), (5, 1.5)]
    (tmp_path / "v.raw").write_bytes(bytes(range(12)) + b"\xff" * 5)
    frames = readers.read_raw_frames(spark, str(tmp_path / "v.raw"), 2, 2)
    assert [bytes(r.pixels) for r in frames.orderBy("frame").collect()] == [bytes(range(12)), b"\xff" * 5 + b"\0" * 7]
    assert [r.seconds for r in readers.timed(frames, 2.0).orderBy("frame").collect()] == [0.0, 0.5]
    (tmp_path / "w.raw").write_bytes(bytes(range(48)))
    cropped = readers.scaled_crop(readers.read_raw_frames(spark, str(tmp_path / "w.raw"), 8, 2), 8, 2, 1).collect()
    assert [bytes(r.pixels) for r in cropped] == [bytes(range(48))[3 * (8 + 4) :][:3]]
    (tmp_path / "frame_12.png").write_bytes(b"x")
    assert rows(readers.read_images(spark, str(tmp_path)), "frame") == [(12,)]
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "sk.json")).endswith("sk.json")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path / "no"))
    curve = spark.createDataFrame([(1, 0, 9.0), (1, 1, 2.0), (1, 2, 4.0)], "video_id long, frame long, score double")
    writers.write_curve(curve, str(tmp_path / "curve"), 10.0)
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "curve"))
    assert rows(back, "frame", "normalized_score") == [(0, 2.25), (1, 0.5), (2, 1.0)]
    writers.write_table(curve, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    videos = spark.createDataFrame([(1, 10)], "video_id long, total long")
    shots = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9)], "video_id long, shot_id long, start long, end long")
    writers.write_documents(writers.skeleton(videos, shots=shots), str(tmp_path / "docs"))
    assert json.loads(next((tmp_path / "docs").glob("part*")).read_text())["shots"][1] == {"id": 1, "range": {"start": 5, "end": 9}}


def test_pixels(spark):
    flat = bytes([100] * 27)
    df = spark.createDataFrame([("p", 0, bytearray(flat))], "path string, frame long, pixels binary")
    r = readers.pixel_stats(df, 3, 3).collect()[0]
    assert r.brightness == pytest.approx(100 / 255) and r.sharpness == pytest.approx(0, abs=1e-9) and sum(r.histogram) == 9
    assert spark.range(1).select(readers.histogram_distance(F.array(F.lit(4), F.lit(0)), F.array(F.lit(0), F.lit(4)))).first()[0] == 4.0


def test_segment_text_reaches_scenes(spark):
    scenes = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 10, 19)], "video_id long, scene_id long, start long, end long")
    segments = spark.createDataFrame([(1, 1, 0, 300, "a"), (1, 2, 900, 1200, "c"), (1, 3, 300, 600, "b")], "video_id long, seg_id long, start_ms long, end_ms long, text string")
    spoken, lost = pipelines.spoken_scenes(scenes, segments, Params(fps=10.0))
    assert rows(spoken, "scene_id", "asr_text") == [(0, "a。b"), (1, "c")] and lost.count() == 0
    assert rows(profiles.joined_texts(spark.createDataFrame([(1, 1, "x。"), (1, 2, "y。")], "g long, o long, t string"), ["g"], "t", "o"), "t") == [("x。y。",)]


def test_streams_agree_with_batches(spark, tmp_path):
    import datetime

    from chronoseg.streaming import stateful

    rng = np.random.default_rng(3)
    data = [(v, f, float(rng.integers(0, 90))) for f in range(12) for v in (1, 2)]
    frames = spark.createDataFrame(data, "video_id long, frame long, score double").withColumn("embedding", F.array(F.cos("score"), F.sin("score")))
    for i in range(3):
        frames.filter(F.floor(F.col("frame") / 4) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    t0 = datetime.datetime(2024, 1, 1)
    ms = lambda x: t0 + datetime.timedelta(milliseconds=x)
    spark.createDataFrame([(1, ms(0), ms(100)), (1, ms(600), ms(700)), (1, ms(1201), ms(1300)), (1, ms(60_000), ms(60_001))], "video_id long, begin timestamp, end timestamp").coalesce(1).write.parquet(str(tmp_path / "speech/0"))

    def run(name, schema, op, folder="in"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder / "*"))
        q = op(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = rows(run("cuts", frames.schema, lambda s: stateful.cut_scores(s.select(V, "frame", "score"))), V, "frame", "cut_score")
    assert got == rows(sequence.cut_scores(frames), V, "frame", "cut_score")
    got = rows(run("ema", frames.schema, lambda s: stateful.ema_boundaries(s.select(V, "frame", "embedding"))), V, "frame", "boundary")
    assert got == rows(sequential.ema_boundaries(frames.withColumn("shot_id", F.col("frame"))), V, "shot_id", "boundary")
    ring = [r for r in run("ring", frames.schema, lambda s: stateful.ring_buffer(s.select(V, "frame", "score"), 5)).collect() if r.frame == 11]
    assert [r.frames for r in ring] == [[7, 8, 9, 10, 11]] * 2
    got = rows(run("speech", spark.read.parquet(str(tmp_path / "speech/0")).schema, stateful.speech_sessions, "speech"), "n_merged")
    assert got == [(1,), (2,)]
