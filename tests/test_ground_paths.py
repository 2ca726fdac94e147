import pytest
from pyspark.sql import functions as F

from reelyard.operators import decks, ground_paths, manifest


def test_small_stratum_takes_its_part_of_the_plan(spark):
    plan = spark.createDataFrame([("one", 0, 5), ("two", 1, 3)], "value string, pos int, count long")
    small = spark.createDataFrame([("one", 4)], "value string, count long")
    assert sorted((r["value"], r["count"]) for r in decks.small_stratum_plan(plan, small).collect()) == [("one", 1), ("two", 3)]
    with pytest.raises(Exception, match="too many rows"):
        decks.small_stratum_plan(plan, small.withColumn("count", F.lit(6))).collect()


def test_exact_share_in_each_stratum(spark):
    rows = spark.range(90).select(F.col("id"), (F.col("id") % 3 == 0).alias("indoor"))
    dealt = decks.exact_share_deck(rows, ["storm", "fog"], ["sun", "cloud"], 0.2, "weather", "lighting", ["indoor"]).collect()
    for indoor, n in ((True, 30), (False, 60)):
        got = [r["lighting"] for r in dealt if r["indoor"] == indoor]
        assert len(got) == n and sum(x in ("storm", "fog") for x in got) == round(0.2 * n)
        assert abs(got.count("sun") - got.count("cloud")) <= 1 and abs(got.count("storm") - got.count("fog")) <= 1


def test_requests_usage_and_intake(spark):
    captions = spark.createDataFrame([("c0001", "a"), ("c0002", "b"), ("c0003", "c")], "id string, caption string")
    assert [r["id"] for r in manifest.select_ids(captions, "c0002-c0003").orderBy("id").collect()] == ["c0002", "c0003"]
    assert [r["id"] for r in manifest.select_ids(captions, "c0001, c0009").collect()] == ["c0001"]
    rows = manifest.generation_requests(captions, captions.where("id = 'c0001'"), {"ratio": "16:9"}).orderBy("id").collect()
    assert [r["payload"] for r in rows] == ['{"prompt":"b","seed":2,"ratio":"16:9"}', '{"prompt":"c","seed":3,"ratio":"16:9"}']
    cache = spark.createDataFrame([(10, 2, None), (5, None, 3)], "input_tokens long, output_tokens long, cached_tokens long")
    assert tuple(manifest.usage_summary(cache).first()) == (2, 1, 15, 2, 3)
    members = spark.createDataFrame([("x", "c0001", "a", True), ("x", "c0002", "b", False), ("y", "c0001", "a", True), ("y", None, "r", True)], "archive string, clip_id string, file string, valid boolean")
    assert sorted(tuple(r) for r in manifest.intake_summary(members).collect()) == [("x", 1, ["b"], 2), ("y", 2, [], 1)]
    assert manifest.union_clips(members).count() == 2
    paths = manifest.resolve_paths(spark.createDataFrame([("v", None)], "video string, control string"), "/data/").first()
    assert tuple(paths) == ("/data/v", None)


def test_paths_fill_and_smooth_within_a_tracks_row(spark):
    rows = [(1, 2, 5, 1.0, 0.0, 4.0, "foot_ray", True), (1, 2, 9, 5.0, 0.0, 8.0, "head_ray", False), (1, 2, 7, None, None, None, "", False), (1, 3, 4, None, None, None, "", False), (1, 9, 4, 1.0, 1.0, 1.0, "foot_ray", True)]
    positions = spark.createDataFrame(rows, "clip_id long, track_id long, frame long, x double, y double, z double, method string, feet_visible boolean")
    heights = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "clip_id long, track_id long, height double")
    found = ground_paths.subject_paths(positions, heights)
    got = {r["frame"]: r for r in found.collect()}
    assert len(got) == 81 and {r["track_id"] for r in got.values()} == {2}  # no path without a position, none without a height
    raw = [min(max(f, 5), 9) - 4.0 for f in range(81)]
    kernel = [2.718281828459045 ** (-(k * k) / 8) for k in range(-8, 9)]
    want = [sum(w * raw[min(max(f + k - 8, 0), 80)] for k, w in enumerate(kernel)) / sum(kernel) for f in range(81)]
    assert all(abs(got[f]["x"] - want[f]) < 1e-9 and abs(got[f]["z"] - want[f] - 3) < 1e-9 for f in range(81))
    assert [f for f in range(81) if not got[f]["interpolated"]] == [5, 9] and got[5]["method"] == "foot_ray" and got[5]["feet_visible"] and got[7]["method"] == ""
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_worked_out_once_in_plain_columns(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    r, t, normal, d = np.linalg.qr(draw.normal(size=(3, 3)))[0], draw.normal(size=3), np.array([0.6, -0.8, 0.0]), 1.5
    seen = [(1, k % 3, k // 3, k != 7, [False, True, None][k % 11 % 3], None if k == 5 else float(draw.uniform(0, 1280)), *map(float, draw.uniform((0, 0, 0, 50), (720, 1280, 720, 90)))) for k in range(90)]
    detections = spark.createDataFrame(seen, "clip_id long, track_id long, frame long, visible boolean, touches_bottom boolean, foot_u double, foot_v double, head_u double, head_v double, height_px double")
    cams = spark.createDataFrame([(1, f, 800.0, 900.0, 640.0, 360.0, r.ravel().tolist(), t.tolist()) for f in range(30)], "clip_id long, frame long, fx double, fy double, cx double, cy double, r array<double>, t array<double>")
    planes = spark.createDataFrame([(1, normal.tolist(), d)], "clip_id long, normal array<double>, d double")
    hits = ground_paths.hit_frames(detections, cams, planes)
    got, centre, found = {(x["track_id"], x["frame"]): x for x in hits.collect()}, -r.T @ t, 0
    heights = spark.createDataFrame([(1, k, 1.7) for k in range(2)], "clip_id long, track_id long, height double")
    placed = {(x["track_id"], x["frame"]): x for x in ground_paths.ground_positions(hits, heights).collect()}
    for _, track, frame, visible, cut, u, v, head_u, head_v, px in seen:
        row = got.pop((track, frame), None)
        assert (row is not None) == visible
        ray = lambda u, v: (r.T @ [(u - 640) / 800, (v - 360) / 900, 1]) / np.linalg.norm([(u - 640) / 800, (v - 360) / 900, 1])
        far = -(normal @ centre + d) / (normal @ ray(u, v)) if cut is False and u is not None else -1
        want = centre + far * ray(u, v) if far > 0 else None
        if row:
            assert (row["foot"] is None) == (want is None) and (want is None or np.allclose(row["foot"], want) and np.isclose(row["size"], px * (r @ want + t)[2] / 900))
            assert (row["head"] is None) == (cut is not True)
        if row and track < 2:
            up = (1.7 - normal @ centre - d) / (normal @ ray(head_u, head_v))
            if want is None and cut and up > 0:
                want = centre + up * ray(head_u, head_v) - 1.7 * normal
            p, found = placed[track, frame], found + (want is not None)
            assert p["method"] == ("foot_ray" if row["foot"] else "" if want is None else "head_ray") and (p["x"] is None if want is None else np.allclose([p["x"], p["y"], p["z"]], want))
    assert not got and found > 10 and set(placed) == {(k, f) for _, k, f, visible, *_ in seen if visible and k < 2}
    assert "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString() and not {"r", "t", "fx", "cx"} & set(hits.columns)
