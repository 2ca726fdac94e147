import numpy as np
import pytest

from reelyard.operators import scenes
from reelyard.sources import files

KEYS = "scene string, cylinder long, frame long, u double, v double, handle_in_u double, handle_in_v double, handle_out_u double, handle_out_v double"


def test_two_keyframes_are_a_straight_line_at_constant_speed(spark):
    rows = [("s", 1, 10, 0.0, 0.0, *(None,) * 4), ("s", 1, 50, 4.0, 2.0, *(None,) * 4), ("s", 2, 5, 1.0, 1.0, *(None,) * 4)]
    got = {(r["cylinder"], r["frame"]): (r["u"], r["v"]) for r in scenes.sample_paths(spark.createDataFrame(rows, KEYS)).collect()}
    assert len(got) == 162 and got[1, 0] == (0, 0) and got[1, 80] == (4, 2) and got[2, 40] == (1, 1)
    assert np.allclose([got[1, f][0] for f in range(10, 51)], np.linspace(0, 4, 41), atol=1e-9)


def test_rotations(spark):
    def about_z(deg):
        c, s = float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))
        return [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]

    rows = [(1, 0, about_z(0), about_z(90), 0.5), (2, 0, about_z(10), about_z(10), 0.3), (3, 0, about_z(0), about_z(180), 0.5)]
    got = {r["clip_id"]: r["r"] for r in scenes.interpolate_rotations(spark.createDataFrame(rows, "clip_id long, frame long, r0 array<double>, r1 array<double>, w double")).collect()}
    assert np.allclose(got[1], about_z(45)) and np.allclose(got[2], about_z(10))
    assert np.allclose(np.abs(got[3]), np.abs(about_z(90)))


def test_presets_and_runs(spark):
    clips = spark.createDataFrame([(1, 2.0, 10.0)], "clip_id long, height double, distance double")
    got = {(r["preset"], r["frame"]): r for r in scenes.camera_presets(clips).collect()}
    assert len(got) == 6 * 81 and got["dolly_in", 80]["y"] == pytest.approx(2.4) and got["crane", 80]["z"] == pytest.approx(2.0) and got["orbit", 40]["x"] == pytest.approx(0)
    depth = [1, 1, -1, 1, -1, 1, 1, 1]
    samples = spark.createDataFrame([(1, 0, i, float(z), 0.1) for i, z in enumerate(depth)], "clip_id long, line long, i long, depth double, zmin double")
    assert [tuple(r) for r in scenes.visible_runs(samples).orderBy("run").collect()] == [(1, 0, 0, 0, 1), (1, 0, 1, 5, 7)]


def test_payloads_and_points(spark, tmp_path):
    for clip, points in (("c0001", np.arange(6.0).reshape(2, 3)), ("c0002", np.ones((1, 3)))):
        (tmp_path / clip).mkdir()
        np.savez(tmp_path / clip / "ground_points.npz", points=points, normals=points)
        (tmp_path / clip / "qc.json").write_text('{"ok": true}' if clip == "c0001" else "{broken")
    (tmp_path / "c0003").mkdir()
    (tmp_path / "c0003/ground_points.npz").write_bytes((tmp_path / "c0001/ground_points.npz").read_bytes()[:60])
    (tmp_path / "c0003/a.png").write_bytes(b"\x89PNG\r\n\x1a\n....IEND\xaeB`\x82")
    (tmp_path / "c0003/b.png").write_bytes(b"")
    assert files.read_clip_points(spark, str(tmp_path)).count() == 3
    found = spark.read.format("binaryFile").load(str(tmp_path) + "/*/*")
    valid = {"/".join(r["path"].split("/")[-2:]): r["valid"] for r in files.validate_payloads(found).collect()}
    assert {k for k, v in valid.items() if not v} == {"c0002/qc.json", "c0003/ground_points.npz"}
    assert "c0003/b.png" not in valid  # the scan leaves empty files out, so they count as missing


def test_retimed_paths_keep_their_shape(spark):
    rows = [("s", 1, 10, 0.0, 0.0, None, None, 1.0, 3.0), ("s", 1, 30, 4.0, 1.0, *(None,) * 4), ("s", 1, 60, 5.0, -2.0, *(None,) * 4)]
    keyframes = spark.createDataFrame(rows, KEYS)
    path = {r["frame"]: (r["u"], r["v"]) for r in scenes.sample_paths(keyframes).collect()}
    got = scenes.retime_scenes(keyframes, [19.5, 20.4, 90, -3, 44]).collect()
    assert {r["frame"]: (r["u"], r["v"]) for r in got} == {f: path[f] for f in (20, 44)} and all(r["handle_out_u"] is None for r in got)
    assert scenes.retime_scenes(keyframes, [99]).count() == 3


def test_fits_and_turns(spark):
    from pyspark.sql import functions as F

    from reelyard.functions import vec

    rows = spark.createDataFrame([("a", (966.0, 2.0, "pan")), ("b", (966.0, 2.0, "orbit"))], "scene string, camera struct<focal_px:double,pitch_deg:double,path:string>")
    fits = spark.createDataFrame([("a", "p.jpg", 800.0, -1.5)], "scene string, image string, focal_px double, pitch_deg double")
    got = {r["scene"]: r["camera"].asDict() for r in scenes.apply_fit(rows, fits).collect()}
    assert got["a"] == {"focal_px": 800.0, "pitch_deg": -1.5, "path": "pan", "fitted_from": "p.jpg", "anchor_first_frame": True}
    assert got["b"] == {"focal_px": 966.0, "pitch_deg": 2.0, "path": "orbit", "fitted_from": None, "anchor_first_frame": False}
    axis = np.array([1.0, -2.0, 2.0]) / 3
    r = np.array(spark.range(1).select(vec.rot_axis(F.array(*[F.lit(float(x)) for x in axis]), F.lit(0.7))).first()[0]).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ axis, axis) and np.isclose(np.trace(r), 1 + 2 * np.cos(0.7)) and np.isclose(r[1, 0] - r[0, 1], 2 * axis[2] * np.sin(0.7))


def test_grid_lines_are_cut_where_they_pass_the_camera(spark):
    extents = spark.createDataFrame([(1, -2.0, 4.0, -1.0, 1.0, [-1.0, 0.0, 2.0], [0.5], 0.05)], "clip_id long, u0 double, u1 double, v0 double, v1 double, us array<double>, vs array<double>, zmin double")
    frames = spark.createDataFrame([(1, [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0])], "clip_id long, origin array<double>, u array<double>, v array<double>")
    cams = spark.createDataFrame([(1, 3, 100.0, 100.0, 50.0, 50.0, [float(i % 4 == 0) for i in range(9)], [0.0, 0.0, 0.0])], "clip_id long, frame long, fx double, fy double, cx double, cy double, r array<double>, t array<double>")
    got = {(r["axis"], r["line"]): r for r in scenes.grid_polylines(extents, frames, cams).collect()}
    assert set(got) == {("u", 2), ("v", 0)} and len(got["u", 2]["points"]) == 60
    ends = got["u", 2]["points"][0], got["u", 2]["points"][-1]
    assert np.allclose([list(p) for p in ends], [[100, 100], [0, 100]])
    assert len(got["v", 0]["points"]) == sum(-2 + 6 * i / 59 > 0.05 for i in range(60)) and np.allclose(list(got["v", 0]["points"][-1]), [37.5, 75])


def test_grid_lines_are_sampled_on_slices_of_batches_not_by_expressions(spark, monkeypatch):
    monkeypatch.setattr(scenes, "GRID_LINES", 3, raising=False)
    draw, grids, frames, cams, want = np.random.default_rng(5), [], [], [], set()
    turn = lambda: np.linalg.qr(draw.normal(size=(3, 3)))[0]
    for k in range(12):
        us, vs = np.arange(-3, 3, 0.9), np.arange(-2, 2, 0.7)
        origin, (pu, pv, _) = draw.normal(size=3), turn()
        grids.append((k, -3.5, 3.0, -2.5, 2.0, us.tolist(), vs.tolist() if k % 5 else None, 0.2))
        frames.append((k, origin.tolist() if k % 4 else [None, 1.0, 0.0], pu.tolist(), pv.tolist()))
        for f in range(2):
            r, t = turn(), draw.normal(size=3)
            cams.append((k, f, 100.0, 110.0, 50.0, 40.0, r.ravel().tolist(), t.tolist()))
            for axis, places, low, high in (("u", us, -2.5, 2.0), ("v", vs if k % 5 else [], -3.5, 3.0)) if k % 4 else ():
                for i, at in enumerate(places):
                    there = low + (high - low) * np.arange(60) / 59
                    deep = np.array([(r @ (origin + (at * pu + x * pv if axis == "u" else x * pu + at * pv)) + t)[2] > 0.2 for x in there])
                    runs = [x for x in np.split(np.arange(60), np.flatnonzero(np.diff(deep)) + 1) if deep[x[0]] and len(x) > 1]
                    want |= {(k, f, axis, i, n, len(x)) for n, x in enumerate(runs)}
    extents = spark.createDataFrame(grids, "clip_id long, u0 double, u1 double, v0 double, v1 double, us array<double>, vs array<double>, zmin double")
    planes = spark.createDataFrame(frames, "clip_id long, origin array<double>, u array<double>, v array<double>")
    drawn = scenes.grid_polylines(extents, planes, spark.createDataFrame(cams, "clip_id long, frame long, fx double, fy double, cx double, cy double, r array<double>, t array<double>"))
    assert {(*r[:5], len(r["points"])) for r in drawn.collect()} == want and len(want) > 100
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()  # worked out once a sample, not once a use


def test_sidecars(spark, tmp_path):
    (tmp_path / "c1.json").write_text('{"id": "c1", "status": "ok",\n "cost_usd": 0.6}')
    (tmp_path / "c2.json").write_text('{"status": "error", "error": "late"}')
    (tmp_path / "c1.mp4").write_bytes(b"x")
    got = files.read_sidecars(spark, str(tmp_path), "id string, status string, cost_usd double, error string").collect()
    assert sorted((r["id"], r["status"], r["cost_usd"], r["error"]) for r in got) == [("c1", "ok", 0.6, None), ("c2", "error", None, "late")]
