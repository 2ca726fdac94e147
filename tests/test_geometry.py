import numpy as np
from pyspark.sql import functions as F

from reelyard.functions import vec
from reelyard.operators import cameras, plane, tracks


def test_planted_plane(spark):
    draw, rows = np.random.default_rng(3), []
    for clip, tilt in enumerate((0.0, 15.0, 40.0)):
        n = np.array([0, -np.cos(np.radians(tilt)), np.sin(np.radians(tilt))])
        xyz = draw.uniform((-4, -3, 3), (4, 3, 9), (900, 3))
        xyz[:600] -= ((xyz[:600] @ n) + 1.6)[:, None] * n  # n.x + 1.6 = 0
        rows += [(str(clip), *map(float, p)) for p in xyz]
    rows += [("few", 0.0, 1.0, 2.0)]
    got = {r["clip_id"]: r for r in plane.fit_ground(spark.createDataFrame(rows, "clip_id string, x double, y double, z double")).collect()}
    for clip, tilt in enumerate((0.0, 15.0, 40.0)):
        r = got[str(clip)]
        n = np.array([0, -np.cos(np.radians(tilt)), np.sin(np.radians(tilt))])
        assert abs(n @ [r["nx"], r["ny"], r["nz"]]) > np.cos(np.radians(0.5)) and abs(r["camera_height"] - 1.6) < 0.02 and r["plane_ok"]
    assert got["few"]["error"] and not got["few"]["plane_ok"]


def test_rays_and_projection(spark):
    k = [F.lit(x) for x in (500.0, 500.0, 640.0, 360.0)]
    r, t = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    ray = vec.pixel_ray(*k, r, F.lit(640.0), F.lit(610.0))
    up = F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0))
    hit = vec.ray_plane(vec.cam_center(r, t), ray, up, F.lit(1.5))
    row = spark.range(1).select(hit.alias("hit"), vec.project(*k, r, t, hit).alias("p"), vec.ray_plane(vec.cam_center(r, t), vec.pixel_ray(*k, r, F.lit(640.0), F.lit(360.0)), up, F.lit(1.5)).alias("none")).first()
    assert np.allclose(row["hit"], [0, 1.5, 3.0]) and np.allclose(row["p"][:2], [640, 610]) and row["none"] is None


def test_gaps_and_smoothing(spark):
    xs = [None, None, 2.0, None, 4.0, 5.0, None]
    frame = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(xs)], "clip_id long, track_id long, frame long, x double")
    filled = tracks.fill_gaps(frame)
    assert [r["x"] for r in filled.orderBy("frame").collect()] == [2, 2, 2, 3, 4, 5, 5]
    weights = np.exp(-np.arange(-8, 9) ** 2 / 8.0)
    want = np.convolve(np.pad([2, 2, 2, 3, 4, 5, 5], 8, mode="edge"), weights / weights.sum(), mode="valid")
    assert np.allclose([r["smooth"] for r in tracks.smooth_path(filled).orderBy("frame").collect()], want)


def plain_plane(points, normals, camera, up, near, seed):
    """The rule one hypothesis and one point at a time, on the same draws."""
    draw, best, found = np.random.default_rng(seed), [], None
    inside = lambda n, d: [i for i, p in enumerate(points) if abs(n @ p + d) < near and (normals is None or abs(normals[i] @ n) > np.cos(np.pi / 6))]
    for start in range(0, 600, 32):
        for k, (i, j, m) in enumerate(draw.integers(0, len(points), (min(32, 600 - start), 3))):
            one = normals is not None and k % 2 == 0
            n = normals[i] if one else np.cross(points[j] - points[i], points[m] - points[i])
            if np.linalg.norm(n) < (1e-6 if one else 1e-9):
                continue
            n = n / np.linalg.norm(n)
            if len(now := inside(n, -n @ points[i])) > len(best):
                best, found = now, n
    center = points[best].mean(axis=0)
    n = np.linalg.svd(points[best] - center, full_matrices=False)[2][-1] if len(best) >= 3 else found
    n = n if n @ (camera - center) >= 0 else -n
    now = inside(n, -n @ center)
    angle = np.degrees(np.arccos(np.clip(n @ up, -1, 1)))
    height = n @ (camera - center)
    agree = np.mean([abs(normals[i] @ n) for i in now]) if normals is not None and now else None
    return [*n, len(now) / len(points), height, angle, agree], len(now) / len(points) >= 0.3 and angle <= 45 and height > 0


def test_normals_and_steep_planes(spark):
    draw = np.random.default_rng(5)

    def level(n, axis, at, normal, tilt=0.02):
        p = draw.uniform((-4, -3, 3), (4, 3, 9), (n, 3))
        p[:, axis] = at
        return p, np.array(normal) + draw.normal(0, tilt, (n, 3))

    ground, wall, litter = level(60, 1, 1.5, (0, -1, 0)), level(100, 0, 3.0, (1, 0, 0)), level(100, 1, 2.5, (1, 0, 0))
    clips = {"wall": (ground, wall), "litter": (ground, litter), "ground": (ground,), "bare": ((wall[0], None),)}
    rows, data = [], {}
    for clip, parts in clips.items():
        bare = clip == "bare"
        p = np.vstack([a for a, _ in parts])
        m = np.full_like(p, np.nan) if bare else np.vstack([b for _, b in parts])
        order = np.lexsort([*m.T[::-1], *p.T[::-1]])
        data[clip] = p[order], None if bare else m[order]
        rows += [(clip, *map(float, a), *([None] * 3 if bare else map(float, b))) for a, b in zip(p, m, strict=True)]
    frame = spark.createDataFrame(rows, "clip_id string, x double, y double, z double, nx double, ny double, nz double")
    c, s = np.cos(0.3), np.sin(0.3)
    r, t = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]), np.array([0.2, -0.3, 0.4])
    cameras = spark.createDataFrame([(k, r.ravel().tolist(), t.tolist()) for k in clips] + [("none", r.ravel().tolist(), t.tolist())], "clip_id string, r array<double>, t array<double>")
    for cams, r, t in ((None, np.eye(3), np.zeros(3)), (cameras, r, t)):
        got = {g["clip_id"]: g for g in plane.fit_ground(frame, cameras=cams).collect()}
        for clip, (p, m) in data.items():
            g = got[clip]
            want, ok = plain_plane(p, m, -r.T @ t, r.T @ plane.UP, 0.01 * np.median(np.abs((p @ r.T + t)[:, 2])), 0)
            mine = [g[k] for k in ("nx", "ny", "nz", "inlier_ratio", "camera_height", "angle_deg", "normal_agreement")]
            assert (mine[6] is None) == (want[6] is None) and np.allclose([x or 0 for x in mine], [x or 0 for x in want], atol=1e-6) and g["plane_ok"] == ok
        if cams is None:
            assert [got[k]["plane_ok"] for k in clips] == [False, True, True, False] and abs(got["litter"]["camera_height"] - 1.5) < 0.02 and got["wall"]["angle_deg"] > 80
        else:
            assert got["none"]["error"] == "under 3 points"


def test_plane_frames_make_each_value_once(spark):
    n = F.col("n")
    rows = spark.createDataFrame([([0.0, -1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.8, 0.6, 0.0, -0.6, 0.8], [0.1, 0.2, 0.3])], "n array<double>, r array<double>, t array<double>")
    framed = rows.select(vec.plane_frame(n, F.lit(1.5), F.col("r"), F.col("t")).alias("p"), vec.pixel_ray(*[F.lit(1.0)] * 4, F.col("r"), F.lit(2.0), F.lit(3.0)).alias("ray"))
    assert framed._jdf.queryExecution().optimizedPlan().toString().count("sqrt") < 8
    got = framed.first()
    r, t, up = np.array([1.0, 0, 0, 0, 0.8, 0.6, 0, -0.6, 0.8]).reshape(3, 3), np.array([0.1, 0.2, 0.3]), np.array([0.0, -1, 0])
    c = -r.T @ t
    ahead = r[2] - r[2] @ up * up
    u = ahead / np.linalg.norm(ahead)
    h = up @ c + 1.5
    assert np.allclose(got["p"]["origin"], c - h * up) and np.allclose(got["p"]["u"], u) and np.allclose(got["p"]["v"], np.cross(up, u)) and np.isclose(got["p"]["h"], h)
    d = r.T @ np.array([1.0, 2.0, 1.0])
    assert np.allclose(got["ray"], d / np.linalg.norm(d))


def test_nearest_keyframes_are_found_within_a_clips_row(spark):
    frames = spark.createDataFrame([(c, f) for c in (1, 2, 3) for f in range(-1, 83)], "clip_id long, frame int")
    cams = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 10), (2, 5, 40), (4, 0, 0)], "clip_id long, kf int, frame int")
    found = cameras.nearest_keyframe(frames.unionByName(frames.where("frame = 7")), cams)
    got = {(r["clip_id"], r["frame"]): r["kf"] for r in found.collect()}
    assert found.count() == len(got) == 2 * 84 and got[1, 5] == 0 and got[1, 6] == 1 and {v for (c, _), v in got.items() if c == 2} == {5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.index("Generate") < plan.index("Join")  # keyframes meet clips, not frames
