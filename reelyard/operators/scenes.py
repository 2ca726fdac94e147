"""Camera presets and authored scenes as frame tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelyard.functions import vec
from reelyard.operators.cameras import slerp

PRESETS = ("static", "dolly_in", "dolly_out", "orbit", "pan", "crane")
FRAMES = 81
WIDTH, HEIGHT = 1280, 720
GRID_LINES = 1024


def camera_presets(clips: DataFrame, names: tuple[str, ...] = PRESETS) -> DataFrame:
    """clip_id, preset, frame, x, y, z, yaw_deg: the camera's place on the plane (x across, y ahead, z up) and its turn.

    clips has height (of the camera) and distance (to the target ahead). Dolly: min(1.2 heights, 40 % of the distance) along
    the view; orbit: 20 degrees to both sides round the target; pan: 12 degrees to both sides; crane: 1.5 heights down."""
    rows = clips.select("clip_id", "height", "distance", F.explode(F.array(*map(F.lit, names))).alias("preset"))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))))
    w = F.col("frame") / F.lit(float(FRAMES - 1))
    travel, swing = F.least(1.2 * F.col("height"), 0.4 * F.col("distance")), F.radians(F.lit(20.0)) * (2 * w - 1)
    is_ = lambda name: F.col("preset") == name
    return rows.select(
        "clip_id", "preset", "frame",
        F.when(is_("orbit"), F.col("distance") * F.sin(swing)).otherwise(0.0).alias("x"),
        F.when(is_("dolly_in"), travel * w).when(is_("dolly_out"), -travel * w).when(is_("orbit"), F.col("distance") * (1 - F.cos(swing))).otherwise(0.0).alias("y"),
        (F.col("height") + F.when(is_("crane"), 1.5 * F.col("height") * (1 - w)).otherwise(0.0)).alias("z"),
        F.when(is_("pan"), 12.0 * (2 * w - 1)).when(is_("orbit"), -F.degrees(swing)).otherwise(0.0).alias("yaw_deg"),
    )


def segment_tangents(keyframes: DataFrame) -> DataFrame:
    """keyframes (scene, cylinder, frame, u, v and optional handles) with out_u, out_v, in_u, in_v: Catmull-Rom handles
    P +- (next - previous) / 6 with the ends doubled; explicit handles win."""
    by = Window.partitionBy("scene", "cylinder").orderBy("frame")
    for c in ("u", "v"):
        step = F.coalesce(F.lead(c).over(by), F.col(c)) - F.coalesce(F.lag(c).over(by), F.col(c))
        keyframes = keyframes.withColumns({f"out_{c}": F.coalesce(F.col(f"handle_out_{c}"), F.col(c) + step / 6), f"in_{c}": F.coalesce(F.col(f"handle_in_{c}"), F.col(c) - step / 6)})
    return keyframes


def tangents(path: np.ndarray, k: np.ndarray) -> np.ndarray:
    """frame, u, v, out_u, out_v, in_u, in_v of keyframes in order of path and frame, as segment_tangents() has them. k: frame,
    u, v and explicit handles in_u, in_v, out_u, out_v (nan: none)."""
    p, same = k[:, 1:3], (path[1:] == path[:-1])[:, None]
    step = np.concatenate((np.where(same, p[1:], p[:-1]), p[-1:])) - np.concatenate((p[:1], np.where(same, p[:-1], p[1:])))
    leave, arrive = np.where(np.isnan(k[:, 5:7]), p + step / 6, k[:, 5:7]), np.where(np.isnan(k[:, 3:5]), p - step / 6, k[:, 3:5])
    return np.concatenate((k[:, :3], leave, arrive), axis=1)


def bezier_paths(path: np.ndarray, k: np.ndarray, count: int, frames: int = FRAMES, steps: int = 200) -> np.ndarray:
    """Places (count, frames, 2) on paths of cubic Bezier segments at constant speed, held before and after. path: each keyframe's
    path, rising, every number below count; k as of tangents(). Of keyframes of one frame the last stays."""
    if np.isnan(k[:, 0]).any():
        raise ValueError("a keyframe without a frame")
    last = np.append((path[1:] != path[:-1]) | (k[1:, 0] != k[:-1, 0]), True)[: len(path)]
    path, k = path[last], k[last]
    at, p, leave, arrive = k[:, 0], k[:, 1:3], k[:, 3:5], k[:, 5:7]
    first, end = np.searchsorted(path, np.arange(count)), np.searchsorted(path, np.arange(count), "right") - 1
    out = np.where(np.arange(frames)[:, None] < at[first][:, None, None], p[first][:, None], p[end][:, None])
    i = np.flatnonzero(path[1:] == path[:-1])
    if not len(i):
        return out
    t = np.linspace(0, 1, steps + 1)[:, None]
    a, b, c, d = (x[:, None] for x in (p[i], leave[i], arrive[i + 1], p[i + 1]))
    curve = (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t**2 * c + t**3 * d
    length = np.concatenate((np.zeros((len(i), 1)), np.cumsum(np.linalg.norm(np.diff(curve, axis=1), axis=2), axis=1)), axis=1)
    low, high = np.ceil(np.clip(at[i], 0, frames)).astype(int), np.floor(np.clip(at[i + 1], -1, frames - 1)).astype(int)
    n = np.maximum(high - low + 1, 0)
    s = np.repeat(np.arange(len(i)), n)
    inside = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + low[s]
    whole = length[:, -1]
    want = (inside - at[i][s]) / (at[i + 1] - at[i])[s] * whole[s]
    # one search over all segments, each in a stretch of its own
    scale = np.where(whole > 0, whole, 1.0)
    stretches = (length / scale[:, None] + 2 * np.arange(len(i))[:, None]).ravel()
    j = np.clip(np.searchsorted(stretches, want / scale[s] + 2 * s, "right") - 1 - s * (steps + 1), 0, steps - 1)
    gap = length[s, j + 1] - length[s, j]
    part = np.where(gap > 0, (want - length[s, j]) / np.where(gap > 0, gap, 1.0), 0.0)[:, None]
    found = np.where((want >= whole[s])[:, None], p[i + 1][s], curve[s, j] + (curve[s, j + 1] - curve[s, j]) * part)
    out[path[i][s], inside] = np.where((whole[s] > 0)[:, None], found, p[i][s])
    return out


def sample_paths(keyframes: DataFrame, frames: int = FRAMES, steps: int = 200) -> DataFrame:
    """scene, cylinder, frame, u, v of every frame: cubic Bezier segments at constant speed, held before and after.

    A cylinder's keyframes come together in one row, which is turned into its path where it is; of keyframes of one frame the
    last in order of their values stays."""
    ends = ("u", "v", "out_u", "out_v", "in_u", "in_v")
    # few bytes make much work, so the tasks' number is fixed
    tasks = int(keyframes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segment_tangents(keyframes.repartition(tasks, "scene", "cylinder")).groupBy("scene", "cylinder").agg(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("double").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ends]))).alias("_k"))
    packed = rows.select("scene", "cylinder", F.flatten(F.transform("_k", lambda k: F.array(k.frame, *[k[c] for c in ends]))).alias("_k"))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256]
                keys = [np.asarray(k, np.float64).reshape(-1, 7) for k in b["_k"]]
                paths = bezier_paths(np.repeat(np.arange(len(b)), list(map(len, keys))), np.concatenate(keys), len(b), frames, steps)
                yield b[["scene", "cylinder"]].assign(us=list(paths[:, :, 0]), vs=list(paths[:, :, 1]))

    found = packed.mapInPandas(sampled, "scene string, cylinder long, us array<double>, vs array<double>")
    return found.select("scene", "cylinder", F.posexplode(F.arrays_zip("us", "vs")).alias("frame", "_p")).select("scene", "cylinder", F.col("frame").cast("long").alias("frame"), F.col("_p.us").alias("u"), F.col("_p.vs").alias("v"))


def scene_fault(n_frames: Column, width: Column, height: Column, path: Column, bare: Column) -> Column:
    """The first rule that an authored scene breaks, or null; bare: its first cylinder without keyframes."""
    path = F.coalesce(path, F.lit("static"))
    return (
        F.when(F.coalesce(n_frames, F.lit(FRAMES)) != FRAMES, F.lit(f"not {FRAMES} frames"))
        .when((F.coalesce(width, F.lit(WIDTH)) != WIDTH) | (F.coalesce(height, F.lit(HEIGHT)) != HEIGHT), F.lit(f"not {WIDTH} x {HEIGHT}"))
        .when(~path.isin(*PRESETS), F.concat(F.lit("unknown camera path "), path))
        .when(bare.isNotNull(), F.concat(F.lit("no keyframes for cylinder "), bare.cast("string")))
    )


def scene_checks(scenes: DataFrame, cylinders: DataFrame, keyframes: DataFrame) -> DataFrame:
    """scene, accepted, reason: whether an authored scene (scene, n_frames, width, height, path; null: the default) can be drawn.
    cylinders (scene, cylinder) names those of a scene, keyframes (scene, cylinder) has a row for each keyframe. A scene
    without cylinders is fine; the first rule that fails is the reason."""
    bare = cylinders.select("scene", "cylinder").distinct().join(keyframes.select("scene", "cylinder").distinct(), ["scene", "cylinder"], "left_anti")
    bare = bare.groupBy("scene").agg(F.min("cylinder").alias("_bare"))
    reason = scene_fault(*map(F.col, ("n_frames", "width", "height", "path", "_bare")))
    return scenes.join(bare, "scene", "left").select("scene", reason.isNull().alias("accepted"), reason.alias("reason"))


def shift_scenes(keyframes: DataFrame, du: float) -> DataFrame:
    """keyframes with every place and explicit handle moved by du along u, to three decimals."""
    return keyframes.withColumns({c: F.round(F.col(c) + F.lit(du), 3) for c in ("u", "handle_in_u", "handle_out_u")})


def retime_scenes(keyframes: DataFrame, frames: list[float]) -> DataFrame:
    """keyframes of the same paths at new frames: each rounded (halves up), those of 0 to 80, once each; the handles go, so
    new tangents follow from the new places. Without any such frame the keyframes stay."""
    at = sorted({f for f in (int(np.floor(x + 0.5)) for x in frames) if 0 <= f < FRAMES})
    if not at:
        return keyframes
    none = {f"handle_{end}_{c}": F.lit(None).cast("double") for end in ("in", "out") for c in ("u", "v")}
    return sample_paths(keyframes).where(F.col("frame").isin(at)).withColumns(none)


def apply_fit(scenes: DataFrame, fits: DataFrame) -> DataFrame:
    """scenes (scene, camera struct) whose camera takes the focal length and pitch fitted to a photograph (scene, image,
    focal_px, pitch_deg, one row a scene) and is anchored to it; scenes without a fit keep theirs, with null marks."""
    fit = fits.select("scene", F.struct("image", "focal_px", "pitch_deg").alias("_fit"))
    joined, camera = scenes.join(fit, "scene", "left"), F.col("camera")
    for name in ("focal_px", "pitch_deg"):
        camera = camera.withField(name, F.coalesce(F.col("_fit")[name], F.col("camera")[name]))
    camera = camera.withField("fitted_from", F.col("_fit")["image"]).withField("anchor_first_frame", F.col("_fit").isNotNull())
    return joined.withColumn("camera", camera).drop("_fit")


def grid_polylines(extents: DataFrame, frames: DataFrame, cams: DataFrame, samples: int = 60) -> DataFrame:
    """clip_id, frame, axis, line, run, points (array of pixel u, v): the lines of a clip's grid as a camera sees them.

    extents comes from plane_extent(), frames has clip_id, origin, u, v, cams clip_id, frame, fx, fy, cx, cy, r, t. Each line is
    sampled evenly; what is deeper than zmin is seen, and a run of two or more seen samples is drawn; a sample without a
    depth isn't seen. A clip's grid and one of its cameras are one row, whose lines are sampled and cut GRID_LINES at a time."""
    number = lambda *names: [F.col(n).cast("double") for n in names]
    plane = extents.join(frames.select("clip_id", "origin", F.col("u").alias("_u"), F.col("v").alias("_v")), "clip_id")
    seen = plane.join(cams.select("clip_id", "frame", "fx", "fy", "cx", "cy", "r", "t"), "clip_id")
    parts = [vec.at(F.col(c), i).cast("double") for c, n in (("origin", 3), ("_u", 3), ("_v", 3), ("r", 9), ("t", 3)) for i in range(n)]
    figures = F.array(*number("u0", "u1", "v0", "v1", "zmin", "fx", "fy", "cx", "cy"), *parts).alias("_g")
    # few bytes make much work, so the tasks' number is fixed
    tasks = int(extents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seen.select("clip_id", "frame", *[F.col(c).cast("array<double>").alias(c) for c in ("us", "vs")], figures).repartition(tasks, "clip_id", "frame")
    plain = {"axis": T.StringType(), "line": T.IntegerType(), "run": T.IntegerType(), "points": T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "uv"]))}
    out = T.StructType([*rows.select("clip_id", "frame").schema.fields, *[T.StructField(n, t) for n, t in plain.items()]])
    along = np.arange(samples) / float(samples - 1)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for axis, lines, low, high in (("u", b.column(2), 2, 3), ("v", b.column(3), 0, 1)):
                places, sizes = lines.flatten().to_numpy(zero_copy_only=False), lines.value_lengths().fill_null(0).to_numpy()
                starts = np.cumsum(sizes) - sizes
                of = np.repeat(np.arange(b.num_rows), sizes)
                for first in range(0, len(of), GRID_LINES):
                    clip, place = of[first : first + GRID_LINES], places[first : first + GRID_LINES, None]
                    line, u, v, depth = first + np.arange(len(clip)) - starts[clip], *_seen_lines(axis, place, g[clip], along, low, high)
                    ok = depth > g[clip, 4, None]
                    edges = np.diff(np.pad(ok, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                    (at, begin), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
                    alone = end - begin < 2
                    ok[at[alone], begin[alone]] = False
                    at, begin, end = at[~alone], begin[~alone], end[~alone]
                    run = np.arange(len(at)) - np.searchsorted(at, at)
                    points = pa.StructArray.from_arrays([pa.array(c[ok], from_pandas=True) for c in (u, v)], ["u", "v"])
                    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
                    row = pa.array(clip[at])
                    rest = [pa.array([axis]).take(pa.array(np.zeros(len(at), np.int32))), pa.array(line[at].astype(np.int32)), pa.array(run.astype(np.int32)), pa.ListArray.from_arrays(offsets, points)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *rest], out.names)

    return rows.mapInArrow(drawn, out)


def _seen_lines(axis: str, place: np.ndarray, g: np.ndarray, along: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, depth (lines, samples) of lines at `place` of an axis, g being their figures as in grid_polylines(), as vec.project()."""
    fx, fy, cx, cy, origin, pu, pv, r, t = (x[:, :, None] if x.shape[1] > 1 else x for x in np.split(g[:, 5:], [1, 2, 3, 4, 7, 10, 13, 22], axis=1))
    inner = g[:, low, None] + (g[:, high] - g[:, low])[:, None] * along
    a, b = (place, inner) if axis == "u" else (inner, place)
    x = [origin[:, i] + a * pu[:, i] + b * pv[:, i] for i in range(3)]
    across, down, depth = (r[:, 3 * i] * x[0] + r[:, 3 * i + 1] * x[1] + r[:, 3 * i + 2] * x[2] + t[:, i] for i in range(3))
    z = np.maximum(depth, 1e-9)
    return fx * across / z + cx, fy * down / z + cy, depth


def visible_runs(samples: DataFrame) -> DataFrame:
    """clip_id, line, run, first, last: maximal runs of samples (clip_id, line, i, depth, zmin) before the camera, of two or more."""
    by = Window.partitionBy("clip_id", "line").orderBy("i")
    seen = samples.withColumn("_seen", F.col("depth") > F.col("zmin"))
    marked = seen.withColumn("_run", F.sum((~F.col("_seen")).cast("int")).over(by)).where("_seen")
    runs = marked.groupBy("clip_id", "line", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("clip_id", "line").orderBy("first")) - 1).select("clip_id", "line", "run", "first", "last")


def interpolate_rotations(brackets: DataFrame) -> DataFrame:
    """clip_id, frame, r: rotation between r0 and r1 (row-major, 9) at w, along the shortest turn."""

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r0, r1 = (np.stack(b[c].to_list()).reshape(-1, 3, 3) for c in ("r0", "r1"))
                yield b[["clip_id", "frame"]].assign(r=list(slerp(r0, r1, b["w"].to_numpy()).reshape(-1, 9)))

    return brackets.select("clip_id", "frame", "r0", "r1", "w").mapInPandas(between, "clip_id long, frame long, r array<double>")
