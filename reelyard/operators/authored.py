"""Authored scenes and preset cameras as frame tables: world-to-camera matrices, cylinder paths and colours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelyard.functions import vec
from reelyard.operators.scenes import FRAMES, HEIGHT, PRESETS, WIDTH, bezier_paths, scene_fault, tangents

ORBIT, PAN, RISE = 40.0, 24.0, 1.5  # degrees of the whole turn, heights of the crane


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-300)


def turned(a: np.ndarray, axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Vectors a turned about unit axes."""
    c, s = np.cos(angle)[..., None], np.sin(angle)[..., None]
    return a * c + np.cross(axis, a) * s + axis * ((a * axis).sum(-1, keepdims=True) * (1 - c))


def facing(forward: np.ndarray, up: np.ndarray) -> np.ndarray:
    """World-to-camera rotations of cameras that look along forward, with their x axis level (x right, y down, z forward)."""
    z = unit(forward)
    x = unit(np.cross(-up, z))
    return np.stack((x, np.cross(z, x), z), axis=-2)


def moved_cameras(path: np.ndarray, r0: np.ndarray, c0: np.ndarray, normal: np.ndarray, target: np.ndarray, h: np.ndarray, w: np.ndarray, orbit: np.ndarray, travel: np.ndarray, anchored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 3, 3) and centres (n, 3) of cameras at the part w of their path, from where they stand (r0, c0).

    static; dolly_in and dolly_out: straight along the view on the ground, by min(1.2 h, 40 % of the way to the target) or
    travel * h where that is given; orbit: half of the turn to both sides of the target about the normal, aimed at it; pan:
    12 degrees to both sides; crane: down from 1.5 h above, aimed at the target. An anchored camera keeps its first frame: it
    orbits and pans rigidly from there on, and its crane rises without turning."""
    n = len(path)
    ahead = unit(r0[:, 2] - normal * (r0[:, 2] * normal).sum(1, keepdims=True))
    way = ((target - c0) * ahead).sum(1)
    step = np.where(np.isfinite(travel), travel * h, np.minimum(1.2 * h, 0.4 * way))
    r, c = r0.copy(), c0.copy()
    sign = np.where(path == "dolly_in", 1.0, np.where(path == "dolly_out", -1.0, 0.0))
    c += (sign * step * w)[:, None] * ahead
    rigid = lambda rows, angle: turned(r0[rows], np.broadcast_to(normal[rows, None], (rows.sum(), 3, 3)), np.broadcast_to(angle[:, None], (rows.sum(), 3)))
    for rows in (path == "orbit",):
        angle = np.radians(np.where(anchored, ORBIT * w, orbit * (w - 0.5)))[rows]
        c[rows] = target[rows] + turned(c0[rows] - target[rows], normal[rows], angle)
        r[rows] = np.where(anchored[rows, None, None], rigid(rows, angle), facing(target[rows] - c[rows], normal[rows]))
    pans = path == "pan"
    r[pans] = rigid(pans, np.radians(np.where(anchored, PAN * w, PAN * (w - 0.5)))[pans])
    cranes = path == "crane"
    c[cranes] += (np.where(anchored, w, 1 - w) * RISE * h)[cranes, None] * normal[cranes]
    aimed = cranes & ~anchored
    r[aimed] = facing(target[aimed] - c[aimed], normal[aimed])
    assert len(r) == n
    return r, c


LENS = ("fx", "fy", "cx", "cy")


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def cameras_at(rows: DataFrame, kept: list[str], frames: Sequence[int]) -> DataFrame:
    """kept (columns of rows), frame, fx, fy, cx, cy, r, t: the camera of each row at the frames, made where the row is. rows as
    of frame_cameras()."""
    number = lambda c: F.col(c).cast("double").alias(c)
    inner = {"path": F.col("path"), "r": F.col("r"), "t": F.col("t"), "normal": F.col("normal"), "target": F.col("target"), "h": F.col("h").cast("double"), "orbit_deg": F.col("orbit_deg").cast("double"), "travel": F.col("travel").cast("double"), "anchored": F.coalesce("anchored", F.lit(False))}
    given = rows.select(*kept, *[number(c) for c in LENS], *[v.alias(f"_{c}") for c, v in inner.items()])
    numbers = T.ArrayType(T.DoubleType())
    out = T.StructType([*given.select(*kept).schema.fields, T.StructField("frame", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in LENS], T.StructField("r", numbers), T.StructField("t", numbers)])
    every = np.asarray(frames, np.int64)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n = b.num_rows
                row = np.repeat(np.arange(n), len(every))
                column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
                plain = lambda c: column(f"_{c}").to_numpy(zero_copy_only=False)[row]  # noqa: B023, E731
                matrix = lambda c, *shape: column(f"_{c}").flatten().to_numpy(zero_copy_only=False).reshape(n, *shape)[row]  # noqa: B023, E731
                frame, r0, orbit = np.tile(every, n), matrix("r", 3, 3), plain("orbit_deg")
                c0 = -np.einsum("nij,ni->nj", r0, matrix("t", 3))
                r, c = moved_cameras(plain("path").astype(object), r0, c0, matrix("normal", 3), matrix("target", 3), plain("h"), frame / (FRAMES - 1), np.where(np.isnan(orbit), ORBIT, orbit), plain("travel"), plain("anchored").astype(bool))
                t = -np.einsum("nij,nj->ni", r, c)
                copies = pa.array(row)
                carried = {c: column(c).take(copies) for c in (*kept, *LENS)}
                made_here = carried | {"frame": pa.array(frame), "r": _lists(r.reshape(-1, 9)), "t": _lists(t)}
                yield pa.RecordBatch.from_arrays([made_here[f.name] for f in out.fields], [f.name for f in out.fields])

    return given.mapInArrow(made, out)


def frame_cameras(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, fx, fy, cx, cy, r, t of each row's camera over all frames. rows: keys, fx, fy, cx, cy, r, t (where it stands,
    world to camera), path, normal, target, h, and orbit_deg, travel (null: the preset's), anchored. One row a camera is
    dealt out and makes its frames where it is."""
    return cameras_at(_dealt(rows, keys), keys, range(FRAMES))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in a fixed number of tasks: few bytes make much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def preset_cameras(clips: DataFrame, names: tuple[str, ...] = PRESETS, zoom: float = 1.0) -> DataFrame:
    """clip_id, preset, frame, fx, fy, cx, cy, r, t: the presets of every clip. clips: clip_id, fx, fy, cx, cy, r, t (its first
    camera), normal, target, h (its grid spacing). zoom scales the focal lengths."""
    none = F.lit(None).cast("double")
    rows = clips.withColumns({"path": F.explode(F.array(*map(F.lit, names))), "fx": F.col("fx") * zoom, "fy": F.col("fy") * zoom, "orbit_deg": none, "travel": none, "anchored": F.lit(False)})
    return frame_cameras(rows.withColumn("preset", F.col("path")), ["clip_id", "preset"])


def preset_targets(paths: DataFrame, planes: DataFrame) -> DataFrame:
    """clip_id, target: the subjects' middle in frame 40, half a grid cell up. paths: clip_id, track_id, frame, x, y, z; planes:
    clip_id, normal, grid_spacing."""
    middle = paths.where(F.col("frame") == FRAMES // 2).groupBy("clip_id").agg(*[F.avg(c).alias(c) for c in "xyz"]).join(planes.select("clip_id", "normal", "grid_spacing"), "clip_id")
    return middle.select("clip_id", F.array(*[F.col(c) + 0.5 * F.col("grid_spacing") * vec.at(F.col("normal"), i) for i, c in enumerate("xyz")]).alias("target"))


SCENE = """name string, n_frames int, width int, height int, plane struct<origin: array<double>, u: array<double>, normal: array<double>>,
cylinders array<struct<id: bigint, height: double, radius: double, color_index: int, keyframes: array<struct<frame: double, uv: array<double>, handle_in: array<double>, handle_out: array<double>>>>>,
camera struct<focal_px: double, principal: array<double>, height: double, yaw_deg: double, pitch_deg: double, path: string, orbit_deg: double, dolly_travel: double, anchor_first_frame: boolean>"""


def _unit(v: Column) -> Column:
    return F.transform(v, lambda c: c / vec.norm(v))


def parse_scenes(documents: DataFrame) -> DataFrame:
    """scene, s: documents (scene, json) as structs of the scene's fields; text that is no such document gives a null."""
    return documents.select("scene", F.from_json("json", SCENE).alias("s"))


def scene_faults(documents: DataFrame) -> DataFrame:
    """scene, s, fault: parsed scenes with the reason why one can't be drawn, or null."""
    keys = lambda c: F.coalesce(F.size(c["keyframes"]), F.lit(0))
    bare = F.array_min(F.transform("s.cylinders", lambda c, i: F.when(keys(c) <= 0, i)))
    fault = scene_fault(F.col("s.n_frames"), F.col("s.width"), F.col("s.height"), F.col("s.camera.path"), bare)
    return parse_scenes(documents).select("scene", "s", F.when(F.col("s.camera").isNull(), "no camera or no such document").otherwise(fault).alias("fault"))


def scene_paths(documents: DataFrame, frames: Sequence[int]) -> DataFrame:
    """scene, plane, camera (structs of the document), people (array of its cylinders: cylinder, height, radius, color_index), us,
    vs (for each of the people its places on the plane at the frames) of the scenes without a fault. A row a scene, which is
    turned into its paths where it is."""
    read = scene_faults(_dealt(documents, ["scene"]))
    none = F.lit(float("nan"))

    def person(c: Column, i: Column) -> Column:
        height = F.coalesce(c["height"], F.lit(1.0))
        radius = F.when(F.coalesce(c["radius"], F.lit(0.0)) == 0, 0.2 * height).otherwise(c["radius"])
        return F.struct(F.coalesce(c["id"], i.cast("long")).alias("cylinder"), height.alias("height"), radius.alias("radius"), c["color_index"].alias("color_index"))

    def numbers(c: Column, i: Column) -> Column:
        part = lambda k, name, at: F.coalesce(F.get(k[name], F.lit(at)), none)
        each = F.transform(c["keyframes"], lambda k: F.array(F.coalesce(k["frame"], none), *[part(k, name, at) for name in ("uv", "handle_in", "handle_out") for at in (0, 1)]))
        return F.flatten(F.transform(F.array_sort(each), lambda k: F.concat(F.array(i.cast("double")), k)))

    rows = read.select(
        "scene", F.col("fault").isNull().alias("_ok"), F.col("s.plane").alias("plane"), F.col("s.camera").alias("camera"), F.coalesce(F.transform("s.cylinders", person), F.array().cast("array<struct<cylinder: bigint, height: double, radius: double, color_index: int>>")).alias("people"),
        F.when(F.col("fault").isNull(), F.coalesce(F.flatten(F.transform("s.cylinders", numbers)), F.array().cast("array<double>"))).otherwise(F.array().cast("array<double>")).alias("_k"),
    )
    lists = T.ArrayType(T.ArrayType(T.DoubleType()))
    kept = [f for f in rows.schema.fields if not f.name.startswith("_")]
    out = T.StructType([*kept, T.StructField("us", lists), T.StructField("vs", lists)])
    chosen = list(frames)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(whole.schema.get_field_index("_ok")))
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
                people = column("people").value_lengths().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(people)))
                keys = column("_k").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
                path = np.repeat(starts[:-1], column("_k").value_lengths().to_numpy(zero_copy_only=False) // 8) + keys[:, 0].astype(np.int64)
                places = bezier_paths(path, tangents(path, keys[:, 1:]), starts[-1])[:, chosen] if len(path) else np.zeros((0, len(chosen), 2))
                nested = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), _lists(places[:, :, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[column(f.name) for f in kept], *nested], out.names)

    return rows.mapInArrow(sampled, out)


def standing_cameras(paths: DataFrame, middle: int) -> DataFrame:
    """paths (scene_paths) with origin, u, v, normal of the plane and the camera where it stands (frame_cameras' columns). middle:
    the place of frame 40 among the frames of paths."""
    zero, one = F.lit(0.0), F.lit(1.0)
    u, n = (_unit(F.coalesce(f"plane.{c}", default)) for c, default in (("u", vec.vec(one, zero, zero)), ("normal", vec.vec(zero, zero, one))))
    planes = paths.withColumns({"origin": F.coalesce("plane.origin", vec.vec(zero, zero, zero)), "u": u, "normal": n}).withColumn("v", vec.cross(F.col("normal"), F.col("u")))
    count = F.size("people")
    heights = F.array_sort(F.transform("people", lambda p: p["height"]))
    planes = planes.withColumn("h", F.when(count > 0, (F.get(heights, F.expr("(size(people) - 1) div 2").cast("int")) + F.get(heights, F.expr("size(people) div 2").cast("int"))) / 2).otherwise(1.0))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda total, x: total + F.get(x, F.lit(middle))) / count
    planes = planes.withColumns({"_a": F.when(count > 0, mean("us")), "_b": F.when(count > 0, mean("vs"))})
    aim = [F.when(count > 0, _world(k, F.col("_a"), F.col("_b")) + 0.5 * F.col("h") * vec.at(F.col("normal"), k)).otherwise(vec.at(F.col("origin"), k) + 3 * F.col("h") * vec.at(F.col("u"), k)) for k in range(3)]
    cam = lambda name, default: F.coalesce(f"camera.{name}", F.lit(default))
    yaw, pitch = F.radians(cam("yaw_deg", 0.0)), F.radians(cam("pitch_deg", 2.0))
    level = [F.cos(yaw) * vec.at(F.col("u"), k) - F.sin(yaw) * vec.at(F.col("v"), k) for k in range(3)]
    stands = planes.select(
        "scene", "people", "us", "vs", "origin", "u", "v", "normal", "h", F.array(*aim).alias("target"), vec.vec(*[F.cos(pitch) * level[k] - F.sin(pitch) * vec.at(F.col("normal"), k) for k in range(3)]).alias("_ahead"),
        vec.vec(*[vec.at(F.col("origin"), k) + cam("height", 0.69) * vec.at(F.col("normal"), k) for k in range(3)]).alias("_eye"),
        cam("focal_px", 966.0).alias("fx"), cam("focal_px", 966.0).alias("fy"), F.coalesce(F.get("camera.principal", F.lit(0)), F.lit(WIDTH / 2)).alias("cx"), F.coalesce(F.get("camera.principal", F.lit(1)), F.lit(HEIGHT / 2)).alias("cy"),
        cam("path", "static").alias("path"), F.coalesce("camera.anchor_first_frame", F.lit(False)).alias("anchored"), F.col("camera.orbit_deg").alias("orbit_deg"), F.col("camera.dolly_travel").alias("travel"),
    )
    # the world's up is the normal, so a level x axis is -normal x ahead
    stands = stands.withColumn("_z", _unit(F.col("_ahead"))).withColumn("_x", _unit(vec.cross(F.transform("normal", lambda c: -c), F.col("_z")))).withColumn("r", F.concat("_x", vec.cross(F.col("_z"), F.col("_x")), "_z"))
    return stands.withColumn("t", vec.vec(*[-sum((vec.at(F.col("r"), 3 * i + k) * vec.at(F.col("_eye"), k) for k in (1, 2)), vec.at(F.col("r"), 3 * i) * vec.at(F.col("_eye"), 0)) for i in range(3)])).drop("_ahead", "_eye", "_z", "_x")


def _world(k: int, a: Column, b: Column) -> Column:
    """A coordinate of the place a, b on the plane."""
    return vec.at(F.col("origin"), k) + a * vec.at(F.col("u"), k) + b * vec.at(F.col("v"), k)


def scene_people(documents: DataFrame) -> DataFrame:
    """scene, cylinder, height, radius, color, origin, u, v, us, vs of every cylinder: its place on the plane in each frame, its
    colour a number of the palette, by its own index or by left to right of the feet as the first frame shows them."""
    stands = standing_cameras(scene_paths(documents, range(FRAMES)), FRAMES // 2)
    kept = ["scene", "people", "us", "vs", "origin", "u", "v"]
    first = cameras_at(stands, kept, (0,))
    start = lambda c, i: F.get(F.get(c, i), F.lit(0))
    foot = lambda i: vec.project(*map(F.col, (*LENS, "r", "t")), F.array(*[_world(k, start("us", i), start("vs", i)) for k in range(3)])).u
    feet = F.array_sort(F.transform("people", lambda p, i: F.struct(foot(i).alias("u"), i.alias("i"))))
    each = first.withColumn("_order", F.transform(feet, lambda x: x["i"])).select(*kept[2:], "scene", "_order", F.posexplode("people").alias("i", "p"))
    rank = F.array_position("_order", F.col("i")).cast("int") - 1
    return each.select("scene", "p.cylinder", "p.height", "p.radius", F.pmod(F.coalesce("p.color_index", rank), F.lit(6)).alias("color"), "origin", "u", "v", F.get("us", "i").alias("us"), F.get("vs", "i").alias("vs"))


def people_positions(people: DataFrame) -> DataFrame:
    """scene, cylinder, height, radius, color, frame, x, y, z of scene_people()."""
    kept = ("scene", "cylinder", "height", "radius", "color")
    each = people.select(*kept, "origin", "u", "v", F.posexplode(F.arrays_zip("us", "vs")).alias("frame", "_p"))
    return each.select(*kept, F.col("frame").cast("long").alias("frame"), *[_world(k, F.col("_p.us"), F.col("_p.vs")).alias(c) for k, c in enumerate("xyz")])


def scene_frames(documents: DataFrame) -> DataFrame:
    """scene, frame, fx, fy, cx, cy, r, t: the camera of every frame of authored scenes."""
    stands = standing_cameras(scene_paths(documents, (FRAMES // 2,)), 0)
    return cameras_at(stands, ["scene"], range(FRAMES))


def expand_scenes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(positions, cylinders, cameras, rejects) of authored scenes (scene string, json).

    positions: scene, cylinder, frame, x, y, z; cylinders: scene, cylinder, height, radius, color (scene_people); cameras:
    scene, frame, fx, fy, cx, cy, r, t; rejects: scene, reason of those that scene_checks() or the reader turns down. A camera
    stands on the normal through the plane's origin, looks along u turned by yaw to its right and tilted down by pitch, and
    aims at the middle of the people in frame 40 or, in an empty scene, at three cells ahead. A scene is a row from its
    document to its frames: nothing is joined.
    """
    people = scene_people(documents)
    positions = people_positions(people).select("scene", "cylinder", "frame", "x", "y", "z")
    cylinders = people.select("scene", "cylinder", "height", "radius", "color")
    rejects = scene_faults(documents).where("fault is not null").select("scene", F.col("fault").alias("reason"))
    return positions, cylinders, scene_frames(documents), rejects
