"""From detections to smooth paths on the ground, and the quality record of a clip that follows from them.

Detections have clip_id, track_id, frame, visible, touches_bottom, foot_u, foot_v, head_u, head_v, height_px. Cameras have clip_id,
frame, fx, fy, cx, cy, r, t (world to camera); planes clip_id, normal, d with normal . x + d = 0 and the normal up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelyard.functions import vec
from reelyard.operators.manifest import qc_flags
from reelyard.operators.tracks import filled, smoothed

ANCHOR_FRAMES = 16
FRAMES = 81
PALETTE = 6


def hit_frames(detections: DataFrame, cams: DataFrame, planes: DataFrame) -> DataFrame:
    """Each visible detection (clip_id, track_id, frame) with foot: where its frame's camera's ray through its foot meets its clip's
    plane, null if the feet are cut off or the ray misses; size: its height in the world at the foot; head: the unit ray
    through its head, if the feet are cut off; centre: the camera's; and normal, d of the plane.

    Vectors are worked out component by component in plain columns, each step once a row, and only what heights and
    positions read stays."""
    seen = detections.where("visible").join(cams, ["clip_id", "frame"]).join(planes.select("clip_id", "normal", "d"), "clip_id")
    kept = ["clip_id", "track_id", "frame", "touches_bottom", "height_px", "fy", "normal", "d"]
    r, t = ([vec.at(F.col(c), i) for i in range(n)] for c, n in (("r", 9), ("t", 3)))
    seen = seen.withColumn("centre", vec.cam_center(F.col("r"), F.col("t")))

    def toward(end: str) -> dict[str, Column]:
        x, y = (F.col(f"{end}_u") - F.col("cx")) / F.col("fx"), (F.col(f"{end}_v") - F.col("cy")) / F.col("fy")
        return {f"_{end}{i}": r[i] * x + r[3 + i] * y + r[6 + i] for i in range(3)}

    rays = seen.select(*kept, "centre", "foot_u", F.array(*r[6:], t[2]).alias("_deep"), *[c.alias(n) for end in ("foot", "head") for n, c in toward(end).items()])
    parts = {end: [F.col(f"_{end}{i}") for i in range(3)] for end in ("foot", "head")}
    long = {end: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias(f"_{end}") for end, v in parts.items()}
    units = rays.select(*kept, "centre", "foot_u", "_deep", *[c for v in parts.values() for c in v], *long.values())
    units = units.select(*kept, "centre", "foot_u", "_deep", *[(c / F.col(f"_{end}")).alias(f"_{end}{i}") for end, v in parts.items() for i, c in enumerate(v)])
    normal, centre = ([vec.at(F.col(c), i) for i in range(3)] for c in ("normal", "centre"))
    met = units.withColumn("_along", normal[0] * parts["foot"][0] + normal[1] * parts["foot"][1] + normal[2] * parts["foot"][2])
    met = met.withColumn("_far", F.when(~F.col("touches_bottom") & F.col("foot_u").isNotNull() & (F.abs("_along") >= 1e-9), -(vec.dot(F.col("normal"), F.col("centre")) + F.col("d")) / F.col("_along")))
    met = met.withColumn("foot", F.when(F.col("_far") > 0, F.array(*[centre[i] + F.col("_far") * parts["foot"][i] for i in range(3)])))
    foot, deep = ([vec.at(F.col(c), i) for i in range(n)] for c, n in (("foot", 3), ("_deep", 4)))
    depth = deep[0] * foot[0] + deep[1] * foot[1] + deep[2] * foot[2] + deep[3]
    head = F.when(F.col("touches_bottom"), F.array(*parts["head"]))
    return met.select("clip_id", "track_id", "frame", "touches_bottom", "foot", (F.col("height_px") * depth / F.col("fy")).alias("size"), head.alias("head"), "centre", "normal", "d")


def subject_heights(hits: DataFrame) -> DataFrame:
    """clip_id, track_id, height, radius, anchor_source: the median of pixel height times depth over focal length, over the
    first 16 frames, or over all frames where fewer than 4 of these hit the ground; tracks with fewer than 3 hits drop out."""
    size, early = F.col("size"), F.col("frame") < ANCHOR_FRAMES
    grouped = hits.where("foot is not null").groupBy("clip_id", "track_id").agg(
        F.count_if(early).alias("_early"), F.count(F.lit(1)).alias("_all"), F.percentile(F.when(early, size), F.lit(0.5)).alias("_anchor"), F.percentile(size, F.lit(0.5)).alias("_clip")
    )
    anchored = F.col("_early") >= 4
    sized = grouped.where(anchored | (F.col("_all") >= 3)).select("clip_id", "track_id", F.when(anchored, F.col("_anchor")).otherwise(F.col("_clip")).alias("height"), F.when(anchored, "anchor").otherwise("clip").alias("anchor_source"))
    return sized.withColumn("radius", 0.2 * F.col("height"))


def ground_positions(hits: DataFrame, heights: DataFrame) -> DataFrame:
    """clip_id, track_id, frame, x, y, z, method, feet_visible of the subjects' visible frames: the foot's hit, or, with cut
    feet, the point of the head's ray at the subject's height over the plane, dropped to the plane; else no position."""
    rows = hits.join(heights.select("clip_id", "track_id", "height"), ["clip_id", "track_id"])
    along, above = vec.dot(F.col("normal"), F.col("head")), vec.dot(F.col("normal"), F.col("centre")) + F.col("d")
    rows = rows.withColumn("_along", along).withColumn("_far", (F.col("height") - above) / F.when(F.abs("_along") > 1e-9, F.col("_along")))
    rows = rows.withColumn("_dropped", F.col("touches_bottom") & F.coalesce(F.col("_far") > 0, F.lit(False)))
    dropped = [vec.at(F.col("centre"), i) + F.col("_far") * vec.at(F.col("head"), i) - F.col("height") * vec.at(F.col("normal"), i) for i in range(3)]
    on_foot = F.col("foot").isNotNull()
    place = [F.when(on_foot, vec.at(F.col("foot"), i)).when(F.col("_dropped"), dropped[i]) for i in range(3)]
    method = F.when(on_foot, "foot_ray").when(F.col("_dropped"), "head_ray").otherwise("")
    return rows.select("clip_id", "track_id", "frame", *[p.alias(c) for p, c in zip(place, "xyz", strict=True)], method.alias("method"), on_foot.alias("feet_visible"))


def subject_paths(positions: DataFrame, heights: DataFrame, frames: int = FRAMES) -> DataFrame:
    """clip_id, track_id, frame (0 .. frames - 1), x, y, z (gaps filled, then smoothed), method, feet_visible, interpolated.

    Subjects without any position have no path. A subject's positions come together in one row, which is turned into its path
    where it is."""
    seen = positions.join(heights.select("clip_id", "track_id"), ["clip_id", "track_id"], "left_semi").where(F.col("frame").between(0, frames - 1))
    each = F.struct(F.col("frame").cast("int").alias("frame"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce("method", F.lit("")).alias("method"), F.coalesce("feet_visible", F.lit(False)).alias("feet_visible"))
    rows = seen.groupBy("clip_id", "track_id").agg(F.collect_list(each).alias("_p"))
    plain = {"frame": T.IntegerType(), "x": T.DoubleType(), "y": T.DoubleType(), "z": T.DoubleType(), "method": T.StringType(), "feet_visible": T.BooleanType(), "interpolated": T.BooleanType()}
    out = T.StructType([*rows.select("clip_id", "track_id").schema.fields, *[T.StructField(n, t) for n, t in plain.items()]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                found, n = b.column(2), b.num_rows
                frame, *axes, methods, feet = found.flatten().flatten()
                place = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False)) * frames + frame.to_numpy(zero_copy_only=False)
                columns, known = [], None
                for axis in axes:
                    values, known = np.zeros(n * frames), np.zeros(n * frames, bool)
                    values[place], known[place] = axis.to_numpy(zero_copy_only=False), axis.is_valid().to_numpy(zero_copy_only=False)
                    known = known.reshape(n, frames)
                    columns.append(smoothed(filled(values.reshape(n, frames), known)))
                method, visible = np.full(n * frames, "", object), np.zeros(n * frames, bool)
                method[place], visible[place] = methods.to_numpy(zero_copy_only=False), feet.to_numpy(zero_copy_only=False)
                on_ground = np.zeros(n, bool)
                on_ground[place[axes[0].is_valid().to_numpy(zero_copy_only=False)] // frames] = True
                kept = np.flatnonzero(np.repeat(on_ground, frames))
                track = pa.array(kept // frames)
                rest = [pa.array((kept % frames).astype(np.int32)), *[pa.array(c.ravel()[kept]) for c in columns], pa.array(method[kept], pa.string()), pa.array(visible[kept]), pa.array(~known.ravel()[kept])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(track), b.column(1).take(track), *rest], out.names)

    return rows.mapInArrow(made, out)


def path_jumps(paths: DataFrame, heights: DataFrame) -> DataFrame:
    """clip_id, track_id, jumps: smoothed steps, in all three axes, longer than the subject's height."""
    by = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(by), 2) for c in "yz"), F.pow(F.col("x") - F.lag("x").over(by), 2)))
    steps = paths.withColumn("_step", step).join(heights.select("clip_id", "track_id", "height"), ["clip_id", "track_id"])
    return steps.groupBy("clip_id", "track_id").agg(F.count_if(F.col("_step") > F.col("height")).alias("jumps"))


def feet_cut_fraction(paths: DataFrame, since: int = ANCHOR_FRAMES) -> DataFrame:
    """clip_id, feet_cut: the share of subjects' frames from `since` on without visible feet; clips without any have no row."""
    later = F.when(F.col("frame") >= since, (~F.col("feet_visible")).cast("double"))
    return paths.groupBy("clip_id").agg(F.coalesce(F.avg(later), F.lit(0.0)).alias("feet_cut"))


def grid_spacing(heights: DataFrame, planes: DataFrame) -> DataFrame:
    """clip_id, grid_spacing, cam_ratio: the median subject height (else a third of camera_height) and camera_height over it."""
    middle = heights.groupBy("clip_id").agg(F.percentile("height", F.lit(0.5)).alias("_h"))
    joined = planes.select("clip_id", "camera_height").join(middle, "clip_id", "left")
    return joined.select("clip_id", F.coalesce("_h", F.col("camera_height") / 3).alias("grid_spacing"), (F.try_divide("camera_height", "_h")).alias("cam_ratio"))


def plane_extent(points: DataFrame, frames: DataFrame, cells: float = 2.0) -> DataFrame:
    """clip_id, u0, u1, v0, v1, us, vs, zmin: the ground that a clip's points (clip_id, x, y, z) cover in the plane's frame
    (clip_id, origin, u, v, grid_spacing) and `cells` grid cells around, and the places of the grid's lines, at multiples of
    the spacing, one that is off the end by rounding alone counted in; zmin is 0.05 of the clip's median depth
    where frames has median_depth (measured clips), else of the spacing. Take 2 cells around a plane's inliers, 6 around subjects and the camera."""
    s, measured = F.col("grid_spacing"), "median_depth" in frames.columns
    frames = frames.withColumn("_near", 0.05 * (F.coalesce("median_depth", "grid_spacing") if measured else s))
    d = vec.sub(F.array("x", "y", "z"), F.col("origin"))
    seen = points.join(frames.select("clip_id", "origin", "u", "v", "grid_spacing", "_near"), "clip_id").select("clip_id", "grid_spacing", "_near", vec.dot(d, F.col("u")).alias("pu"), vec.dot(d, F.col("v")).alias("pv"))
    ends = seen.groupBy("clip_id", "grid_spacing", "_near").agg(*[(f(f"p{k}") + sign * cells * s).alias(f"{k}{i}") for k in "uv" for i, (f, sign) in enumerate(((F.min, -1), (F.max, 1)))])

    def lines(k: str) -> Column:
        start = F.floor(F.col(f"{k}0") / s + 1e-9)
        n = F.ceil((F.col(f"{k}1") + 1e-9 - start * s) / s)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: start * s + i * s).alias(f"{k}s")

    return ends.select("clip_id", "u0", "u1", "v0", "v1", lines("u"), lines("v"), F.col("_near").alias("zmin"))


def independent_horizon(qc: DataFrame, horizons: DataFrame) -> DataFrame:
    """qc with horizon_diff: the distance of its horizon row to that of another method, null unless both are known."""
    joined = qc.join(horizons.select("clip_id", F.col("horizon").alias("_other")), "clip_id", "left")
    return joined.withColumn("horizon_diff", F.abs(F.col("horizon") - F.col("_other"))).drop("_other")


def clip_qc(planes: DataFrame, heights: DataFrame, paths: DataFrame, expected: DataFrame, horizons: DataFrame) -> DataFrame:
    """One quality record a clip, rounded, with its flags; a clip whose plane has an error gives a row with the error alone.

    planes: clip_id, plane_ok, ground_ok, camera_height, horizon, error; expected: clip_id, expected_persons."""
    moved = path_jumps(paths, heights).groupBy("clip_id").agg(F.count_if(F.col("jumps") > 0).alias("jumps"))
    found = heights.groupBy("clip_id").agg(F.count(F.lit(1)).alias("subjects"), F.when(F.bool_or(F.col("anchor_source") == "clip"), "clip").otherwise("anchor").alias("anchor_source"))
    rows = planes.select("clip_id", "plane_ok", "ground_ok", "horizon", "error")
    for more in (found, moved, feet_cut_fraction(paths), grid_spacing(heights, planes), expected):
        rows = rows.join(more, "clip_id", "left")
    rows = independent_horizon(rows, horizons).withColumns({"subjects": F.coalesce("subjects", F.lit(0)), "jumps": F.coalesce("jumps", F.lit(0)), "feet_cut": F.coalesce("feet_cut", F.lit(0.0))})
    flagged = qc_flags(rows)
    good, none = F.col("error").isNull(), F.array().cast("array<string>")
    figures = {c: F.when(good, F.round(c, n)) for c, n in (("feet_cut", 3), ("cam_ratio", 2), ("grid_spacing", 3), ("horizon_diff", 1))}
    return flagged.withColumns(figures | {"subjects": F.when(good, F.col("subjects")), "hard_flags": F.when(good, F.col("hard_flags")).otherwise(none), "soft_flags": F.when(good, F.col("soft_flags")).otherwise(none), "training_ready": good & F.col("training_ready")}).select(
        "clip_id", "error", "expected_persons", "subjects", "grid_spacing", "cam_ratio", "feet_cut", "horizon_diff", "hard_flags", "soft_flags", "training_ready"
    )


def painter_order(paths: DataFrame, cams: DataFrame) -> DataFrame:
    """clip_id, frame, track_id, order: subjects of a frame from the farthest from the camera to the nearest."""
    centre = vec.cam_center(F.col("r"), F.col("t"))
    away = paths.join(cams.select("clip_id", "frame", centre.alias("_c")), ["clip_id", "frame"]).withColumn("_far", F.round(vec.norm(vec.sub(F.array("x", "y", "z"), F.col("_c"))), 6))
    place: Column = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy(F.col("_far").desc(), "track_id"))
    return away.select("clip_id", "frame", "track_id", place.alias("order"))
