"""Keyframe cameras: brackets of frames, nearest keyframe, motion of the camera."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelyard.functions.vec import at, cam_center, norm, rotation_angle, sub


def bracket_keyframes(frames: DataFrame, cams: DataFrame) -> DataFrame:
    """clip_id, frame, kf0, kf1, w: the keyframes around each frame and its place between them, clamped to the ends."""
    by = Window.partitionBy("clip_id").orderBy("frame")
    ranges = cams.select("clip_id", F.col("kf").alias("kf0"), F.col("frame").alias("f0"), F.lead("kf").over(by).alias("kf1"), F.lead("frame").over(by).alias("f1"), F.row_number().over(by).alias("_n"))
    low = F.when(F.col("_n") == 1, F.lit(-(1 << 30))).otherwise(F.col("f0"))
    ranges = ranges.withColumns({"_low": low, "_high": F.coalesce("f1", F.lit(1 << 30))})
    met = frames.join(ranges, "clip_id").where("frame >= _low and frame < _high")
    w = F.when(F.col("kf1").isNull() | (F.col("frame") <= F.col("f0")), 0.0).otherwise((F.col("frame") - F.col("f0")) / (F.col("f1") - F.col("f0")))
    return met.select("clip_id", "frame", "kf0", F.coalesce("kf1", "kf0").alias("kf1"), w.alias("w"))


def nearest_keyframe(frames: DataFrame, cams: DataFrame) -> DataFrame:
    """clip_id, frame, kf of the nearest keyframe, the lower one of two as near.

    A clip's frames and keyframes come together in one row each, in which every frame finds its keyframe."""
    asked = frames.groupBy("clip_id").agg(F.collect_set(F.struct("frame")).alias("_f"))
    shots = cams.groupBy("clip_id").agg(F.collect_list(F.struct("kf", F.col("frame").alias("kf_frame"))).alias("_k"))
    nearest = lambda f: F.array_min(F.transform("_k", lambda k: F.struct(F.abs(f["frame"] - k["kf_frame"]).alias("far"), k["kf"].alias("kf"))))["kf"]
    return asked.join(shots, "clip_id").select("clip_id", F.inline(F.transform("_f", lambda f: F.struct(f["frame"].alias("frame"), nearest(f).alias("kf")))))


def camera_centers(cams: DataFrame) -> DataFrame:
    return cams.withColumn("center", cam_center(F.col("r"), F.col("t")))


def interpolated_centers(frames: DataFrame, cams: DataFrame) -> DataFrame:
    """clip_id, frame, x, y, z: the camera's centre, linear between keyframes."""
    centers = camera_centers(cams).select("clip_id", "kf", "center")
    ends = bracket_keyframes(frames, cams)
    for k in ("0", "1"):
        ends = ends.join(centers.select("clip_id", F.col("kf").alias(f"kf{k}"), F.col("center").alias(f"c{k}")), ["clip_id", f"kf{k}"])
    return ends.select("clip_id", "frame", *[(at(F.col("c0"), i) * (1 - F.col("w")) + at(F.col("c1"), i) * F.col("w")).alias("xyz"[i]) for i in range(3)])


def slerp(r0: np.ndarray, r1: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rotations between r0 and r1 (n, 3, 3) at w, along the shortest turn; of a half turn, about the axis that it keeps."""
    turn = r1 @ r0.transpose(0, 2, 1)
    angle = np.arccos(np.clip((np.trace(turn, axis1=1, axis2=2) - 1) / 2, -1, 1))
    axis = np.stack([turn[:, 2, 1] - turn[:, 1, 2], turn[:, 0, 2] - turn[:, 2, 0], turn[:, 1, 0] - turn[:, 0, 1]], axis=1)
    # near a half turn the antisymmetric part fades: the axis is then the greatest column of (turn + turn') / 2 - cos I
    square = (turn + turn.transpose(0, 2, 1)) / 2 - np.cos(angle)[:, None, None] * np.eye(3)
    kept = square[np.arange(len(w)), :, np.argmax(np.einsum("nii->ni", square), axis=1)]
    kept *= np.where(np.einsum("ni,ni->n", kept, axis) < 0, -1.0, 1.0)[:, None]
    axis = np.where((angle > 3.0)[:, None], kept, axis)
    axis /= np.maximum(np.linalg.norm(axis, axis=1), 1e-12)[:, None]
    x, y, z = axis.T
    o = np.zeros_like(x)
    k = np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)
    theta = angle * w
    return (np.eye(3) + np.sin(theta)[:, None, None] * k + (1 - np.cos(theta))[:, None, None] * (k @ k)) @ r0


LENS = ("fx", "fy", "cx", "cy")


def interpolate_cams(cams: DataFrame, frames: int = 81) -> DataFrame:
    """clip_id, frame (0 .. frames - 1), fx, fy, cx, cy, r, t of keyframe cameras (clip_id, frame, fx, fy, cx, cy, r, t): the
    centre goes straight and the rotation along the shortest turn between the two keyframes around a frame, both are held
    before the first and after the last; the lens is that of the nearest keyframe, the earlier of two as near.

    A clip's keyframes (some ten) come together in one row, in which every frame finds its bracket, so cameras move once, by
    clip; the turns are worked out on whole batches."""
    shots = F.array_sort(F.collect_list(F.struct("frame", *LENS, "r", "t"))).alias("_k")
    rows = cams.groupBy("clip_id").agg(shots).select("clip_id", "_k", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    low = F.greatest(F.size(F.filter("_k", lambda k: k.frame <= F.col("frame"))) - 1, F.lit(0))
    high = F.when(F.col("frame") < F.get("_k", F.lit(0)).frame, low).otherwise(F.least(low + 1, F.size("_k") - 1))
    near = F.array_min(F.transform("_k", lambda k, i: F.struct(F.abs(k.frame - F.col("frame")).alias("far"), i.alias("i")))).i
    met = rows.select("clip_id", "frame", F.get("_k", low).alias("a"), F.get("_k", high).alias("b"), F.get("_k", near).alias("n"))
    span = F.col("b.frame") - F.col("a.frame")
    w = F.when((span <= 0) | (F.col("frame") <= F.col("a.frame")), 0.0).otherwise((F.col("frame") - F.col("a.frame")) / span)
    ends = met.select("clip_id", "frame", *[F.col(f"n.{c}").cast("double").alias(c) for c in LENS], *[F.col(f"{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "rt"], w.alias("w"))
    kept = ["clip_id", "frame", *LENS]
    out = T.StructType([*ends.select(*kept).schema.fields, T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.DoubleType()))])

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r0, r1 = (np.stack(b[c].to_list()).reshape(-1, 3, 3) for c in ("r0", "r1"))
                c0, c1 = (-np.einsum("nij,ni->nj", r, np.stack(b[c].to_list())) for r, c in ((r0, "t0"), (r1, "t1")))
                w = b["w"].to_numpy()
                r = slerp(r0, r1, w)
                t = -np.einsum("nij,nj->ni", r, c0 + (c1 - c0) * w[:, None])
                yield b[kept].assign(r=list(r.reshape(-1, 9)), t=list(t))

    return ends.mapInPandas(between, out)


def camera_motion(cams: DataFrame, planes: DataFrame) -> DataFrame:
    """clip_id, path (in grid cells; a spacing of 0 or null counts as 1), rot_deg (greatest turn from the first keyframe),
    static: path < 0.25 and rot < 3."""
    by = Window.partitionBy("clip_id").orderBy("kf")
    moved = camera_centers(cams).withColumns({"step": norm(sub(F.col("center"), F.lag("center").over(by))), "turn": rotation_angle(F.first("r").over(by), F.col("r"))})
    total = moved.groupBy("clip_id").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("_path"), F.max("turn").alias("rot_deg"))
    cell = F.when(F.coalesce("grid_spacing", F.lit(0.0)) == 0, 1.0).otherwise(F.col("grid_spacing"))
    out = total.join(planes.select("clip_id", "grid_spacing"), "clip_id").withColumn("path", F.col("_path") / cell)
    return out.select("clip_id", "path", "rot_deg", ((F.col("path") < 0.25) & (F.col("rot_deg") < 3)).alias("static"))


def camera_path_table(frames: DataFrame, cams: DataFrame, fits: DataFrame) -> DataFrame:
    """fits (clip_id, median_depth, ...) with path_depth: the length of the camera's path over the frames in median depths."""
    by = Window.partitionBy("clip_id").orderBy("frame")
    centers = interpolated_centers(frames, cams).select("clip_id", "frame", F.array("x", "y", "z").alias("c"))
    steps = centers.withColumn("step", norm(sub(F.col("c"), F.lag("c").over(by))))
    lengths = steps.groupBy("clip_id").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("_length"))
    return fits.join(lengths, "clip_id").withColumn("path_depth", F.try_divide("_length", "median_depth")).drop("_length")


def moving_share(motion: DataFrame) -> DataFrame:
    """label, clips, moving_pct of each label and, with a null label, of all."""
    return motion.rollup("label").agg(F.count(F.lit(1)).alias("clips"), F.round(100 * F.avg((~F.col("static")).cast("double")), 4).alias("moving_pct"))
