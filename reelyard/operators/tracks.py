"""Detections of people: heights, main subjects, gaps, smoothing, jumps, order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median_heights(detections: DataFrame) -> DataFrame:
    """clip_id, track_id, height (the upper median of positive heights in visible frames), visible_frames."""
    good = F.col("visible") & (F.col("height") > 0)
    grouped = detections.groupBy("clip_id", "track_id").agg(F.array_sort(F.collect_list(F.when(good, F.col("height")))).alias("_h"), F.count_if("visible").alias("visible_frames"))
    return grouped.select("clip_id", "track_id", F.get("_h", F.floor(F.size("_h") / 2).cast("int")).alias("height"), "visible_frames")


def main_subjects(heights: DataFrame) -> DataFrame:
    """heights with clip_max and main: prelim, or visible in 40 frames and of max(72, 0.4 * clip_max) pixels at least."""
    top = heights.withColumn("clip_max", F.max("height").over(Window.partitionBy("clip_id")))
    big = (F.col("visible_frames") >= 40) & (F.col("height") >= F.greatest(F.lit(72.0), 0.4 * F.col("clip_max")))
    return top.withColumn("main", F.coalesce(F.col("main_subject_prelim") | big, F.lit(False)))


def fill_gaps(path: DataFrame, value: str = "x") -> DataFrame:
    """Frames without a value take a linear interpolation, flat at both ends; interpolated says which."""
    by = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(value).alias("v")))
    near = path.withColumns({"_b": F.last(known, ignorenulls=True).over(back), "_a": F.first(known, ignorenulls=True).over(ahead)})
    w = (F.col("frame") - F.col("_b.f")) / (F.col("_a.f") - F.col("_b.f"))
    between = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col("_a.f") == F.col("_b.f")), F.col("_b.v")).otherwise(F.col("_b.v") + w * (F.col("_a.v") - F.col("_b.v")))
    return near.withColumns({"interpolated": F.col(value).isNull(), value: between}).drop("_a", "_b")


def gaussian(sigma: float = 2.0) -> list[float]:
    """Weights of the frames around one, out to 4 sigma."""
    reach = int(4 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def filled(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Tracks' values (n, frames) with a linear interpolation, flat at both ends, where they aren't known; nan in tracks without any."""
    n, frames = values.shape
    at = np.arange(frames)
    before = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(known, at, frames)[:, ::-1], axis=1)[:, ::-1]
    last, first = (np.take_along_axis(values, np.clip(x, 0, frames - 1), axis=1) for x in (before, after))
    w = (at - before) / np.maximum(after - before, 1)
    out = np.where(before < 0, first, np.where((after >= frames) | (after == before), last, last + w * (first - last)))
    return np.where(known.any(axis=1)[:, None], out, np.nan)


def smoothed(values: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Tracks' values (n, frames) after a Gaussian over frames, edge values repeated."""
    kernel = gaussian(sigma)
    reach, frames = len(kernel) // 2, values.shape[1]
    out = np.zeros(values.shape)
    for k, weight in enumerate(kernel):
        out += values[:, np.clip(np.arange(frames) + k - reach, 0, frames - 1)] * weight
    return out


def smooth_columns(path: DataFrame, values: list[str], sigma: float = 2.0) -> DataFrame:
    """clip_id, track_id, frame and the values after a Gaussian over frames out to 4 sigma, edge values repeated, in one pass
    over an array for each track."""
    kernel = gaussian(sigma)
    reach = len(kernel) // 2
    rows = path.groupBy("clip_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", *values))).alias("_p"))
    last = F.size("_p") - 1

    def near(i, k):
        return F.get(F.col("_p"), F.greatest(F.lit(0), F.least(last, i + k)).cast("int"))

    def smooth(p, i):
        rows_ = [near(i, k) for k in range(-reach, reach + 1)]
        return F.struct(p.frame.alias("frame"), *[sum((rows_[j][v] * F.lit(kernel[j]) for j in range(1, len(kernel))), rows_[0][v] * F.lit(kernel[0])).alias(v) for v in values])

    return rows.select("clip_id", "track_id", F.explode(F.transform(F.col("_p"), smooth)).alias("s")).select("clip_id", "track_id", "s.frame", *[f"s.{v}" for v in values])


def smooth_path(path: DataFrame, value: str = "x", sigma: float = 2.0) -> DataFrame:
    """smooth_columns of one value, as column smooth."""
    return smooth_columns(path, [value], sigma).withColumnRenamed(value, "smooth")


def track_jumps(path: DataFrame, heights: DataFrame, value: str = "smooth") -> DataFrame:
    """clip_id, track_id, jumps: steps between frames longer than the subject's height."""
    by = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    steps = path.withColumn("_step", F.abs(F.col(value) - F.lag(value).over(by))).join(heights.select("clip_id", "track_id", "height"), ["clip_id", "track_id"])
    return steps.groupBy("clip_id", "track_id").agg(F.count_if(F.col("_step") > F.col("height")).alias("jumps"))


def left_to_right(feet: DataFrame) -> DataFrame:
    """clip_id, track_id, place, color: rank by x of the first visible foot (0 if none), colour the rank modulo 6."""
    first = feet.groupBy("clip_id", "track_id").agg(F.coalesce(F.min_by("foot_x", F.when(F.col("foot_x").isNotNull(), F.col("frame"))), F.lit(0.0)).alias("_x"))
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy("_x", "track_id")) - 1
    return first.withColumn("place", place).select("clip_id", "track_id", "place", (F.col("place") % 6).alias("color"))


def keep_frames(frames: DataFrame) -> DataFrame:
    """24 to 16 frames a second: every third source frame goes, the first 81 stay, renumbered."""
    number = F.expr("2 * (frame div 3) + frame % 3")
    return frames.where("frame % 3 <> 2").withColumn("kept", number).where("kept < 81")
