"""From a clip's detections, cameras and plane to its subjects, its whole quality record, and the summary of all records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelyard.functions import vec
from reelyard.operators.ground_paths import feet_cut_fraction, grid_spacing, ground_positions, hit_frames, independent_horizon, path_jumps, subject_heights, subject_paths
from reelyard.operators.manifest import qc_flags
from reelyard.operators.tracks import left_to_right, main_subjects, median_heights
from reelyard.storage import keep


def clip_subjects(detections: DataFrame, cams: DataFrame, planes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subjects, paths) of each clip's main subjects. subjects: clip_id, track_id, height, radius, anchor_source, place (left to
    right by the first visible foot), color; paths: as subject_paths().

    detections: clip_id, track_id, frame, visible, touches_bottom, foot_u, foot_v, head_u, head_v, height_px,
    main_subject_prelim, dropped_reflection. Who is a main subject is settled before any ray is cast: reflections are out, a
    track marked as preliminary or seen often and tall enough is in. A track that the ground gives too few heights is none.
    Rays are cast once: hits, heights, subjects and paths are kept, as records and drawings read them more than once.
    """
    live = detections.where(~F.coalesce("dropped_reflection", F.lit(False)))
    prelim = live.groupBy("clip_id", "track_id").agg(F.coalesce(F.bool_or("main_subject_prelim"), F.lit(False)).alias("main_subject_prelim"))
    tall = median_heights(live.select("clip_id", "track_id", "visible", F.col("height_px").alias("height")))
    chosen = main_subjects(tall.join(prelim, ["clip_id", "track_id"])).where("main").select("clip_id", "track_id")
    seen = live.join(chosen, ["clip_id", "track_id"], "left_semi")
    hits = keep(hit_frames(seen, cams, planes.select("clip_id", "normal", "d")), "hits")
    heights = keep(subject_heights(hits), "heights")
    feet = seen.join(heights, ["clip_id", "track_id"], "left_semi").select("clip_id", "track_id", "frame", F.when(F.col("visible"), F.col("foot_u")).alias("foot_x"))
    subjects = heights.join(left_to_right(feet), ["clip_id", "track_id"])
    return keep(subjects, "subjects"), keep(subject_paths(ground_positions(hits, heights), heights), "paths")


def quality_records(planes: DataFrame, first_cams: DataFrame, subjects: DataFrame, paths: DataFrame, expected: DataFrame, horizons: DataFrame) -> DataFrame:
    """The whole quality record of each clip, rounded; a clip with an error has that, its id and training_ready = false alone.

    planes: clip_id, normal, d, inlier_ratio, angle_deg, normal_agreement, camera_height, plane_ok, ground_ok, error;
    first_cams: clip_id, fx, fy, cx, cy, r (of frame 0); expected: clip_id, expected_persons; horizons: clip_id, horizon (of
    another method). Every join is by clip, so one partitioning of the clips serves them all."""
    y = vec.horizon_y(F.col("fy"), F.col("cx"), F.col("cy"), F.col("fx"), F.col("r"), F.col("normal"), F.col("cx"))
    rows = planes.join(first_cams.select("clip_id", "fx", "fy", "cx", "cy", "r"), "clip_id", "left").withColumn("horizon", y).drop("fx", "fy", "cx", "cy", "r")
    moved = path_jumps(paths, subjects).groupBy("clip_id").agg(F.count_if(F.col("jumps") > 0).alias("jumps"))
    found = subjects.groupBy("clip_id").agg(F.count(F.lit(1)).alias("subjects"), F.when(F.bool_or(F.col("anchor_source") == "clip"), "clip").otherwise("anchor").alias("anchor_source"))
    for more in (found, moved, feet_cut_fraction(paths), grid_spacing(subjects, planes), expected.select("clip_id", "expected_persons")):
        rows = rows.join(more, "clip_id", "left")
    rows = rows.join(horizons.select("clip_id", F.col("horizon").alias("_said")), "clip_id", "left")
    rows = independent_horizon(rows, horizons).withColumns({"subjects": F.coalesce("subjects", F.lit(0)), "jumps": F.coalesce("jumps", F.lit(0)), "feet_cut": F.coalesce("feet_cut", F.lit(0.0))})
    flagged, good = qc_flags(rows), F.col("error").isNull()
    value = lambda c: F.when(good, c)
    return flagged.select(
        "clip_id", "error", value(F.col("expected_persons")).alias("expected_persons"), value(F.col("subjects")).alias("main_subjects_final"), value(F.coalesce(F.col("expected_persons") == F.col("subjects"), F.lit(False))).alias("count_match_final"),
        value(F.col("plane_ok")).alias("plane_ok"), value(F.round("inlier_ratio", 3)).alias("inlier_ratio"), value(F.round("angle_deg", 1)).alias("normal_angle_deg"), value(F.round("normal_agreement", 3)).alias("normal_agreement"),
        value(F.round("horizon", 1)).alias("horizon_y_frame0"), value(F.round("cam_ratio", 2)).alias("cam_height_ratio"), value(F.round("_said", 1)).alias("horizon_y_other"), value(F.round("horizon_diff", 1)).alias("horizon_diff_px"),
        value(F.round("feet_cut", 3)).alias("feet_cut_later_frac"), value(F.round("grid_spacing", 3)).alias("grid_spacing"), value(F.col("hard_flags")).alias("hard_flags"), value(F.col("soft_flags")).alias("soft_flags"), (good & F.col("training_ready")).alias("training_ready"),
    )


def flag_report(records: DataFrame) -> DataFrame:
    """figure, clips: how many records, errors, clips ready, ready if a count mismatch were soft, of each hard and soft flag, of
    each difference found - expected among the mismatches, with an inlier ratio under 0.5, a camera under 0.4 of the people's
    height (0 counts as unknown), a horizon over 60 pixels off. One pass: records become the figures that they count for and
    are added up before the shuffle. Records with an error count as such and for nothing else."""
    good, hard, soft = F.col("error").isNull(), F.coalesce("hard_flags", F.array().cast("array<string>")), F.coalesce("soft_flags", F.array().cast("array<string>"))
    mismatch = F.array_contains(hard, "count_mismatch")

    def if_(when: Column, name: Column | str) -> Column:
        return F.when(when, F.lit(name) if isinstance(name, str) else name)

    ratio = F.when(F.coalesce("cam_height_ratio", F.lit(0.0)) == 0, 1.0).otherwise(F.col("cam_height_ratio"))
    figures = [
        if_(good, "records"), if_(~good, "errors"), if_(good & F.col("training_ready"), "ready"), if_(good & (F.size(F.array_except(hard, F.array(F.lit("count_mismatch")))) == 0), "ready_if_count_soft"),
        if_(good & mismatch, F.concat(F.lit("found_minus_expected:"), (F.col("main_subjects_final") - F.col("expected_persons")).cast("string"))),
        if_(good & (F.col("inlier_ratio") < 0.5), "inliers_below_half"), if_(good & (ratio < 0.4), "low_camera"), if_(good & (F.coalesce("horizon_diff_px", F.lit(0.0)) > 60), "horizon_far"),
    ]
    flags = F.concat(F.transform(hard, lambda f: F.concat(F.lit("hard:"), f)), F.transform(soft, lambda f: F.concat(F.lit("soft:"), f)))
    named = F.concat(F.array_compact(F.array(*figures)), F.when(good, flags).otherwise(F.array().cast("array<string>")))
    return records.select(F.explode(named).alias("figure")).groupBy("figure").agg(F.count(F.lit(1)).alias("clips"))
