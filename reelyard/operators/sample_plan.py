"""A deterministic plan of what a training epoch reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelyard.operators.decks import stratum_rank
from reelyard.operators.rank import global_rank, hash01, hash_key


def repeat_videos(meta: DataFrame, n: int) -> DataFrame:
    """Images once, then videos n times (n > 0), with the row's position."""
    copies = meta.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("type") == "image", 1).otherwise(n))))
    return global_rank(copies, (F.col("type") != "image").cast("int"), F.col("copy"), F.col("id"), rank="position")


def frame_plan(meta: DataFrame, count: int, start: float, end: float, stride: int, least: int, seed=0) -> DataFrame:
    """id, frames, error: min(count, floor(length * (end - start) / stride)) frames, evenly spaced over a run of the leading
    floor(end * length) frames, which starts by a seeded draw at floor(start * that) at least. No frames and fewer than
    `least` are errors of their own."""
    n = F.least(F.lit(count), F.floor(F.col("length") * (end - start) / stride)).cast("int")
    total = F.floor(F.col("length") * end)
    run = F.least(total, (n - 1) * stride + 1)
    low, high = F.floor(total * start), total - run
    first = F.when(total == run, 0).otherwise(F.least(low, high) + F.floor(hash01(hash_key(seed, "start", "id")) * (F.greatest(high - low, F.lit(0)) + 1)))
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (first + F.floor(i * (run - 1) / F.greatest(n - 1, F.lit(1)))).cast("long"))
    bad = F.when(n < 1, F.lit("no frames")).when(n < least, F.lit("too short"))
    return meta.select("id", F.when(bad.isNull(), frames).alias("frames"), bad.alias("error"))


def caption_dropout(plan: DataFrame, p: float, seed=0, epoch: int = 0) -> DataFrame:
    return plan.withColumn("text", F.when(hash01(hash_key(f"{seed}.{epoch}", "drop", "id")) < p, "").otherwise(F.col("text")))


def bucket_batches(plan: DataFrame, size: int, seed=0) -> DataFrame:
    """type, batch, ids, position: rows in seeded order fill batches of their type; a broken last batch isn't emitted; a
    batch's position is that of its last member."""
    ordered = global_rank(plan.select("id", "type", hash_key(seed, "order", "id").alias("_h")), F.col("_h"), F.col("id"), rank="position")
    ranked = stratum_rank(ordered, ["type"], [F.col("_h"), F.col("id")], "_r").withColumn("batch", F.expr(f"_r div {size}"))
    full = ranked.groupBy("type", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("m")).where(F.size("m") == size)
    return full.select("type", "batch", F.transform("m", lambda x: x.id).alias("ids"), F.element_at("m", -1).position.alias("position"))


def token_budget_frames(batches: DataFrame, sizes: list[int], base: int, budget: int, n_frames: int = 81, step: int = 4, seed=0) -> DataFrame:
    """batch, size, frames of batches (batch, shortest: frames of the shortest clip, side: the least mean side of a clip's
    frames, null: unknown).

    A batch may take the sizes under 1.25 sides, all where there is none. With probability 0.50 it takes the one nearest to
    base, else one of the others, evenly. A size allows min(budget / size**2, n_frames) frames, cut to a multiple of step and
    one more; the shortest clip caps that, cut again to the form step * k + 1, and 1 is the least."""
    listed = F.array(*map(F.lit, sizes))
    fits = F.filter(listed, lambda x: x < 1.25 * F.coalesce(F.col("side"), F.lit(float("inf"))))
    rows = batches.select("batch", "shortest", F.when(F.size(fits) == 0, listed).otherwise(fits).alias("_choices"))
    nearest = F.array_min(F.transform("_choices", lambda x, i: F.struct(F.abs(x - base).alias("far"), i.alias("i"), x.alias("x")))).x
    rows = rows.withColumn("_near", nearest).withColumn("_others", F.filter("_choices", lambda x: x != F.col("_near")))
    other = F.get("_others", F.floor(hash01(hash_key(seed, "size", "batch")) * F.size("_others")).cast("int"))
    half = hash01(hash_key(seed, "half", "batch")) < 0.5
    sized = rows.withColumn("size", F.when(half | (F.size("_others") == 0), F.col("_near")).otherwise(other))
    allowed = F.floor(F.least(F.lit(float(budget)) / F.col("size") / F.col("size"), F.lit(float(n_frames))) / step) * step + 1
    frames = F.floor((F.least(allowed, F.col("shortest")) - 1) / step) * step + 1
    return sized.select("batch", "size", F.greatest(F.lit(1), frames).cast("long").alias("frames"))


def reference_frame_choice(plan: DataFrame, first: float = 0.4, seed=0) -> DataFrame:
    """id, ref_frame: -1 where the reference is a file of its own; else frame 0 with probability `first`, others evenly."""
    drawn = F.floor(hash01(hash_key(seed, "ref", "id")) * F.greatest(F.col("length") - 1, F.lit(1))) + 1
    inside = F.when((F.col("length") <= 1) | (hash01(hash_key(seed, "ref0", "id")) < first), 0).otherwise(drawn)
    return plan.select("id", F.when(F.col("has_reference"), -1).otherwise(inside).cast("long").alias("ref_frame"))


def subject_images(meta: DataFrame, k: int = 4, seed=0) -> DataFrame:
    """id, images: at most k of a row's images in seeded order."""
    keyed = F.transform("images", lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("image"), F.col("id").cast("string"), x)).alias("h"), x.alias("x")))
    return meta.select("id", F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s.x).alias("images"))


def replace_bad_samples(plan: DataFrame, seed=0) -> DataFrame:
    """id, used: each good row itself; a bad one (error not null) a seeded good row of its type; null where there is none."""
    good = stratum_rank(plan.where("error is null").select("id", "type"), ["type"], [F.col("id")], "_r").select("type", "_r", F.col("id").alias("used"))
    counts = good.groupBy("type").agg(F.count(F.lit(1)).alias("_n"))
    bad = plan.where("error is not null").join(counts, "type", "left")
    bad = bad.withColumn("_r", F.floor(hash01(hash_key(seed, "bad", "id")) * F.col("_n")))
    return plan.where("error is null").select("id", F.col("id").alias("used")).unionByName(bad.join(good, ["type", "_r"], "left").select("id", "used"))


def align_poses(plan: DataFrame, trajectories: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned, rejects) of a frame plan (id, frames) and the cameras' trajectories (id, poses: an array with one entry for each
    frame of the whole clip, intrinsics).

    aligned: id, frames, poses at the sampled frames, intrinsics, org_height, org_width; all but id and frames null where a
    clip has no trajectory or one that ends before the last sampled frame. rejects: id, reason of clips that have poses but
    no original height or width (sizes: id, org_height, org_width) to scale the intrinsics by. Rows without frames are left
    out. Poses are picked out of their array within a row; only ids are joined."""
    met = plan.where("frames is not null").select("id", "frames").join(trajectories.select("id", "poses", "intrinsics"), "id", "left").join(sizes.select("id", "org_height", "org_width"), "id", "left")
    long_enough = F.coalesce(F.size("poses") > F.array_max("frames"), F.lit(False))
    bare = F.col("org_height").isNull() | F.col("org_width").isNull()
    picked = F.when(long_enough, F.transform("frames", lambda f: F.get("poses", f.cast("int"))))
    kept = met.where(~(long_enough & bare)).select("id", "frames", picked.alias("poses"), *[F.when(long_enough, F.col(c)).alias(c) for c in ("intrinsics", "org_height", "org_width")])
    return kept, met.where(long_enough & bare).select("id", F.lit("camera poses without the original height and width").alias("reason"))
