"""Ground planes of clips of any size: hypotheses are scored on blocks of points, and the plane of the inliers follows from
aggregated moments, so the points of a clip never come together in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelyard.operators.plane import HYPOTHESES, MAX_ANGLE, NORMAL_DEG, UP, hypotheses
from reelyard.storage import keep

BLOCK_POINTS = 4096
DRAWN = 2048  # points of a clip from which hypotheses are drawn
CLIPS = 64  # rows of a batch that Python works on at once
AXES = ("x", "y", "z")
PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]


def plane_moments(points: DataFrame) -> DataFrame:
    """clip_id, n, x, y, z (means) and xx, xy, xz, yy, yz, zz (population covariances) of each clip's points, combined before the
    shuffle. Rows with a null coordinate are left out."""
    sound = points.dropna(subset=list(AXES))
    return sound.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in AXES], *[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(a + b) for a, b in PAIRS])


def least_planes(moments: DataFrame) -> DataFrame:
    """clip_id, nx, ny, nz, d, n, spread: the least-squares plane of each clip's moments, whose normal is the direction of the
    least spread (the variance along it); its greatest component is positive. One row a clip, worked out on whole batches.
    Fewer than three points make no plane."""
    names = [a + b for a, b in PAIRS]
    kind = moments.schema["clip_id"].dataType.simpleString()

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = dict(zip(names, b[names].to_numpy(np.float64).T, strict=True))
                matrix = np.stack([np.stack([c[min(i, j) + max(i, j)] for j in AXES], 1) for i in AXES], 1)
                spread, axes = np.linalg.eigh(matrix)
                normal = axes[:, :, 0]
                normal = normal * np.where(normal[np.arange(len(b)), np.abs(normal).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                d = -(normal * b[list(AXES)].to_numpy(np.float64)).sum(axis=1)
                yield b[["clip_id", "n"]].assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], d=d, spread=np.maximum(spread[:, 0], 0.0))

    return moments.where("n >= 3").select("clip_id", "n", *AXES, *names).mapInPandas(solved, f"clip_id {kind}, n long, nx double, ny double, nz double, d double, spread double")


def best_hypotheses(scores: DataFrame) -> DataFrame:
    """scores (clip_id, hypothesis, inliers, ...): each clip's row of most inliers, the first of several."""
    others = [c for c in scores.columns if c != "clip_id"]
    best = scores.groupBy("clip_id").agg(F.max_by(F.struct(*others), F.struct("inliers", -F.col("hypothesis"))).alias("_b"))
    return best.select("clip_id", "_b.*")


def is_inlier(normals: bool) -> Column:
    """Whether a point (x, y, z and, where known, its normal px, py, pz) belongs to its clip's plane (nx, ny, nz, d) at `near`."""
    close = F.abs(sum((F.col(a) * F.col(f"n{a}") for a in "yz"), F.col("x") * F.col("nx")) + F.col("d")) < F.col("near")
    if not normals:
        return close
    along = F.abs(sum((F.coalesce(f"p{a}", F.lit(0.0)) * F.col(f"n{a}") for a in "yz"), F.coalesce("px", F.lit(0.0)) * F.col("nx")))
    return close & (F.col("_bare") | (along > float(np.cos(np.radians(NORMAL_DEG)))))


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    """The numbers of each list (of none that is null), nan where one is null."""
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _points(lists: pa.Array, skip: int = 0) -> list[np.ndarray]:
    """The structs of numbers of each list as an array, a row each, without the first `skip` fields."""
    columns = lists.flatten().flatten()[skip:]
    return np.split(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(np.concatenate(arrays)))


def fit_planes(points: DataFrame, seed: int = 0, drawn: int = DRAWN) -> DataFrame:
    """clip_id, nx, ny, nz, d, inlier_ratio, camera_height, angle_deg, normal_agreement, plane_ok, points: as
    plane.fit_ground() with a camera at the origin whose up is -y, for clips of any number of points.

    points: clip_id, x, y, z and, where known, their normals nx, ny, nz. Hypotheses are drawn from the `drawn` points of the
    smallest hash of a clip; they are scored on all its points, which go in blocks of at most some BLOCK_POINTS; inliers are
    within 1 % of the median depth. A clip of fewer than three points, or without a plane through any drawn ones, has no row.
    """
    known = {"nx", "ny", "nz"} <= set(points.columns)
    sides = [F.col(f"n{a}").cast("double").alias(f"p{a}") for a in AXES] if known else []
    rows = points.dropna(subset=list(AXES)).select("clip_id", *[F.col(a).cast("double").alias(a) for a in AXES], *sides)
    names = [f.name for f in rows.schema.fields if f.name != "clip_id"]
    rows = keep(rows.withColumn("_h", F.xxhash64(F.lit(seed), *names)), "points")
    if known:
        bare = ~F.coalesce(F.isnotnull("px") & F.isnotnull("py") & F.isnotnull("pz") & ~F.isnan("px") & ~F.isnan("py") & ~F.isnan("pz"), F.lit(False))
        rows = rows.withColumn("_none", bare)
    size = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("points"), (0.01 * F.percentile_approx(F.abs("z"), 0.5, 100_000)).alias("near"), *([F.min("_none").alias("_bare")] if known else []))
    size = keep(size, "sizes")

    # the points to draw from: a first cut by the hash leaves a few times as many as are wanted, then the smallest are taken
    cut = rows.join(size.select("clip_id", "points"), "clip_id").where((F.shiftrightunsigned("_h", 33) < F.lit(float(1 << 31)) * 4 * drawn / F.col("points")) | (F.col("points") <= 4 * drawn))
    first = cut.groupBy("clip_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("_h", *names))), 1, drawn).alias("_s"))
    kind = rows.schema["clip_id"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CLIPS):
                b, made = whole.slice(start, CLIPS), []
                for part in _points(b.column(1), 1):
                    found = part[:, 3:] if known and np.isfinite(part[:, 3:]).all(axis=1).any() else None
                    normals, through = hypotheses(part[:, :3], None if found is None else np.nan_to_num(found), np.random.default_rng(seed), HYPOTHESES) if len(part) >= 3 else (np.zeros((0, 3)), np.zeros((0, 3)))
                    made.append(np.column_stack((normals, -(normals * through).sum(axis=1))).ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(made)], ["clip_id", "tried"])

    # a clip's hypotheses are one array of nx, ny, nz, d each: plain numbers, which take no objects in Python
    tried = keep(first.mapInArrow(draw, f"clip_id {kind}, tried array<double>").where("size(tried) > 0"), "hypotheses")
    parts = F.greatest(F.lit(1), F.ceil(F.col("points") / BLOCK_POINTS))
    dealt = rows.join(size, "clip_id").select("clip_id", F.pmod("_h", parts).alias("block"), parts.alias("blocks"), "near", (F.col("_bare") if known else F.lit(True)).alias("bare"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    blocks = dealt.groupBy("clip_id", "block", "blocks", "near", "bare").agg(F.collect_list(F.struct(*names)).alias("ps")).join(tried, "clip_id").select("clip_id", "blocks", "near", "bare", "ps", "tried")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Inliers of each hypothesis in a block; of the only block of a clip, the first best hypothesis alone."""
        for whole in batches:
            for start in range(0, whole.num_rows, CLIPS):
                b = whole.slice(start, CLIPS)
                alone, near, bare = b.column(1).to_numpy() == 1, b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                row, hypothesis, inliers = [], [], []
                for i, (p, tries) in enumerate(zip(_points(b.column(4)), _arrays(b.column(5)), strict=True)):
                    h = tries.reshape(-1, 4)
                    far = p[:, :3] @ h[:, :3].T
                    far += h[:, 3]
                    inside = np.abs(far, out=far) < near[i]
                    if not bare[i]:
                        along = p[:, 3:] @ h[:, :3].T
                        inside &= np.abs(along, out=along) > np.cos(np.radians(NORMAL_DEG))
                    n = inside.sum(axis=0)
                    k = n.argmax(keepdims=True) if alone[i] else np.flatnonzero(n)
                    row.append(np.full(len(k), i)), hypothesis.append(k), inliers.append(n[k])
                out = [b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(hypothesis).astype(np.int32)), pa.array(np.concatenate(inliers).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["clip_id", "hypothesis", "inliers"])

    counted = blocks.mapInArrow(score, f"clip_id {kind}, hypothesis int, inliers long").groupBy("clip_id", "hypothesis").agg(F.sum("inliers").alias("inliers"))
    figures = [F.get("tried", 4 * F.col("hypothesis") + i).alias(c) for i, c in enumerate(("nx", "ny", "nz", "d"))]
    best = keep(best_hypotheses(counted.where("inliers > 0")).join(tried, "clip_id").select("clip_id", *figures), "best")

    def inliers_of(planes: DataFrame) -> DataFrame:
        met = rows.join(planes.select("clip_id", "nx", "ny", "nz", "d"), "clip_id").join(size, "clip_id")
        return met.withColumn("_in", is_inlier(known))

    refined = least_planes(plane_moments(inliers_of(best).where("_in"))).select("clip_id", "nx", "ny", "nz", "d")
    planes = keep(refined.unionByName(best.join(refined, "clip_id", "left_anti").select("clip_id", "nx", "ny", "nz", "d")), "planes")
    agreement = F.avg(F.when(F.col("_in"), F.abs(sum((F.col(f"p{a}") * F.col(f"n{a}") for a in "yz"), F.col("px") * F.col("nx"))))) if known else F.lit(None).cast("double")
    told = inliers_of(planes).groupBy("clip_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("_in").alias("_n"), agreement.alias("normal_agreement"))
    toward = F.when(F.col("d") < 0, -1.0).otherwise(1.0)  # the camera is the origin
    n = {a: toward * F.col(f"n{a}") for a in AXES}
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((n[a] * float(u) for a, u in zip(AXES, UP, strict=True)), F.lit(0.0))))))
    ratio, height = F.col("_n") / F.col("points"), F.abs("d")
    ok = (ratio >= 0.3) & (angle <= MAX_ANGLE) & (height > 0)
    return planes.join(told, "clip_id").select("clip_id", *[n[a].alias(f"n{a}") for a in AXES], height.alias("d"), ratio.alias("inlier_ratio"), height.alias("camera_height"), angle.alias("angle_deg"), "normal_agreement", ok.alias("plane_ok"), "points")
