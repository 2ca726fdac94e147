"""Ground planes of clips by RANSAC, one group per clip (at most some 50 000 points)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HYPOTHESES = 600
BLOCK = 32
NORMAL_DEG = 30.0
MAX_ANGLE = 45.0
UP = np.array([0.0, -1.0, 0.0])  # of a camera that looks along z


def refine(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The least-squares plane n.x + d = 0 of points: the direction of least spread."""
    center = points.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((points - center).T, bias=True))
    normal = axes[:, 0]
    return normal, float(-normal @ center)


def hypotheses(points: np.ndarray, normals: np.ndarray | None, draw: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals of up to n drawn planes, and a point of each: planes through three points, every other one through one
    point with its own normal where there are normals; degenerate ones are left out."""
    pick = draw.integers(0, len(points), (n, 3))
    corners, least = points[pick], np.full(n, 1e-9)
    found = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    if normals is not None:
        found[::2], least[::2] = normals[pick[::2, 0]], 1e-6
    size = np.linalg.norm(found, axis=1)
    sound = size >= least
    return found[sound] / size[sound, None], corners[sound, 0]


def fit_plane(points: np.ndarray, camera: np.ndarray, median_depth: float, seed: int, normals: np.ndarray | None = None, up: np.ndarray = UP) -> dict:
    """normal, d, inlier_ratio, angle_deg to the camera's up, camera_height, normal_agreement (mean over the inliers),
    plane_ok; the first best hypothesis wins. Inliers are near and, where there are normals, within NORMAL_DEG of the plane's.
    """
    none = dict.fromkeys(("nx", "ny", "nz", "d", "camera_height", "angle_deg", "normal_agreement")) | {"inlier_ratio": 0.0, "plane_ok": False}
    if len(points) < 3:
        return none | {"error": "under 3 points"}
    draw, near, best = np.random.default_rng(seed), 0.01 * median_depth, (0, None)

    def inliers(n: np.ndarray, d: np.ndarray | float) -> np.ndarray:
        close = np.abs(points @ n.T + d) < near
        return close if normals is None else close & (np.abs(normals @ n.T) > np.cos(np.radians(NORMAL_DEG)))

    for start in range(0, HYPOTHESES, BLOCK):
        drawn, through = hypotheses(points, normals, draw, min(BLOCK, HYPOTHESES - start))
        if len(drawn):
            ds = -(drawn * through).sum(axis=1)
            counts = inliers(drawn, ds).sum(axis=0)
            k = int(counts.argmax())
            if counts[k] > best[0]:
                best = int(counts[k]), (drawn[k], float(ds[k]))
    if best[1] is None:
        return none | {"error": "no plane"}
    normal, d = best[1]
    fitted = inliers(normal, d)
    if fitted.sum() >= 3:  # fewer don't make a plane
        normal, d = refine(points[fitted])
    fitted = inliers(normal, d)
    if normal @ camera + d < 0:  # toward the camera
        normal, d = -normal, -d
    ratio, height = float(fitted.mean()), float(normal @ camera + d)
    angle = float(np.degrees(np.arccos(np.clip(normal @ up, -1, 1))))
    agreement = float(np.abs(normals[fitted] @ normal).mean()) if normals is not None and fitted.any() else None
    return {"nx": normal[0], "ny": normal[1], "nz": normal[2], "d": d, "inlier_ratio": ratio, "camera_height": height, "angle_deg": angle, "normal_agreement": agreement, "plane_ok": bool(ratio >= 0.3 and angle <= MAX_ANGLE and height > 0), "error": None}


def fit_ground(points: DataFrame, seed: int = 0, cameras: DataFrame | None = None) -> DataFrame:
    """clip_id, normal (nx, ny, nz), d, inlier_ratio, camera_height, angle_deg, normal_agreement, plane_ok, error from rows
    (clip_id, x, y, z) and, where a clip has them, the points' normals (nx, ny, nz).

    Cameras are (clip_id, r, t), world to camera, one row for each clip; without one the camera is the origin with its up
    along -y. Depths are distances along the camera's view. A clip that fails gives an error row.
    """
    names = ["x", "y", "z"] + (["nx", "ny", "nz"] if {"nx", "ny", "nz"} <= set(points.columns) else [])
    row = "clip_id string, nx double, ny double, nz double, d double, inlier_ratio double, camera_height double, angle_deg double, normal_agreement double, plane_ok boolean, error string"

    def fitted(clip: str | None, part: pd.DataFrame, r: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        part = part[names].astype(np.float64).dropna(subset=["x", "y", "z"]).sort_values(names)  # rows come in any order
        xyz, normals = part[names[:3]].to_numpy(), part[names[3:]].to_numpy()
        known = len(names) == 6 and bool(np.isfinite(normals).any())
        depth = float(np.median(np.abs(xyz @ r[2] + t[2]))) if len(xyz) else 0.0
        found = fit_plane(xyz, -r.T @ t, depth, seed, np.where(np.isfinite(normals).all(axis=1, keepdims=True), normals, 0.0) if known else None, r.T @ UP)
        return pd.DataFrame([{"clip_id": clip, **found}])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return fitted(part["clip_id"].iloc[0], part, np.eye(3), np.zeros(3))

    def fit_with(part: pd.DataFrame, camera: pd.DataFrame) -> pd.DataFrame:
        clip = (part if len(part) else camera)["clip_id"].iloc[0]
        if camera.empty:
            return fitted(clip, part, np.eye(3), np.zeros(3))
        return fitted(clip, part, np.array(camera["r"].iloc[0], np.float64).reshape(3, 3), np.array(camera["t"].iloc[0], np.float64))

    given = points.select("clip_id", *names).groupBy("clip_id")
    if cameras is None:
        return given.applyInPandas(fit, row)
    return given.cogroup(cameras.select("clip_id", "r", "t").groupBy("clip_id")).applyInPandas(fit_with, row)


def inlier_counts(points: DataFrame, planes: DataFrame, near: float) -> DataFrame:
    """clip_id, points, inliers of given planes (clip_id, nx, ny, nz, d)."""
    far = F.abs(F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") + F.col("d"))
    return points.select("clip_id", "x", "y", "z").join(planes, "clip_id").groupBy("clip_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(far < near).alias("inliers"))
