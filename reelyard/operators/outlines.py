"""What is drawn of people: cylinders on the ground as polygons of a frame, from the farthest to the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The colours of the palette, as they are drawn.
PALETTE = ("#E53935", "#1E88E5", "#43A047", "#FDD835", "#8E24AA", "#FB8C00")
RING = 24
CYLINDERS = 1024  # rows of a batch that are drawn at once


def darker(color: str) -> str:
    """The colour of an outline: 0.6 of each channel, cut to whole numbers."""
    return "#" + "".join(f"{int(int(color[i : i + 2], 16) * 0.6):02X}" for i in (1, 3, 5))


def convex_hulls(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The convex hulls of n sets of m points (n, m, 2) at once: vertices (n, 2m, 2), and how many each hull has.

    A monotone chain over the points by x, then y, walked for all sets side by side; points on an edge are no vertices, a
    point that occurs twice is one. Vertices go round from the first point in that order, as its chain does."""
    n, m = points.shape[:2]
    # complex numbers sort by their real part, then the imaginary one
    ordered = np.sort((points[..., 0] + 1j * points[..., 1]), axis=1).T
    us, vs, every = np.ascontiguousarray(ordered.real), np.ascontiguousarray(ordered.imag), np.arange(n)

    def chain(order: range) -> tuple[np.ndarray, np.ndarray]:
        # place k of chain i is k * n + i
        su, sv, end = np.zeros((m + 1) * n), np.zeros((m + 1) * n), every.copy()
        for k in order:
            u, v = us[k], vs[k]
            top = end - n
            live = np.flatnonzero(new := (su[top] != u) | (sv[top] != v) | (top < 0))
            live = live[end[live] >= 2 * n]
            while len(live):
                b = end[live] - n
                a = b - n
                au, av = su[a], sv[a]
                live = live[(su[b] - au) * (v[live] - av) - (sv[b] - av) * (u[live] - au) <= 0]
                end[live] -= n
                live = live[end[live] >= 2 * n]
            at = end[new]
            su[at], sv[at] = u[new], v[new]
            end += new * n
        return np.stack((su.reshape(m + 1, n).T, sv.reshape(m + 1, n).T), axis=2), end // n

    low, low_n = chain(range(m))
    high, high_n = chain(range(m - 1, -1, -1))
    # the last of each chain is the first of the other
    head = np.maximum(low_n - 1, 1)[:, None]
    counts = np.where(low_n > 1, low_n + high_n - 2, low_n)
    at = np.arange(2 * m)[None, :]
    wide = lambda chain: np.pad(chain, ((0, 0), (0, m - 1), (0, 0)))
    shifted = np.take_along_axis(wide(high), np.clip(at - head, 0, 2 * m - 1)[..., None], axis=1)
    out = np.where((at < head)[..., None], wide(low), shifted)
    return out, counts


def cylinder_points(place: np.ndarray, radius: np.ndarray, height: np.ndarray, u: np.ndarray, v: np.ndarray, normal: np.ndarray, ring: int = RING) -> np.ndarray:
    """(n, 2 * ring, 3): the bottom rings of n cylinders, then their top rings."""
    a = np.arange(ring) * (2 * np.pi / ring)
    around = np.cos(a)[None, :, None] * u[:, None] + np.sin(a)[None, :, None] * v[:, None]
    bottom = place[:, None] + radius[:, None, None] * around
    return np.concatenate((bottom, bottom + (height[:, None] * normal)[:, None]), axis=1)


def cylinder_outlines(paths: DataFrame, subjects: DataFrame, cams: DataFrame, planes: DataFrame, ring: int = RING) -> DataFrame:
    """clip_id, frame, track_id, place, color, outline, points (array of pixel u, v): the subjects of each frame as polygons, the
    farthest (place 1) first, so that nearer ones are drawn over it.

    paths: clip_id, track_id, frame, x, y, z; subjects: clip_id, track_id, height, radius, color (a number of the palette);
    cams: clip_id, frame, fx, fy, cx, cy, r, t; planes: clip_id, u, v, normal, zmin. A cylinder with any point at zmin or
    nearer is left out, as is one without an area. Subjects and planes meet the paths by clip, cameras by clip and frame;
    projection and hulls are worked out on slices of batches; at the end the figures of one frame are ranked together.
    """
    rows = paths.select("clip_id", "track_id", "frame", F.array("x", "y", "z").alias("at")).join(subjects.select("clip_id", "track_id", "height", "radius", "color"), ["clip_id", "track_id"])
    rows = rows.join(planes.select("clip_id", "u", "v", "normal", "zmin"), "clip_id").join(cams.select("clip_id", "frame", "fx", "fy", "cx", "cy", "r", "t"), ["clip_id", "frame"])
    keys, numbers = ["clip_id", "frame", "track_id", "color"], ("height", "radius", "zmin", "fx", "fy", "cx", "cy")
    rows = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(c).cast("array<double>").alias(c) for c in ("at", "u", "v", "normal", "r", "t")])
    corners = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "uv"]))
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("far", T.DoubleType()), T.StructField("points", corners)])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CYLINDERS):
                b = whole.slice(start, CYLINDERS)
                column = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                height, radius, zmin, fx, fy, cx, cy = map(column, numbers)
                place, u, v, normal, r, t = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("at", "u", "v", "normal", "r", "t"))
                r = r.reshape(-1, 3, 3)
                seen = np.einsum("nij,nmj->nmi", r, cylinder_points(place, radius, height, u, v, normal, ring)) + t[:, None]
                depth = seen[..., 2]
                ahead = (depth > zmin[:, None]).all(axis=1)
                # hulls of those before the camera alone
                pixels = seen[ahead, :, :2] / np.maximum(depth[ahead], 1e-9)[..., None] * np.stack((fx, fy), 1)[ahead, None] + np.stack((cx, cy), 1)[ahead, None]
                vertices, counts = convex_hulls(pixels)
                sound = counts >= 3
                vertices, counts, kept = vertices[sound], counts[sound], np.flatnonzero(ahead)[sound]
                far = np.linalg.norm(np.einsum("nij,nj->ni", r[kept], place[kept]) + t[kept], axis=1)
                inner = np.arange(vertices.shape[1]) < counts[:, None]
                points = pa.StructArray.from_arrays([pa.array(vertices[..., i][inner]) for i in range(2)], ["u", "v"])
                polygons = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), points)
                row = pa.array(kept)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in keys], pa.array(far), polygons], schema.names)

    found = rows.mapInArrow(drawn, schema)
    order = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy(F.col("far").desc(), "color", "track_id"))
    of = lambda colors: F.element_at(F.array(*map(F.lit, colors)), (F.pmod("color", F.lit(len(PALETTE))) + 1).cast("int"))
    return found.select("clip_id", "frame", "track_id", order.alias("place"), of(PALETTE).alias("color"), of([darker(c) for c in PALETTE]).alias("outline"), "points")
