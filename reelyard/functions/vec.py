"""Arithmetic on 3-vectors and camera matrices held in array columns (OpenCV cameras: x right, y down, z forward)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once for a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.array(x, y, z)


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def sub(a: Column, b: Column) -> Column:
    return vec(*[at(a, i) - at(b, i) for i in range(3)])


def cross(a: Column, b: Column) -> Column:
    return vec(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cam_center(r: Column, t: Column) -> Column:
    """-R't of a row-major rotation of 9 and a translation."""
    return vec(*[-(at(r, i) * at(t, 0) + at(r, 3 + i) * at(t, 1) + at(r, 6 + i) * at(t, 2)) for i in range(3)])


def project(fx: Column, fy: Column, cx: Column, cy: Column, r: Column, t: Column, x: Column) -> Column:
    """Pixel u, v and depth of a world point; the divisor is 1e-9 at least."""
    cam = [at(r, 3 * i) * at(x, 0) + at(r, 3 * i + 1) * at(x, 1) + at(r, 3 * i + 2) * at(x, 2) + at(t, i) for i in range(3)]
    z = F.greatest(cam[2], F.lit(1e-9))
    return F.struct((fx * cam[0] / z + cx).alias("u"), (fy * cam[1] / z + cy).alias("v"), cam[2].alias("depth"))


def pixel_ray(fx: Column, fy: Column, cx: Column, cy: Column, r: Column, u: Column, v: Column) -> Column:
    """Unit direction in the world through a pixel."""
    x, y = (u - cx) / fx, (v - cy) / fy
    d = vec(*[at(r, i) * x + at(r, 3 + i) * y + at(r, 6 + i) for i in range(3)])
    return let(d, lambda e: let(norm(e), lambda m: vec(*[at(e, i) / m for i in range(3)])))


def ray_plane(origin: Column, direction: Column, normal: Column, d: Column) -> Column:
    """Where a ray meets n.x + d = 0; null if parallel (under 1e-9) or behind."""

    def hit(g: Column) -> Column:
        o, d, n = g["o"], g["d"], g["n"]
        before = lambda s: F.when(s > 0, vec(*[at(o, i) + s * at(d, i) for i in range(3)]))
        return let(dot(n, d), lambda along: F.when(F.abs(along) >= 1e-9, let(-(dot(n, o) + g["k"]) / along, before)))

    return let(F.struct(origin.alias("o"), direction.alias("d"), normal.alias("n"), d.alias("k")), hit)


def rotation_angle(r0: Column, r: Column) -> Column:
    """Degrees between two rotations, from the trace of R R0', clamped."""
    trace = sum((at(r, i) * at(r0, i) for i in range(1, 9)), at(r, 0) * at(r0, 0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def to_plane(x: Column, origin: Column, u: Column, v: Column, n: Column) -> Column:
    """Plane coordinates u, v and height over the plane."""
    d = sub(x, origin)
    return F.struct(dot(d, u).alias("u"), dot(d, v).alias("v"), dot(d, n).alias("n"))


def plane_frame(n: Column, d: Column, r: Column, t: Column) -> Column:
    """origin (the point of the plane n.x + d = 0 under the camera), u (the view along the plane, or the x axis along it where
    the camera looks straight at it), v = n x u and h (the camera's height)."""

    def along(a: Column, m: Column) -> Column:
        return let(dot(a, m), lambda k: vec(*[at(a, i) - k * at(m, i) for i in range(3)]))

    def framed(g: Column) -> Column:
        m, c, ahead = g["n"], g["c"], g["ahead"]
        view = F.when(norm(ahead) < 1e-6, along(vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)), m)).otherwise(ahead)
        unit = let(view, lambda w: let(norm(w), lambda k: vec(*[at(w, i) / k for i in range(3)])))
        return let(F.struct(unit.alias("u"), (dot(m, c) + d).alias("h")), lambda x: F.struct(vec(*[at(c, i) - x["h"] * at(m, i) for i in range(3)]).alias("origin"), x["u"].alias("u"), cross(m, x["u"]).alias("v"), x["h"].alias("h")))

    given = let(n, lambda m: F.struct(m.alias("n"), cam_center(r, t).alias("c"), along(vec(*[at(r, i) for i in (6, 7, 8)]), m).alias("ahead")))
    return let(given, framed)


def horizon_y(fy: Column, cx: Column, cy: Column, fx: Column, r: Column, n: Column, x: Column) -> Column:
    """Pixel row of a plane's vanishing line at column x; null where it is degenerate (under 1e-9)."""
    m = [at(r, 3 * i) * at(n, 0) + at(r, 3 * i + 1) * at(n, 1) + at(r, 3 * i + 2) * at(n, 2) for i in range(3)]
    return F.when(F.abs(m[1]) >= 1e-9, cy - fy * (m[0] * (x - cx) / fx + m[2]) / m[1])


def look_at(eye: Column, target: Column, up: Column) -> Column:
    """Row-major world-to-camera rotation of a camera at eye that faces target (x right, y down, z forward)."""
    d = sub(target, eye)
    z = F.transform(d, lambda c: c / norm(d))
    side = cross(z, up)
    x = F.transform(side, lambda c: c / norm(side))
    return F.concat(x, cross(z, x), z)


def pitch_from_horizon(f: Column, cy: Column, y: Column) -> Column:
    """Camera pitch in radians from the row of the horizon."""
    return F.atan2(cy - y, f)


def horizon_from_gravity(f: Column, cy: Column, g: Column, height: Column) -> Column:
    """Row of the horizon at the principal column, from gravity in camera coordinates, on a frame of 720 rows (the picture
    that was measured has `height`); null where the horizon has no single row there (under 1e-9)."""
    return F.when(F.abs(at(g, 1) / f) > 1e-9, (cy - f * at(g, 2) / at(g, 1)) * 720 / height)


def rot_axis(axis: Column, angle: Column) -> Column:
    """Row-major rotation by an angle in radians about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    a = [at(axis, i) for i in range(3)]
    turn = [[None, -a[2], a[1]], [a[2], None, -a[0]], [-a[1], a[0], None]]
    return F.array(*[a[i] * a[j] * (1 - c) + (c if i == j else s * turn[i][j]) for i in range(3) for j in range(3)])
