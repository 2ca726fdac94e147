"""Queries of whole clips: cameras of every frame, outlines, records, scenes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.catalog import _GROUND_PATHS
from reelyard.catalog import _ground as ground
from reelyard.functions import vec
from reelyard.jobs import adapters as A
from reelyard.operators import authored, cameras, clip_records, ground_paths, outlines, plane_parts, sample_plan
from reelyard.queries import ORACLES, query


def rounded(c, n: int):
    """Without negative zeros, which no SQL tells from zero."""
    return F.round(c, n) + 0.0


_BETWEEN = f"""{A.TURNED}, tf AS (SELECT DISTINCT clip_id, f AS frame FROM turned, (SELECT unnest(range(81)) AS f)), tb AS (SELECT tf.clip_id, tf.frame, coalesce(max(kf) FILTER (t.frame <= tf.frame), min(kf)) AS lo, min(kf) FILTER (t.frame > tf.frame) AS hi,
  arg_min(kf, abs(t.frame - tf.frame) * 100 + kf) AS near FROM tf JOIN turned t USING (clip_id) GROUP BY 1, 2),
tw AS (SELECT b.clip_id, b.frame, near, l.b, CASE WHEN h.frame IS NULL OR b.frame <= l.frame THEN 0.0 ELSE (b.frame - l.frame) / CAST(h.frame - l.frame AS DOUBLE) END AS w, {", ".join(f"l.{c} AS {c}0, coalesce(h.{c}, l.{c}) AS {c}1" for c in "axyz")}
  FROM tb b JOIN turned l ON l.clip_id = b.clip_id AND l.kf = lo LEFT JOIN turned h ON h.clip_id = b.clip_id AND h.kf = hi),
ti AS (SELECT clip_id, frame, near + 500.0 AS fx, near + 510.0 AS fy, b, {", ".join(f"{c}0 + ({c}1 - {c}0) * w AS {c}" for c in "axyz")} FROM tw),
tr AS (SELECT *, cos(a) AS r0, sin(a) * sin(b) AS r1, -sin(a) * cos(b) AS r2, 0.0 AS r3, cos(b) AS r4, sin(b) AS r5, sin(a) AS r6, -cos(a) * sin(b) AS r7, cos(a) * cos(b) AS r8 FROM ti)"""


@query(f"WITH {_BETWEEN} SELECT clip_id, frame, CAST(fx AS DOUBLE) AS fx, CAST(fy AS DOUBLE) AS fy, {', '.join(f'round(r{i}, 6) + 0.0 AS r{i}' for i in range(9))}, {', '.join(f'round(-(r{3 * i} * x + r{3 * i + 1} * y + r{3 * i + 2} * z), 6) + 0.0 AS t{i}' for i in range(3))} FROM tr")
def interpolated_cameras(spark: SparkSession, d: str) -> DataFrame:
    """The whole camera of all 81 frames of every clip, from turning keyframes."""
    every = cameras.interpolate_cams(A.turned_cameras(spark, d))
    return every.select("clip_id", "frame", "fx", "fy", *[rounded(vec.at(F.col("r"), i), 6).alias(f"r{i}") for i in range(9)], *[rounded(vec.at(F.col("t"), i), 6).alias(f"t{i}") for i in range(3)])


# --- authored scenes


# eye (ex, ey, ez) and view (fx, fy, fz) of every frame; a camera's rotation follows from its view and the level ground
_MOVES = f"""{A.SCENES}, hh AS (SELECT k, quantile_cont(height, 0.5) AS h FROM pe GROUP BY 1), mm AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM po WHERE frame = 40 GROUP BY 1),
c0 AS (SELECT sc.*, CAST(coalesce(h, 1.0) AS DOUBLE) AS h, coalesce(mx, 3.0) AS tx, coalesce(my, 0.0) AS ty, CASE WHEN mx IS NULL THEN 0.0 ELSE 0.5 * h END AS tz, radians(k % 13 - 6) AS yaw, radians(CASE WHEN k % 10 <> 0 THEN (k % 9) / 2.0 ELSE 2.0 END) AS pitch,
  CAST(CASE WHEN k % 8 <> 0 THEN (k % 5) / 10.0 + 0.5 ELSE 0.69 END AS DOUBLE) AS ez0, CASE WHEN k % 2 = 0 THEN 900.0 + k % 100 ELSE 966.0 END AS focal FROM sc LEFT JOIN hh USING (k) LEFT JOIN mm USING (k)),
c1 AS (SELECT *, cos(pitch) * cos(yaw) AS gx, -cos(pitch) * sin(yaw) AS gy, -sin(pitch) AS gz, CASE WHEN k % 4 = 2 THEN 0.8 * h ELSE least(1.2 * h, 0.4 * (tx * cos(yaw) - ty * sin(yaw))) END AS step FROM c0),
c2 AS (SELECT *, frame / 80.0 AS w, radians(CASE WHEN path = 'orbit' THEN CASE WHEN anchored THEN 40 * frame / 80.0 WHEN k % 4 = 1 THEN 60 * (frame / 80.0 - 0.5) ELSE 40 * (frame / 80.0 - 0.5) END WHEN path = 'pan' THEN CASE WHEN anchored THEN 24 * frame / 80.0 ELSE 24 * (frame / 80.0 - 0.5) END ELSE 0 END) AS g
  FROM (SELECT *, unnest(range(81)) AS frame FROM c1)),
c3 AS (SELECT *, CASE path WHEN 'dolly_in' THEN w * step * cos(yaw) WHEN 'dolly_out' THEN -w * step * cos(yaw) WHEN 'orbit' THEN tx - cos(g) * tx + sin(g) * ty ELSE 0 END AS ex, CASE path WHEN 'dolly_in' THEN -w * step * sin(yaw) WHEN 'dolly_out' THEN w * step * sin(yaw) WHEN 'orbit' THEN ty - sin(g) * tx - cos(g) * ty ELSE 0 END AS ey,
  ez0 + CASE WHEN path = 'crane' THEN CASE WHEN anchored THEN w ELSE 1 - w END * 1.5 * h ELSE 0 END AS ez FROM c2),
c4 AS (SELECT *, CASE WHEN path IN ('orbit', 'crane') AND NOT anchored THEN tx - ex ELSE cos(g) * gx - sin(g) * gy END AS vx, CASE WHEN path IN ('orbit', 'crane') AND NOT anchored THEN ty - ey ELSE sin(g) * gx + cos(g) * gy END AS vy, CASE WHEN path IN ('orbit', 'crane') AND NOT anchored THEN tz - ez ELSE gz END AS vz FROM c3),
c5 AS (SELECT *, vx / n AS zx, vy / n AS zy, vz / n AS zz, vy / m AS xx, -vx / m AS xy FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n, sqrt(vx * vx + vy * vy) AS m FROM c4)),
mv AS (SELECT k, scene, frame, path, focal, ex, ey, ez, xx AS r0, xy AS r1, 0.0 AS r2, -zz * xy AS r3, zz * xx AS r4, zx * xy - zy * xx AS r5, zx AS r6, zy AS r7, zz AS r8 FROM c5)"""
_R, _T = [f"r{i}" for i in range(9)], [f"t{i}" for i in range(3)]


@query(f"WITH {_MOVES} SELECT scene, frame, CAST(focal AS DOUBLE) AS fx, {', '.join(f'round({r}, 6) + 0.0 AS {r}' for r in _R)}, {', '.join(f'round(-(r{3 * i} * ex + r{3 * i + 1} * ey + r{3 * i + 2} * ez), 6) + 0.0 AS t{i}' for i in range(3))} FROM mv")
def scene_cameras(spark: SparkSession, d: str) -> DataFrame:
    """The camera of every frame of all authored scenes."""
    cams = authored.scene_frames(A.scene_documents(spark, d))
    return cams.select("scene", "frame", "fx", *[rounded(vec.at(F.col("r"), i), 6).alias(c) for i, c in enumerate(_R)], *[rounded(vec.at(F.col("t"), i), 6).alias(c) for i, c in enumerate(_T)])


@query(f"""WITH {_MOVES}, ft AS (SELECT po.*, row_number() OVER (PARTITION BY po.k ORDER BY focal * (r0 * (x - ex) + r1 * (y - ey)) / greatest(r6 * (x - ex) + r7 * (y - ey) - r8 * ez, 1e-9), i) - 1 AS rank FROM po JOIN mv USING (k, frame) WHERE po.frame = 0)
SELECT po.scene, po.cylinder, po.frame, round(po.x, 6) AS x, round(po.y, 6) AS y, 0.0 AS z, round(po.height, 6) AS height, CAST(coalesce(po.ci, rank) % 6 AS BIGINT) AS color FROM po JOIN ft USING (k, i)""")
def scene_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where the people of all authored scenes stand, with their heights and colours."""
    placed = authored.people_positions(authored.scene_people(A.scene_documents(spark, d)))
    return placed.select("scene", "cylinder", "frame", *[rounded(c, 6).alias(c) for c in "xyz"], F.round("height", 6).alias("height"), F.col("color").cast("long").alias("color"))


# --- outlines


_RING = 24
_OUTLINED = f"""{_GROUND_PATHS}, sd AS (SELECT clip_id, track_id, height FROM hts), sp AS (SELECT clip_id, coalesce(quantile_cont(height, 0.5), 1.0) AS s FROM hts GROUP BY 1),
cy AS (SELECT p.clip_id, p.track_id, p.frame, p.x, p.y, p.z, height, s FROM paths p JOIN sd USING (clip_id, track_id) JOIN sp USING (clip_id) SEMI JOIN gd g ON g.clip_id = p.clip_id AND g.frame = p.frame),
rg AS (SELECT *, list_transform(range({2 * _RING}), lambda i: {{'x': x - 0.2 * height * sin(i % {_RING} * 2 * pi() / {_RING}), 'y': y - CASE WHEN i >= {_RING} THEN height ELSE 0 END, 'z': z + 0.2 * height * cos(i % {_RING} * 2 * pi() / {_RING})}}) AS ring FROM cy),
px AS (SELECT clip_id, track_id, frame, sqrt(x * x + y * y + z * z) AS far, list_transform(ring, lambda p: {{'u': 811.3037 * p.x / p.z, 'v': 907.7023 * p.y / p.z}}) AS px FROM rg WHERE list_min(list_transform(ring, lambda p: p.z)) > 0.05 * s),
ed AS (SELECT *, list_reduce(px, lambda b, q: CASE WHEN q = a THEN b WHEN b = a OR (b.u - a.u) * (q.v - a.v) - (b.v - a.v) * (q.u - a.u) < 0 THEN q ELSE b END) AS b FROM (SELECT *, px[i] AS a FROM (SELECT *, unnest(range(1, {2 * _RING + 1})) AS i FROM px))),
hl AS (SELECT clip_id, track_id, frame, abs(sum(a.u * b.v - b.u * a.v)) / 2 AS area FROM ed WHERE list_min(list_transform(px, lambda q: CASE WHEN q = a OR q = b THEN 1e300 ELSE (b.u - a.u) * (q.v - a.v) - (b.v - a.v) * (q.u - a.u) END)) > 0 GROUP BY 1, 2, 3)"""


@query(f"WITH {_OUTLINED} SELECT px.clip_id, px.frame, px.track_id, row_number() OVER (PARTITION BY px.clip_id, px.frame ORDER BY far DESC, px.track_id) AS place, round(log2(area), 4) AS log_area FROM px JOIN hl USING (clip_id, track_id, frame)")
def cylinder_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The polygon of every person in every frame of the level clips: its place in the order of drawing and its area."""
    planes, _, heights, positions = ground(spark, d)
    i, o = F.lit(1.0), F.lit(0.0)
    r, t = F.array(i, o, o, o, i, o, o, o, i), F.array(o, o, o)
    cells = ground_paths.grid_spacing(heights, planes).select("clip_id", (0.05 * F.col("grid_spacing")).alias("zmin"))
    framed = planes.select("clip_id", "normal", vec.plane_frame(F.col("normal"), F.col("d"), r, t).alias("p")).select("clip_id", "normal", "p.u", "p.v").join(cells, "clip_id")
    paths = ground_paths.subject_paths(positions, heights)
    cams = A.level_cameras(A.ground_detections(spark, d).where("visible"))
    drawn = outlines.cylinder_outlines(paths, heights.withColumn("color", F.lit(0)), cams, framed)
    v = F.col("points")
    cross = F.transform(v, lambda p, k: p.u * F.get(v, (k + 1) % F.size(v)).v - F.get(v, (k + 1) % F.size(v)).u * p.v)
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
    return drawn.select("clip_id", "frame", "track_id", F.col("place").cast("long").alias("place"), F.round(F.log2(area), 4).alias("log_area"))


# --- planes by parts, poses of sampled frames


_COVARIANCES = [f"{a}{b}" for a, b in plane_parts.PAIRS]


@query(f"""WITH p AS (SELECT CAST(label AS VARCHAR) AS clip_id, {", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {a}" for i, a in enumerate("xyz", 1))} FROM embeddings),
m AS (SELECT clip_id, count(*) AS n, {", ".join(f"avg({a}) AS {a}" for a in "xyz")}, {", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in plane_parts.PAIRS)} FROM p GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), w AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS w FROM q),
r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * w * w * w) AS r FROM w)
SELECT clip_id, n, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in _COVARIANCES)}, round(q + 2 * w * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3), 9) AS spread, 0.0 AS residue FROM r""")
def plane_moments(spark: SparkSession, d: str) -> DataFrame:
    """The moments of every group of points, the spread of its least-squares plane, and how far the plane misses the mean."""
    e = F.col("embedding")
    points = A.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("clip_id"), *[F.get(e, F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])
    moments = plane_parts.plane_moments(points)
    planes = plane_parts.least_planes(moments).drop("n")
    off = F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") + F.col("d")
    return moments.join(planes, "clip_id").select("clip_id", "n", *[rounded(F.col(c), 9).alias(c) for c in _COVARIANCES], F.round("spread", 9).alias("spread"), F.abs(F.round(off, 9)).alias("residue"))


@query("""WITH p AS (SELECT l_suppkey AS clip_id, (l_suppkey % 7 - 3) * CAST(0.03 AS DOUBLE) AS a, (l_suppkey % 5 - 2) * CAST(0.02 AS DOUBLE) AS b, 1.5 + l_suppkey % 4 * CAST(0.25 AS DOUBLE) AS c, l_linenumber <= 4 AS flat FROM lineitem)
SELECT clip_id, round(a / m, 6) + 0.0 AS nx, round(-1 / m, 6) AS ny, round(b / m, 6) + 0.0 AS nz, round(c / m, 6) AS camera_height, round(degrees(acos(1 / m)), 4) + 0.0 AS angle_deg, round(inliers / CAST(points AS DOUBLE), 9) AS inlier_ratio, points, CASE WHEN clip_id % 3 <> 0 THEN 1.0 END AS normal_agreement, inliers / CAST(points AS DOUBLE) >= 0.3 AS plane_ok
FROM (SELECT clip_id, a, b, c, sqrt(1 + a * a + b * b) AS m, count(*) AS points, count(*) FILTER (flat) AS inliers FROM p GROUP BY 1, 2, 3, 4)""")
def fitted_planes(spark: SparkSession, d: str) -> DataFrame:
    """The ground of every clip, a tilted plane under a quarter of stray points: hypotheses on blocks of points, then moments."""
    fit = plane_parts.fit_planes(A.ground_points(spark, d))
    return fit.select("clip_id", *[rounded(c, 6).alias(c) for c in ("nx", "ny", "nz", "camera_height")], rounded("angle_deg", 4).alias("angle_deg"), F.round("inlier_ratio", 9).alias("inlier_ratio"), "points", F.round("normal_agreement", 6).alias("normal_agreement"), "plane_ok")


_LENGTH = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN least(length, 20) ELSE length END"


@query(f"""WITH fp AS ({ORACLES["frame_plans"].replace("n_chars AS length", "n_chars // 16 AS length")}), m AS (SELECT doc_id AS id, {_LENGTH.replace("id %", "doc_id %").replace("length", "n_chars // 16")} AS poses FROM documents),
j AS (SELECT fp.id, list_transform(string_split(frames, ','), lambda f: CAST(f AS BIGINT)) AS fs, poses FROM fp JOIN m USING (id) WHERE error IS NULL), k AS (SELECT *, coalesce(poses > list_max(fs), false) AS fits FROM j)
SELECT id, len(fs) AS frames, fits AND id % 5 = 0 AS rejected, CASE WHEN fits AND id % 5 <> 0 THEN len(fs) END AS poses, CASE WHEN fits AND id % 5 <> 0 THEN list_sum(list_transform(fs, lambda f: f * 4 + id % 7)) END AS total FROM k""")
def aligned_poses(spark: SparkSession, d: str) -> DataFrame:
    """Poses of the frames that each document's plan samples, some trajectories missing, short or without a size."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("n_chars div 16").alias("length"))
    plan = sample_plan.frame_plan(docs, 81, 0.05, 0.95, 3, 9)
    n = F.expr(_LENGTH)
    poses = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda f: F.array(f * 4.0, (F.col("id") % 7).cast("double"))))
    tracks = docs.select("id", poses.alias("poses"), F.array(F.lit(1.0)).alias("intrinsics"))
    sizes = docs.select("id", F.when(F.col("id") % 5 != 0, 720).alias("org_height"), F.lit(1280).alias("org_width"))
    kept, rejects = sample_plan.align_poses(plan, tracks, sizes)
    total = F.aggregate("poses", F.lit(0.0), lambda a, p: a + F.get(p, F.lit(0)) + F.get(p, F.lit(1))).cast("long")
    good = kept.select("id", F.size("frames").cast("long").alias("frames"), F.lit(False).alias("rejected"), F.when(F.col("poses").isNotNull(), F.size("poses").cast("long")).alias("poses"), total.alias("total"))
    none = F.lit(None).cast("long")
    bad = rejects.join(plan.select("id", "frames"), "id").select("id", F.size("frames").cast("long").alias("frames"), F.lit(True).alias("rejected"), none.alias("poses"), none.alias("total"))
    return good.unionByName(bad)


# --- whole records


_HEAD, _REST = _GROUND_PATHS.split("\nsz AS", 1)
_MAIN_PATHS = f"""{_HEAD.replace("gd AS (", "g0 AS (", 1).replace("event_id % 7 = 0 AS cut", "event_id % 7 = 0 AS cut, n // 81 % 7 = 6 AS mirror", 1)}
g1 AS (SELECT clip_id, track_id, list_sort(list(px))[1 + count(*) // 2] AS tall, count(*) AS seen FROM g0 WHERE NOT mirror GROUP BY 1, 2), g2 AS (SELECT *, max(tall) OVER (PARTITION BY clip_id) AS most FROM g1),
gd AS (SELECT g0.* EXCLUDE (mirror) FROM g0 SEMI JOIN (SELECT * FROM g2 WHERE (track_id + clip_id) % 5 = 3 OR seen >= 40 AND tall >= greatest(72, 0.4 * most)) m ON g0.clip_id = m.clip_id AND g0.track_id = m.track_id WHERE NOT mirror),
sz AS{_REST}"""
_RECORDS = f"""{_MAIN_PATHS}, st AS (SELECT clip_id, track_id, frame, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM paths WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
mv AS (SELECT clip_id, count(*) FILTER (j > 0) AS jumps FROM (SELECT clip_id, track_id, count(*) FILTER (step > height) AS j FROM st JOIN hts USING (clip_id, track_id) GROUP BY 1, 2) GROUP BY 1),
fd AS (SELECT clip_id, count(*) AS subjects, CASE WHEN bool_or(anchor_source = 'clip') THEN 'clip' ELSE 'anchor' END AS src, quantile_cont(height, 0.5) AS h FROM hts GROUP BY 1), fc AS (SELECT clip_id, coalesce(avg(CASE WHEN frame >= 16 THEN CASE WHEN feet_visible THEN 0.0 ELSE 1.0 END END), 0.0) AS feet_cut FROM paths GROUP BY 1),
pl AS (SELECT DISTINCT user_id AS clip_id, 1.5 + (user_id % 3) * 0.5 AS ch, CASE WHEN user_id % 29 = 0 THEN 'no points' END AS error, CASE WHEN user_id % 5 <> 0 THEN user_id % 4 END AS expected_persons, CASE WHEN user_id % 9 <> 0 THEN user_id % 90 + 310.0 END AS said FROM events),
al AS (SELECT pl.*, coalesce(subjects, 0) AS subjects, src, h, coalesce(jumps, 0) AS jumps, coalesce(feet_cut, 0.0) AS feet_cut, abs(360 - said) AS hd FROM pl LEFT JOIN fd USING (clip_id) LEFT JOIN mv USING (clip_id) LEFT JOIN fc USING (clip_id)),
fl AS (SELECT *, list_sort(list_filter([CASE WHEN clip_id % 17 = 0 THEN 'ground_fail' END, CASE WHEN clip_id % 13 = 0 THEN 'plane_fail' END, CASE WHEN subjects = 0 THEN 'no_anchor' END, CASE WHEN subjects <> expected_persons THEN 'count_mismatch' END], lambda x: x IS NOT NULL)) AS hard,
  list_sort(list_filter([CASE WHEN jumps > 0 THEN 'track_jump' END, CASE WHEN src = 'clip' THEN 'anchor_late' END, CASE WHEN feet_cut > 0.3 THEN 'feet_cut_later' END, CASE WHEN ch / h < 0.4 THEN 'low_camera' END, CASE WHEN hd > 60 THEN 'horizon_disagree' END], lambda x: x IS NOT NULL)) AS soft FROM al),
rc AS (SELECT clip_id, error, expected_persons, subjects AS main_subjects_final, coalesce(expected_persons = subjects, false) AS count_match_final, clip_id % 13 <> 0 AS plane_ok, clip_id % 20 / 20.0 AS inlier_ratio, CAST(clip_id % 50 AS DOUBLE) AS normal_angle_deg, CASE WHEN clip_id % 4 <> 0 THEN clip_id % 8 / 8.0 END AS normal_agreement,
  360.0 AS horizon_y_frame0, round(ch / h, 2) AS cam_height_ratio, said AS horizon_y_other, hd AS horizon_diff_px, round(feet_cut, 3) AS feet_cut_later_frac, round(coalesce(h, ch / 3), 3) AS grid_spacing, hard, soft, hard = [] AS ready FROM fl WHERE error IS NULL)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    track, clip = F.col("track_id"), F.col("clip_id")
    found = A.ground_detections(spark, d).withColumns({"main_subject_prelim": (track + clip) % 5 == 3, "dropped_reflection": track % 7 == 6})
    fits = {"inlier_ratio": clip % 20 / 20.0, "angle_deg": (clip % 50).cast("double"), "normal_agreement": F.when(clip % 4 != 0, clip % 8 / 8.0)}
    planes = A.level_planes(found).drop("horizon").withColumns(fits)
    cams = A.level_cameras(found)
    subjects, paths = clip_records.clip_subjects(found, cams, planes)
    expected = planes.select("clip_id", F.when(clip % 5 != 0, clip % 4).alias("expected_persons"))
    horizons = planes.where(clip % 9 != 0).select("clip_id", (clip % 90 + 310).cast("double").alias("horizon"))
    return clip_records.quality_records(planes, cams.where("frame = 0"), subjects, paths, expected, horizons)


_FIGURES = "rc.expected_persons, main_subjects_final, count_match_final, plane_ok, inlier_ratio, normal_angle_deg, normal_agreement, horizon_y_frame0, cam_height_ratio, horizon_y_other, horizon_diff_px, feet_cut_later_frac, grid_spacing"


@query(f"WITH {_RECORDS} SELECT pl.clip_id, pl.error, {_FIGURES}, array_to_string(hard, ',') AS hard_flags, array_to_string(soft, ',') AS soft_flags, coalesce(ready, false) AS training_ready FROM pl LEFT JOIN rc ON pl.clip_id = rc.clip_id")
def quality_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole record of every clip of the events, of its main subjects alone."""
    rows = _records(spark, d)
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws(",", c)) for c in ("hard_flags", "soft_flags")})


@query(f"""WITH {_RECORDS}, fg AS (SELECT 'records' AS figure FROM rc UNION ALL SELECT 'errors' FROM pl WHERE error IS NOT NULL UNION ALL SELECT 'ready' FROM rc WHERE ready UNION ALL SELECT 'ready_if_count_soft' FROM rc WHERE list_filter(hard, lambda x: x <> 'count_mismatch') = []
UNION ALL SELECT 'found_minus_expected:' || (main_subjects_final - expected_persons) FROM rc WHERE list_contains(hard, 'count_mismatch') UNION ALL SELECT 'inliers_below_half' FROM rc WHERE inlier_ratio < 0.5 UNION ALL SELECT 'low_camera' FROM rc WHERE cam_height_ratio < 0.4 AND cam_height_ratio <> 0
UNION ALL SELECT 'horizon_far' FROM rc WHERE horizon_diff_px > 60 UNION ALL SELECT 'hard:' || unnest(hard) FROM rc UNION ALL SELECT 'soft:' || unnest(soft) FROM rc) SELECT figure, count(*) AS clips FROM fg GROUP BY 1""")
def flag_report(spark: SparkSession, d: str) -> DataFrame:
    return clip_records.flag_report(_records(spark, d))
