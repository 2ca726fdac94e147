"""The library's input tables from the given star schema, as projections that SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.functions.text import first_words
from reelyard.operators.manifest import REQUIRED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A small table whose rows make much work each, dealt out to a fixed number of tasks in place of one for its file."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, caption, scene (first 12 words), action (words 1 to 6), family (source)."""
    w = first_words(F.col("text"), 12)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("caption"), w.alias("w"), F.col("source").alias("family"))
    return docs.select("id", "caption", F.concat_ws(" ", "w").alias("scene"), F.concat_ws(" ", F.slice("w", 1, 6)).alias("action"), "family")


CAPTIONS = r"""captions AS (SELECT doc_id AS id, text AS caption, source AS family,
  array_to_string(list_slice(w, 1, 12), ' ') AS scene, array_to_string(list_slice(w, 1, 6), ' ') AS action
  FROM (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents))"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, cost_usd, seconds of events."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(~failed, 0.6).alias("cost_usd"), F.col("value").alias("seconds"))


SIDECARS = "sidecars AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type <> 'error' THEN 0.6 END AS cost_usd FROM events)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, track_id, frame, visible, height, foot_x: a user's events in order, 81 to a track."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    numbered = table(spark, sf_dir, "events").withColumn("n", n)
    visible = F.col("event_type") != "view"
    return numbered.select(F.col("user_id").alias("clip_id"), F.expr("n div 81").alias("track_id"), (F.col("n") % 81).alias("frame"), visible.alias("visible"), F.col("value").alias("height"), F.when(visible, F.round("value", 3)).alias("foot_x"))


DETECTIONS = """detections AS (SELECT user_id AS clip_id, n // 81 AS track_id, n % 81 AS frame, event_type <> 'view' AS visible, value AS height,
  CASE WHEN event_type <> 'view' THEN round(value, 3) END AS foot_x
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"""


def qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each order, its numbers by remainders of the keys."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 17 != 0).alias("ground_ok"), (k % 13 != 0).alias("plane_ok"), (k % 7).alias("subjects"), F.when(k % 5 != 0, k % 4).alias("expected_persons"),
        (k % 3).alias("jumps"), F.when(k % 6 == 0, "clip").otherwise("anchor").alias("anchor_source"), (k % 10 / 10.0).alias("feet_cut"), (k % 8 / 8.0).alias("cam_ratio"), F.when(k % 9 != 0, (k % 90).cast("double")).alias("horizon_diff"),
    )


QC = """qc AS (SELECT o_orderkey AS id, o_orderkey % 17 <> 0 AS ground_ok, o_orderkey % 13 <> 0 AS plane_ok, o_orderkey % 7 AS subjects,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS expected_persons, o_orderkey % 3 AS jumps, CASE WHEN o_orderkey % 6 = 0 THEN 'clip' ELSE 'anchor' END AS anchor_source,
  (o_orderkey % 10) / 10.0 AS feet_cut, (o_orderkey % 8) / 8.0 AS cam_ratio, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 90 END AS horizon_diff FROM orders),
flags AS (SELECT *, list_sort(list_filter([CASE WHEN NOT ground_ok THEN 'ground_fail' END, CASE WHEN NOT plane_ok THEN 'plane_fail' END, CASE WHEN subjects = 0 THEN 'no_anchor' END,
    CASE WHEN subjects <> expected_persons THEN 'count_mismatch' END], lambda x: x IS NOT NULL)) AS hard_flags,
  list_sort(list_filter([CASE WHEN jumps > 0 THEN 'track_jump' END, CASE WHEN anchor_source = 'clip' THEN 'anchor_late' END, CASE WHEN feet_cut > 0.3 THEN 'feet_cut_later' END,
    CASE WHEN cam_ratio < 0.4 THEN 'low_camera' END, CASE WHEN horizon_diff > 60 THEN 'horizon_disagree' END], lambda x: x IS NOT NULL)) AS soft_flags FROM qc),
demoted AS (SELECT id, list_sort(list_filter(hard_flags, lambda x: x <> 'count_mismatch')) AS hard_flags,
  list_sort(list_concat(list_concat(soft_flags, list_filter(hard_flags, lambda x: x = 'count_mismatch')), CASE WHEN subjects >= expected_persons + 5 THEN ['bystanders'] ELSE [] END)) AS soft_flags FROM flags)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, file, size, valid: the required files of each order, some missing by the md5 of key and name."""
    files = F.explode(F.array(*[F.lit(f) for f in (*REQUIRED, "control.mp4")]))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), files.alias("file"))
    h = F.md5(F.concat_ws("|", F.col("clip_id").cast("string"), "file"))
    return rows.where(h.substr(1, 2) != "00").select("clip_id", "file", F.when(h.substr(3, 2) == "00", 0).otherwise(100).cast("long").alias("size"), (h.substr(5, 2) != "00").alias("valid"))


INVENTORY = f"""inventory AS (SELECT clip_id, file, CASE WHEN h[3:4] = '00' THEN 0 ELSE 100 END AS size, h[5:6] <> '00' AS valid
  FROM (SELECT o_orderkey AS clip_id, file, md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), file)) AS h FROM orders, (SELECT unnest({[*REQUIRED, "control.mp4"]}) AS file)) WHERE h[1:2] <> '00')"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten keyframes for each supplier: a turn about the y axis by kf * k / 1000 and a centre linear in kf."""
    k = F.col("s_suppkey") % 50
    rows = dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("clip_id"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("kf"))
    a = F.col("kf") * F.col("k") / 1000.0
    c, s, o = F.cos(a), F.sin(a), F.lit(0.0)
    x, z = F.col("kf") * F.col("k") / 100.0, F.col("kf") / 10.0
    return rows.select("clip_id", "kf", F.when(F.col("kf") == 9, 80).otherwise(F.col("kf") * 9).alias("frame"), F.array(c, o, s, o, F.lit(1.0), o, -s, o, c).alias("r"), F.array(-(c * x + s * z), o, -(-s * x + c * z)).alias("t"))


def turned_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten keyframes for each supplier, out of step with its frames: cameras that look down a little and turn about the
    vertical by up to 2.45 radians between keyframes, one clip in seven with its first keyframe alone."""
    k = F.col("s_suppkey") % 50
    rows = dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("clip_id"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("kf")).where("kf = 0 or clip_id % 7 <> 0")
    a, b = F.col("kf") * F.col("k") * 0.05, F.col("k") * 0.004
    c, s, cb, sb, o = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.lit(0.0)
    r = [c, s * sb, -s * cb, o, cb, sb, s, -c * sb, c * cb]
    x, y, z = F.col("kf") * F.col("k") / 100.0, F.col("kf") % 3 / 4.0, F.col("kf") / 10.0
    t = [-(r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z) for i in range(3)]
    lens = {"fx": F.col("kf") + 500.0, "fy": F.col("kf") + 510.0, "cx": F.lit(640.0), "cy": F.lit(360.0)}
    return rows.select("clip_id", "kf", (F.col("kf") * 8 + 3 + F.col("clip_id") % 2).alias("frame"), *[v.alias(n) for n, v in lens.items()], F.array(*r).alias("r"), F.array(*t).alias("t"))


TURNED = """turned AS (SELECT s_suppkey AS clip_id, kf, kf * 8 + 3 + s_suppkey % 2 AS frame, kf * (s_suppkey % 50) * CAST(0.05 AS DOUBLE) AS a, (s_suppkey % 50) * CAST(0.004 AS DOUBLE) AS b,
  kf * (s_suppkey % 50) / 100.0 AS x, kf % 3 / 4.0 AS y, kf / 10.0 AS z FROM supplier, (SELECT unnest(range(10)) AS kf) WHERE kf = 0 OR s_suppkey % 7 <> 0)"""


def ground_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a supplier's clip, one for each of its lines: on a plane tilted by the supplier's number below a camera at the
    origin, or above it by a unit at least; with normals but in every third clip."""
    k, up = F.col("l_suppkey"), F.col("l_linenumber") > 4
    a, b, c = (k % 7 - 3) * 0.03, (k % 5 - 2) * 0.02, 1.5 + k % 4 * 0.25
    x, z = (F.col("l_partkey") * 37 % 1009) / 100.0 - 5, 4 + (F.col("l_orderkey") * 53 % 997) / 100.0
    m = F.sqrt(1 + a * a + b * b)
    rows = table(spark, sf_dir, "lineitem").select(k.alias("clip_id"), x.alias("x"), (c + a * x + b * z - F.when(up, 1 + F.col("l_quantity").cast("double") / 50).otherwise(0.0)).alias("y"), z.alias("z"), *[n.alias(f"n{i}") for i, n in zip("xyz", (a / m, -1 / m, b / m), strict=True)])
    return rows.withColumns({f"n{i}": F.when(F.col("clip_id") % 3 != 0, F.col(f"n{i}")) for i in "xyz"})


def scene_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authored scene for each customer, as JSON: none to three people with two straight keyframes, each kind of camera path,
    anchored or not, here and there with its own turn or travel; one in 23 breaks a rule."""
    k = F.col("c_custkey")
    number = lambda e: e.cast("double")

    def person(i: int):
        start, end = k % 20 + i, 81 - k % 7
        at = lambda j: F.array(number(k % 11) / 10 + 2 + i + j * 0.5071373, number(k % (5 + i)) / 4 - i * 0.7 - j * 0.2512729)
        keys = F.array(F.struct(start.alias("frame"), at(0).alias("uv")), F.struct(end.alias("frame"), at(1).alias("uv")))
        return F.struct((k % 90 * 10 + i).alias("id"), F.when(k % 3 != i, number(k % 4) / 10 + 0.7 + i * 0.01).alias("height"), F.when(k % 6 == i, 0.3).alias("radius"), F.when(k % 5 == i, k % 9).alias("color_index"), keys.alias("keyframes"))

    paths = F.array(*map(F.lit, ("static", "dolly_in", "dolly_out", "orbit", "pan", "crane")))
    camera = F.struct(
        F.when(k % 2 == 0, 900.0 + k % 100).alias("focal_px"), F.when(k % 8 != 0, number(k % 5) / 10 + 0.5).alias("height"), number(k % 13 - 6).alias("yaw_deg"), F.when(k % 10 != 0, number(k % 9) / 2).alias("pitch_deg"),
        F.when(k % 23 == 0, "spiral").otherwise(F.element_at(paths, (k % 6 + 1).cast("int"))).alias("path"), F.when(k % 4 == 1, 60.0).alias("orbit_deg"), F.when(k % 4 == 2, 0.8).alias("dolly_travel"), (k % 7 > 3).alias("anchor_first_frame"),
    )
    people = F.slice(F.array(*[person(i) for i in range(3)]), F.lit(1), (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("scene"), F.to_json(F.struct(F.lit(81).alias("n_frames"), people.alias("cylinders"), camera.alias("camera"))).alias("json"))


SCENES = """sc AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS scene, ['static', 'dolly_in', 'dolly_out', 'orbit', 'pan', 'crane'][1 + c_custkey % 6] AS path, c_custkey % 7 > 3 AS anchored FROM customer WHERE c_custkey % 23 <> 0),
pe AS (SELECT *, k % 90 * 10 + i AS cylinder, CAST(CASE WHEN k % 3 <> i THEN (k % 4) / 10.0 + 0.7 + i * 0.01 ELSE 1 END AS DOUBLE) AS height, CASE WHEN k % 5 = i THEN k % 9 END AS ci, k % 20 + i AS f0, 81 - k % 7 AS f1,
  CAST((k % 11) / 10.0 + 2 + i AS DOUBLE) AS u0, CAST((k % (5 + i)) / 4.0 - i * 0.7 AS DOUBLE) AS v0 FROM (SELECT *, unnest(range(k % 4)) AS i FROM sc)),
pp AS (SELECT *, CAST(greatest(0, least(1, (frame - f0) / CAST(f1 - f0 AS DOUBLE))) AS DOUBLE) AS part FROM (SELECT *, unnest(range(81)) AS frame FROM pe)),
po AS (SELECT k, scene, i, cylinder, frame, height, ci, u0 + 0.5071373 * part AS x, v0 - 0.2512729 * part AS y FROM pp)"""


CAMERAS = """cams AS (SELECT s_suppkey AS clip_id, kf, CASE WHEN kf = 9 THEN 80 ELSE kf * 9 END AS frame, kf * (s_suppkey % 50) / 1000.0 AS a,
  kf * (s_suppkey % 50) / 100.0 AS x, kf / 10.0 AS z FROM supplier, (SELECT unnest(range(10)) AS kf))"""


def ground_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections with pixels: the foot right and down by the event, the head above it; every seventh is cut off."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("n", n)
    u, v = (F.col("event_id") % 1280).cast("double"), (F.col("event_id") % 200 + 420).cast("double")
    return rows.select(
        F.col("user_id").alias("clip_id"), F.expr("n div 81").alias("track_id"), (F.col("n") % 81).alias("frame"), (F.col("event_type") != "view").alias("visible"), (F.col("event_id") % 7 == 0).alias("touches_bottom"),
        u.alias("foot_u"), v.alias("foot_v"), u.alias("head_u"), (v - 30).alias("head_v"), (F.col("event_id") % 150 + 60.37182818284).alias("height_px"),
    )


def level_cameras(detections: DataFrame) -> DataFrame:
    """A level camera at the origin for every frame that has detections."""
    o, i = F.lit(0.0), F.lit(1.0)
    return detections.select("clip_id", "frame").distinct().select("clip_id", "frame", F.lit(811.3037).alias("fx"), F.lit(907.7023).alias("fy"), F.lit(640.0).alias("cx"), F.lit(360.0).alias("cy"), F.array(i, o, o, o, i, o, o, o, i).alias("r"), F.array(o, o, o).alias("t"))


def level_planes(detections: DataFrame) -> DataFrame:
    """A level ground below the camera for every clip, its height and outcome by the clip's number."""
    k = F.col("clip_id")
    h = 1.5 + (k % 3) * 0.5
    rows = detections.select("clip_id").distinct()
    return rows.select("clip_id", F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("normal"), h.alias("d"), h.alias("camera_height"), (k % 13 != 0).alias("plane_ok"), (k % 17 != 0).alias("ground_ok"), F.lit(360.0).alias("horizon"), F.when(k % 29 == 0, "no points").alias("error"))


GROUND = """gd AS (SELECT user_id AS clip_id, n // 81 AS track_id, n % 81 AS frame, event_id % 7 = 0 AS cut, CAST(event_id % 1280 AS DOUBLE) AS u, CAST(event_id % 200 + 420 AS DOUBLE) AS v,
  event_id % 150 + CAST(60.37182818284 AS DOUBLE) AS px, 1.5 + (user_id % 3) * 0.5 AS ch
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE event_type <> 'view'),
sz AS (SELECT clip_id, track_id, count(*) FILTER (frame < 16) AS early, count(*) AS n, quantile_cont(px * ch / (v - 360), 0.5) FILTER (frame < 16) AS ha, quantile_cont(px * ch / (v - 360), 0.5) AS hc FROM gd WHERE NOT cut GROUP BY 1, 2),
hts AS (SELECT clip_id, track_id, CASE WHEN early >= 4 THEN ha ELSE hc END AS height, CASE WHEN early >= 4 THEN 'anchor' ELSE 'clip' END AS anchor_source FROM sz WHERE early >= 4 OR n >= 3),
raw AS (SELECT clip_id, track_id, frame, NOT cut AS feet_visible, u, CASE WHEN cut THEN v - 30 ELSE v END - 360 AS dv, CASE WHEN cut THEN ch - height ELSE ch END AS down, ch, cut, height FROM gd JOIN hts USING (clip_id, track_id)),
pos AS (SELECT clip_id, track_id, frame, feet_visible, CASE WHEN NOT cut THEN 'foot_ray' WHEN down * dv > 0 THEN 'head_ray' ELSE '' END AS method,
  CASE WHEN down * dv > 0 THEN (u - 640) / 811.3037 * down / (dv / 907.7023) END AS x, CASE WHEN down * dv > 0 THEN ch END AS y, CASE WHEN down * dv > 0 THEN down / (dv / 907.7023) END AS z FROM raw)"""
