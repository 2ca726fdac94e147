import random

from reelyard.operators.manifest import REQUIRED
from reelyard.streaming import clips

INVENTORY = "clip_id string, file string, size long, valid boolean"
QC = "id string, training_ready boolean, hard_flags array<string>, soft_flags array<string>"


def test_clips_are_released_once(spark, tmp_path):
    rows = [(f"c{c:04d}", f, 10, True) for c in range(6) for f in REQUIRED if not (c == 4 and f == REQUIRED[0])] + [("c0005", "odd.txt", 1, True), ("c0004", REQUIRED[0], 0, True)]
    random.Random(1).shuffle(rows)
    for batch, part in enumerate((rows[:40], rows[40:] + rows[:10], rows[:20])):
        spark.createDataFrame(part, INVENTORY).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(INVENTORY).json(str(tmp_path / "in"))
        clips.release_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r["clip_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["c0000", "c0001", "c0002", "c0003", "c0005"]


def test_waiting_clips_expire(spark, tmp_path):
    """A clip that isn't heard of for the hold is told of once and forgotten; what a released clip gets later changes nothing."""
    half = REQUIRED[:5]
    told = [
        [("a", f, 0) for f in half] + [("b", f, 0) for f in REQUIRED],
        [("a", f, 50) for f in REQUIRED[5:7]] + [("b", REQUIRED[0], 50), ("c", half[0], 50)],
        [("d", half[0], 115), ("b", REQUIRED[1], 100)],
        [("d", half[1], 300)],
        [("d", half[1], 301)],
    ]
    seen = []
    for rows in told:
        made = spark.createDataFrame([(c, f, 1, True, m) for c, f, m in rows], INVENTORY + ", minute int")
        made.selectExpr("clip_id", "file", "size", "valid", "timestamp'2024-05-01' + make_interval(0, 0, 0, 0, 0, minute) AS arrived_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(INVENTORY + ", arrived_at timestamp").parquet(str(tmp_path / "in"))
        clips.release_once(stream, str(tmp_path / "out"), str(tmp_path / "state"), "1 hour").awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen[0] == [("b", "complete", 13)] and seen[1] == seen[0]
    assert seen[-1] == [("a", "expired", 7), ("b", "complete", 13), ("c", "expired", 1)]  # d was heard of before its time was over


def test_counters_and_manifest(spark, tmp_path):
    rows = [("1", True, [], ["low_camera"]), ("2", False, ["plane_fail"], ["low_camera"]), ("1", True, [], ["low_camera"])]
    spark.createDataFrame(rows, QC).coalesce(1).write.json(str(tmp_path / "qc"))
    stream = spark.readStream.schema(QC).json(str(tmp_path / "qc"))
    captions = spark.createDataFrame([("1", "a"), ("3", "b")], "id string, caption string")
    for name, frame, mode in (("counters", clips.flag_counters(stream), "complete"), ("ready", clips.ready_counters(stream), "complete"), ("manifest", clips.manifest_stream(stream, captions), "append")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {r["flag"]: r["count"] for r in spark.sql("SELECT * FROM counters").collect()} == {"low_camera": 2, "plane_fail": 1}
    assert {r["training_ready"]: r["count"] for r in spark.sql("SELECT * FROM ready").collect()} == {True: 1, False: 1}
    assert [r["id"] for r in spark.sql("SELECT id FROM manifest").collect()] == ["1", "1"]
