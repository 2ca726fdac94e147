import json
import random

from pyspark.sql import functions as F

from reelyard.operators import manifest, reports
from reelyard.sources import files
from tests.test_dealing import AXES, cards


def test_checks_of_cards_count_what_is_wrong(spark):
    base = cards(spark, 324).withColumns({"region": F.when(F.expr("cast(substr(id, 2) as int) < 100"), "north").otherwise("south"), "action_family": F.lit("sprint"), "crowd": F.expr("id < 'c0010'"), "holdout": F.expr("id like '%49'")})
    rows = [r.asDict() for r in base.collect()]
    got = {r["figure"]: r["value"] for r in reports.coverage_checks(base, AXES).collect()}
    assert got["cards"] == 324 and got["pairs"] == len({(r["region"], r["archetype"]) for r in rows}) and got["region.used"] == 2 and (got["region.least"], got["region.most"]) == (100, 224)
    assert got["long_range_outside_its_sizes"] == sum(r["size"] != "large" for r in rows) and got["crowded_small_venues"] == 0
    assert got["families_that_do_not_fit"] == sum(r["size"] != "large" or r["indoor"] or r["surface"] == "ice" for r in rows) > 0
    assert got["crowds_where_none_is_natural"] == sum(r["crowd"] and not r["audience_natural"] for r in rows) and got["crowds"] == 10 and got["held_out"] == 3
    assert got["outdoor"] == sum(not r["indoor"] for r in rows) and got["hostile_percent"] == 0 and got["action_family.most"] == 324 and got["odd_surfaces"] == sum(r["surface"] != "normal" for r in rows)


def test_histograms_rank_by_count_then_text(spark):
    base = spark.createDataFrame([("a", True)] * 3 + [("b", False)] * 3 + [(None, False)], "vibe string, indoor boolean")
    got = [tuple(r) for r in reports.axis_histograms(base, ("vibe", "indoor")).orderBy("axis", "place").collect()]
    assert [(a, v, n, p) for a, v, n, _, p in got] == [("indoor", "false", 4, 1), ("indoor", "true", 3, 2), ("vibe", "a", 3, 1), ("vibe", "b", 3, 2), ("vibe", None, 1, 3)]
    assert abs(sum(r[3] for r in got) - 200) < 1e-9


def test_figures_of_acceptance(spark):
    accepted = spark.createDataFrame([(1, "a b c", "calm"), (2, "a  b", "calm"), (3, "a b c d", "tense"), (4, "x", "tense")], "id long, caption string, vibe string")
    rejects = spark.createDataFrame([(9, "too long")], "id long, reason string")
    got = {r["figure"]: (r["value"], r["detail"]) for r in reports.acceptance_figures(accepted, rejects, {"vibe": {"calm": 3, "tense": 1, "odd": 1}}).collect()}
    assert got == {"accepted": (4, None), "fewest_words": (1, None), "most_words": (4, None), "rejected": (1, None), "unresolved:9": (None, "too long"), "share:vibe=calm": (-10, None), "share:vibe=tense": (30, None), "share:vibe=odd": (-20, None)}


def test_repair_ends_when_nothing_is_rejected(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    body = lambda n: "One continuous shot of " + " ".join(draw.sample(words, n))
    card = "id long, scene string, action string, family string, caption string"
    accepted = spark.createDataFrame([(1, "s1 t1", "a1", "f", body(70))], card)
    rejects = spark.createDataFrame([(2, "x"), (3, "y"), (4, "z")], "id long, reason string")
    texts = {(1, 2): body(80), (1, 3): body(20), (1, 4): None, (2, 3): body(90), (2, 4): accepted.first()["caption"], (3, 4): body(75)}
    asked = []

    def rewrite(open_, round_):
        ids = sorted(r["id"] for r in open_.collect())
        asked.append(ids)
        return spark.createDataFrame([(i, f"s{i}{round_} t{i}", f"b{i}", "f", texts[round_, i]) for i in ids if texts[round_, i]], card)

    judge = lambda new, _: new.select("id", F.lit("ok").alias("verdict"), F.lit(None).cast("string").alias("issue"), F.lit(None).cast("string").alias("caption"))
    done, left, history = reports.repair(accepted, rejects, rewrite, judge)
    assert asked == [[2, 3, 4], [3, 4], [4]] and sorted(r["id"] for r in done.collect()) == [1, 2, 3, 4] and left.count() == 0
    assert sorted(tuple(r) for r in history.collect()) == [(1, 3, 1, 2), (2, 2, 1, 1), (3, 1, 1, 0)]
    done, left, history = reports.repair(accepted, rejects.where("id = 4"), rewrite, judge, rounds=2)
    assert [r["id"] for r in left.collect()] == [4] and "identical" in left.first()["reason"] and history.count() == 2
    assert reports.repair(accepted, rejects.limit(0), rewrite, judge)[2].count() == 0


def test_reports_of_shards_come_together(spark, tmp_path):
    first = [{"id": "c1", "training_ready": True, "inlier_ratio": 0.5}, {"id": "c2", "error": "no points", "training_ready": False}]
    second = [{"id": "c2", "training_ready": True, "inlier_ratio": 0.9}, {"id": "c3", "error": "bad json", "training_ready": False}]
    for name, rows in (("a", first), ("b", second)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r["id"]: r.asDict() for r in files.read_reports(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")).collect()}
    assert got["c1"]["inlier_ratio"] == 0.5 and got["c2"]["error"] is None and got["c2"]["training_ready"] and got["c3"]["error"] == "bad json" and got["c3"]["inlier_ratio"] is None
    clean = spark.createDataFrame([("c9", True)], "id string, training_ready boolean")
    assert reports.union_reports(clean).first()["error"] is None


def test_labels_of_motion_and_held_out_ids(spark):
    meta = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    motion = spark.createDataFrame([("a", 0.1, 1.0, True), ("b", 2.0, 9.0, False), ("z", 0.0, 0.0, True)], "clip_id string, path double, rot_deg double, static boolean")
    said = spark.createDataFrame([("a", ("orbit",), "pan"), ("b", None, "pan")], "id string, seed struct<camera: string>, camera string")
    assert sorted(tuple(r)[:2] for r in reports.motion_labels(meta, motion, said).collect()) == [("a", "orbit"), ("b", "pan")]
    rows = spark.createDataFrame([(f"c{i:04d}",) for i in range(10)], "id string")
    left = manifest.select_ids(rows, "c0002-c0005", held_out=rows.where("id = 'c0003'"))
    assert sorted(r["id"] for r in left.collect()) == ["c0002", "c0004", "c0005"]


def test_members_of_one_path_stay_a_row_each(spark):
    paths = ["clips/c0001/tracks.json", "clips/c0001/tracks.json", "_reports/a.jsonl", "_reports/a.jsonl", "clips/c001/tracks.json", "clips/c0002/other.bin"]
    got = manifest.route_members(spark.createDataFrame(list(enumerate(paths)), "id long, path string")).orderBy("id").collect()
    assert [(r["id"], r["clip_id"], r["file"], r["kind"]) for r in got] == [
        (0, "c0001", "tracks.json", "clip"), (1, "c0001", "tracks.json", "clip"), (2, None, "a.jsonl", "report"), (3, None, "a.jsonl", "report"), (4, None, "tracks.json", None), (5, "c0002", "other.bin", None),
    ]


def test_routed_members_return_each_page_once(spark, tmp_path):
    from reelyard.catalog import QUERIES

    spark.createDataFrame([(i,) for i in (1, 910001, 1820001)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r["id"] for r in QUERIES["routed_members"](spark, str(tmp_path)).collect()) == [1, 910001, 1820001]
