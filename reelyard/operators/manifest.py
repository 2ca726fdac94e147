"""File inventory, quality flags, manifests and run summaries of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The files that a finished clip has, and the flags that training tolerates.
REQUIRED = "tracks.json ground_points.npz cams10.npz background.png background_mask.png ground_mask.png ground_agent.json clip81.txt qc_step0.json qc_step1.json qc_step2.json qc_step3.json qc_step3a.json".split()


def route_members(members: DataFrame) -> DataFrame:
    """members (path and others) with clip_id, file, kind: wanted files of a clip folder (c and 4 digits), reports, else dropped
    (kind null). A row each, also where paths repeat."""
    parts = F.split("path", "/")
    clip = F.get(F.filter(parts, lambda p: p.rlike("^c[0-9]{4}$")), F.lit(0))
    name = F.element_at(parts, -1)
    kind = F.when(F.get(F.reverse(parts), F.lit(1)) == "_reports", F.when(name.endswith(".jsonl"), "report")).when(clip.isNotNull() & name.isin(REQUIRED), "clip")
    return members.withColumns({"clip_id": clip, "file": name, "kind": kind})


def missing_files(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """clip_id, missing (sorted), absent, complete of every expected clip; a file counts if it is valid and not empty."""
    good = inventory.where(F.col("valid") & (F.col("size") > 0) & F.col("file").isin(REQUIRED)).groupBy("clip_id").agg(F.collect_set("file").alias("have"))
    joined = expected.join(good, "clip_id", "left")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("have", F.array().cast("array<string>"))))
    return joined.select("clip_id", missing.alias("missing"), F.col("have").isNull().alias("absent"), (F.size(missing) == 0).alias("complete"))


def _flags(*pairs: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(when, name) for name, when in pairs])))


def qc_flags(qc: DataFrame) -> DataFrame:
    """qc with hard_flags, soft_flags (sorted) and training_ready: no hard flag."""
    known = F.col("expected_persons").isNotNull()
    hard = _flags(("ground_fail", ~F.coalesce("ground_ok", F.lit(False))), ("plane_fail", ~F.coalesce("plane_ok", F.lit(False))), ("no_anchor", F.coalesce("subjects", F.lit(0)) == 0), ("count_mismatch", known & (F.col("subjects") != F.col("expected_persons"))))
    soft = _flags(("track_jump", F.col("jumps") > 0), ("anchor_late", F.col("anchor_source") == "clip"), ("feet_cut_later", F.col("feet_cut") > 0.3), ("low_camera", F.col("cam_ratio") < 0.4), ("horizon_disagree", F.col("horizon_diff") > 60))
    return qc.withColumns({"hard_flags": hard, "soft_flags": soft}).withColumn("training_ready", F.size("hard_flags") == 0)


def demote_flags(qc: DataFrame, names: tuple[str, ...] = ("count_mismatch",), bystanders: int = 5) -> DataFrame:
    """Named hard flags become soft; `bystanders` more subjects than expected add a soft flag; ready follows."""
    names_ = F.array(*map(F.lit, names))
    extra = F.when(F.col("subjects") >= F.col("expected_persons") + bystanders, F.array(F.lit("bystanders"))).otherwise(F.array().cast("array<string>"))
    soft = F.array_sort(F.array_union(F.array_union("soft_flags", F.array_intersect("hard_flags", names_)), extra))
    return qc.withColumns({"soft_flags": soft, "hard_flags": F.array_sort(F.array_except("hard_flags", names_))}).withColumn("training_ready", F.size("hard_flags") == 0)


def flag_summary(qc: DataFrame) -> DataFrame:
    """kind, flag, clips: counts for each hard and soft flag."""
    each = qc.select(F.explode(F.array(F.struct(F.lit("hard").alias("kind"), F.col("hard_flags").alias("flags")), F.struct(F.lit("soft").alias("kind"), F.col("soft_flags").alias("flags")))).alias("f"))
    return each.select("f.kind", F.explode("f.flags").alias("flag")).groupBy("kind", "flag").agg(F.count(F.lit(1)).alias("clips"))


def build_manifest(captions: DataFrame, qc: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, caption, training_ready, hard_flags, soft_flags, holdout: ready needs the control and background files too."""
    have = inventory.where("valid").groupBy(F.col("clip_id").alias("id")).agg(F.max((F.col("file") == "control.mp4").cast("int")).alias("control"), F.max((F.col("file") == "background.png").cast("int")).alias("background"))
    joined = captions.join(qc, "id").join(have, "id", "left")
    ready = F.col("training_ready") & (F.coalesce("control", F.lit(0)) == 1) & (F.coalesce("background", F.lit(0)) == 1)
    held = F.col("id").endswith("49") | F.col("id").endswith("99")
    return joined.select("id", "caption", ready.alias("training_ready"), "hard_flags", "soft_flags", held.alias("holdout"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    ready, held = F.col("training_ready"), F.col("holdout")
    calm = ~F.array_contains("soft_flags", "bystanders")
    return manifest.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ready & ~held).alias("train_ready"), F.count_if(ready & held).alias("holdout_ready"), F.count_if(ready & ~held & calm).alias("without_bystanders"))


def spend_summary(sidecars: DataFrame, wanted: DataFrame, price: float = 0.1, seconds: float = 6.0) -> DataFrame:
    """status, clips, cost of the sidecars, and the wanted clips still to do at their estimate."""
    spent = sidecars.groupBy("status").agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost"))
    todo = wanted.join(sidecars.where("status = 'ok'").select("id"), "id", "left_anti")
    return spent.unionByName(todo.agg(F.lit("todo").alias("status"), F.count(F.lit(1)).alias("clips"), F.round(F.count(F.lit(1)) * price * seconds, 4).alias("cost")))


def uncached_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """key and id of the requests whose content hash (24 hex digits) the cache lacks."""
    fields = ("backend", "model", "system", "user", "schema", "effort")
    keyed = requests.select("id", F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in fields]), 256), 1, 24).alias("key"))
    return keyed.join(cache.select("key"), "key", "left_anti")


def oversample_moving(meta: DataFrame, motion: DataFrame) -> DataFrame:
    """Every row, those of moving clips twice."""
    joined = meta.join(motion.select("id", "static"), "id", "left")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.coalesce("static", F.lit(True)), 1).otherwise(2)))).drop("static")


def select_ids(df: DataFrame, spec: str, held_out: DataFrame | None = None) -> DataFrame:
    """Rows whose id is in a spec: a range "cAAAA-cBBBB", both ends included, or a list by commas; without held out ids (id)."""
    if held_out is not None:
        df = df.join(held_out.select("id"), "id", "left_anti")
    low, dash, high = spec.partition("-")
    if dash:
        return df.where(F.col("id").between(low.strip(), high.strip()))
    return df.where(F.col("id").isin([x.strip() for x in spec.split(",") if x.strip()]))


def todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The wanted rows whose id isn't done."""
    return wanted.join(done.select("id"), "id", "left_anti")


def generation_requests(captions: DataFrame, done: DataFrame, params: dict[str, str]) -> DataFrame:
    """id, payload (JSON: prompt, seed = the id's number, fixed parameters) of captions that aren't done."""
    seed = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    fields = [F.col("caption").alias("prompt"), seed.alias("seed"), *[F.lit(v).alias(k) for k, v in sorted(params.items())]]
    return todo(captions, done).select("id", F.to_json(F.struct(*fields)).alias("payload"))


def usage_summary(cache: DataFrame) -> DataFrame:
    """calls, cached, input_tokens, output_tokens, cached_tokens of a table of answered requests; nulls count 0."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")]
    return cache.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cached_tokens") > 0).alias("cached"), *total)


def intake_summary(members: DataFrame) -> DataFrame:
    """archive, ok, bad (sorted), clips of the members (archive, clip_id, file, valid) of each archive."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("file"))))
    return members.groupBy("archive").agg(F.count_if("valid").alias("ok"), bad.alias("bad"), F.count_distinct("clip_id").alias("clips"))


def union_clips(members: DataFrame) -> DataFrame:
    """The clips that any archive touches, each once."""
    return members.where("clip_id is not null").select("clip_id").distinct()


def resolve_paths(rows: DataFrame, root: str, names: tuple[str, ...] = ("video", "control", "reference")) -> DataFrame:
    """rows with their relative paths joined to a root; null stays null."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), c)) for c in names if c in rows.columns})
