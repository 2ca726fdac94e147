"""Reading and writing the documents, arrays and folders of a clip job."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from reelyard.operators.reports import union_reports


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in sorted order, UTF-8 kept."""
    df.select(*sorted(df.columns)).write.json(path)


def read_vocab(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A vocabulary that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_clip_json(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One nested document for each clip folder; the folder is the clip_id."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}").withColumn("clip_id", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1))


def read_sidecars(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The records that a generation run left beside its clips, one JSON document a file; id is the name of the file where the
    record has none. Fields that a record lacks are null."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    return rows.withColumn("id", F.coalesce(F.col("id").cast("string"), name) if "id" in rows.columns else name)


def read_clip_points(spark: SparkSession, root: str, name: str = "ground_points.npz") -> DataFrame:
    """clip_id, pt, x, y, z, nx, ny, nz from the arrays of each clip; normals are optional, a broken file gives no rows."""
    files = spark.read.format("binaryFile").load(f"{root}/*/{name}").select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("clip_id"), "content")

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for clip, content in zip(batch["clip_id"], batch["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                        xyz = np.asarray(arrays["points"], np.float64)
                        normals = np.asarray(arrays["normals"], np.float64) if "normals" in arrays else np.full_like(xyz, np.nan)
                except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, zlib.error):
                    continue
                part = pd.DataFrame(np.hstack((xyz, normals)), columns=["x", "y", "z", "nx", "ny", "nz"])
                part.insert(0, "clip_id", clip)
                part.insert(1, "pt", np.arange(len(part)))
                yield part

    return files.mapInPandas(points, "clip_id string, pt long, x double, y double, z double, nx double, ny double, nz double")


def validate_payloads(files: DataFrame) -> DataFrame:
    """path, size, valid of binary files (path, content): not empty, and JSON parses, NPZ loads, PNG is whole.

    Spark's scan leaves files of no bytes out, so they count as missing."""

    @F.pandas_udf("boolean")
    def sound(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(path: str, content: bytes | None) -> bool:
            if not content:
                return False
            try:
                if path.endswith(".json"):
                    json.loads(content)
                elif path.endswith(".npz"):
                    with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                        all(arrays[k] is not None for k in arrays.files)
                elif path.endswith(".png"):
                    return content.startswith(b"\x89PNG\r\n\x1a\n") and content.rstrip(b"\0")[-8:-4] == b"IEND"
            except (ValueError, OSError, EOFError, KeyError, zipfile.BadZipFile, zlib.error):
                return False
            return True

        return pd.Series([one(p, c) for p, c in zip(paths, contents, strict=True)])

    return files.select("path", F.coalesce(F.length("content"), F.lit(0)).alias("size"), sound("path", "content").alias("valid"))


def append_reports(df: DataFrame, path: str) -> None:
    """Records of one run, added to those of others."""
    df.write.mode("append").json(path)


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """The records that the shards of a run appended, as reports.union_reports() puts them together."""
    return union_reports(*[spark.read.json(p) for p in paths])


def read_train_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV (with a header) or JSON annotations; a missing type is an image."""
    rows = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.option("multiLine", True).json(path)
    return rows.withColumn("type", F.coalesce("type", F.lit("image")) if "type" in rows.columns else F.lit("image"))


def write_training_set(manifest: DataFrame, out: str) -> None:
    """Ready training rows, those without bystanders, and the hold-out ids."""
    ready = manifest.where("training_ready and not holdout")
    ready.write.json(f"{out}/metadata")
    ready.where(~F.array_contains("soft_flags", "bystanders")).write.json(f"{out}/metadata_without_bystanders")
    manifest.where("training_ready and holdout").select("id").write.json(f"{out}/holdout_ids")
