"""A corpus pipeline: toxic documents go, near duplicates collapse, benchmark leaks go, sources are mixed, rows are sharded."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm import decontaminate, mixing, set_join, sharding, toxicity
from reelyard.operators.rank import running_total
from reelyard.storage import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, doesn't call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, kept, so that the numbers stay the same: doc_ids may repeat or be null."""
    return keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered")


def placed_rows(docs: DataFrame) -> DataFrame:
    """The documents with _row, which tells rows apart: the file and the place in it of a table that is read as its files hold
    it, so that the texts aren't written again; any other table is numbered()."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            return docs.select(*COLUMNS, F.struct(F.unhex(F.md5("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
        except AnalysisException:  # rows that are not in files
            pass
    return numbered(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the smallest doc_id, of each component of similar rows; those with no words stay."""
    rows = numbered(docs)
    found = set_join.similarity_classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))  # of null or repeated ids too one row stays
    stay = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return rows.join(stay, "_row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes its words: the number of copies is taken / size, rounded down, or up
    for as many rows of the source, drawn by what is left of them, as bring the source's words nearest to what the mix
    takes: half a document at most. Documents without words go once."""
    rows = placed_rows(docs)
    taken = keep(mixing.mix(rows, key="_row")[0].select("_row", "row", "source_rank", "size", "taken"), "taken")
    rest = F.expr("taken % greatest(size, 1)")
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "row"), F.lit(1 << 40)) / float(1 << 40)
    spare = taken.withColumn("rest", rest).where("rest > 0").withColumn("place", draw * F.col("size") / F.col("rest"))
    ordered = running_total(spare, [F.col("source_rank"), F.col("place"), F.col("row")], F.col("size"), rank="_n", before="offset", ready=True)
    sources = ordered.groupBy("source_rank").agg(F.min("offset").alias("start"), F.sum("rest").alias("left"))
    up = ordered.join(sources, "source_rank").where("offset - start + size / 2 <= left").select("_row", F.lit(1).alias("more"))
    number = F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div greatest(size, 1)") + F.coalesce("more", F.lit(0))).cast("int")
    copies = taken.join(up, "_row", "left").select("_row", number.alias("copies")).where("copies > 0")
    mixed = rows.join(copies, "_row")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot on the Hilbert order. Rows without texts are ranked; the texts move once, when
    they meet their places."""
    rows = placed_rows(docs)
    placed = sharding.hilbert_shards(sharding.measured(rows).drop("text", "n_chars"), 8, last=("_row",))
    placed = keep(placed.select("_row", "size", "text_crc32", "hilbert", "shard", "slot"), "placed")
    return rows.join(placed, "_row").select(*COLUMNS, "size", "text_crc32", "hilbert", "shard", "slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The severity model and the hashes of the draws have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name.replace(" ", "-"))
    return docs
