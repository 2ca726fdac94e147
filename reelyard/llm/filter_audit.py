"""How the filters of a corpus act on each other in every order that they can be applied in.

Documents become masks of the filters that they fail; equal masks of a part are counted in cells, which are few whatever the
corpus holds. Cells are unpivoted against the steps of all orders, a running bit-or over a cell's steps tells what an earlier
filter removed, and conditional sums and a window over all orders of a filter give the figures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D\x20]+"


def document_filters() -> dict[str, Column]:
    """Failure conditions by letter of the filters that look at one text alone: too few words, too few distinct ones, too many
    capitals, marks of code."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = "E") -> DataFrame:
    """part, mask, good, toxic, n: how many rows of a part (lang, null: empty) fail the filters of the mask (bit i: the i-th
    filter; the last bit: `copies`, the text of a row of smaller doc_id), by their labels.

    A row with a null doc_id is no copy and makes none; rows of one doc_id are no copies of each other. A doc_id counts as
    good or toxic if any of its labels says so. Texts leave their task as hashes; rows meet their labels by doc_id, and
    copies are counted by hash, label and part before they meet, so that no group of copies comes together.
    """
    bits = sum((F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    each = rows.join(said, "doc_id", "left").select("doc_id", "part", "mask", "h", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    cell = ("part", "mask", "good", "toxic")
    if copies is None:
        return each.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    same = each.groupBy("doc_id", "h", *cell).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = same.groupBy("h", *cell).agg(F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"), F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"))
    first = F.min("first.doc_id").over(Window.partitionBy("h"))
    original = F.col("unnamed") + F.when(F.col("first.doc_id") == first, F.col("first.n")).otherwise(0)
    parted = groups.select(*cell, "n", original.alias("original"))
    counted = parted.groupBy(*cell).agg(F.sum("original").alias("original"), F.sum(F.col("n") - F.col("original")).alias("copied"))
    both = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.col("copied").alias("n")))
    return counted.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "c.mask", "good", "toxic", "c.n")


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of cells (part, mask, good,
    toxic, n), bit i of a mask standing for letters[i]: a row for each part, order of the letters and step from 1."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("_i", "letter"))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)]), F.col("letter"))
    steps = steps.withColumns({"step": F.col("_i") + 1, "bit": bit}).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    so_far = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("gone", F.coalesce(F.bit_or("hit").over(so_far), F.lit(0)) != 0)
    fails, here = F.col("hit") != 0, (F.col("hit") != 0) & ~F.col("gone")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    rows = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~F.col("gone")).alias("kept"), total(here).alias("removed"), total(fails & F.col("gone")).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over the rows of docs: A to D of document_filters(), E copies of earlier texts.

    Null texts count as empty and null langs as an empty part; repeated rows each count; an empty table has no parts and no
    rows; columns other than doc_id, text, lang of docs and doc_id, quality, toxic of labels aren't read.
    """
    filters = document_filters()
    return audit(failure_cells(docs, labels, filters), "".join(filters) + "E")


OP13_SQL = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT w.doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2, 3, 4),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k), o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT *, mask & (1 << (ascii(letter) - 65)) AS hit FROM (SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS letter FROM c, o, (SELECT unnest(range(1, 6)) AS step))),
g AS (SELECT *, coalesce(bit_or(hit) OVER (PARTITION BY part, mask, good, toxic, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <> 0 AS gone FROM s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (hit = 0 AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit <> 0 AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit <> 0 AND gone), 0) AS redundant, coalesce(sum(n) FILTER (mask = hit AND hit <> 0), 0) AS unique_fails,
  coalesce(sum(n) FILTER (hit <> 0 AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit <> 0 AND NOT gone AND toxic), 0) AS toxic_lost FROM g GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
