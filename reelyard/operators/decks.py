"""Exactly balanced, reproducible dealing: counts are exact, the order comes from md5 keys that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelyard.operators.rank import global_rank, hash_key


def stratum_rank(df: DataFrame, stratum: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """0-based rank in the order inside each stratum, without a task for a stratum: global rank less the stratum's first."""
    ranked = global_rank(df, *[F.col(c).asc_nulls_first() for c in stratum], *order, rank="_rank")
    if not stratum:
        return ranked.withColumnRenamed("_rank", rank)
    first = ranked.groupBy(*stratum).agg(F.min("_rank").alias("_first")).withColumnsRenamed({c: f"_{c}" for c in stratum})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stratum]
    return ranked.join(first, same).withColumn(rank, F.col("_rank") - F.col("_first")).drop("_rank", "_first", *[f"_{c}" for c in stratum])


def even_deck(df: DataFrame, values: list[str], salt: str, out: str, stratum: list[str] = (), seed=0) -> DataFrame:
    """Deal each value to floor(n/k) or ceil(n/k) rows of each stratum, in seeded order."""
    ordered = F.array_sort(F.array(*[F.struct(F.md5(F.lit(f"{seed}|{salt}|{v}")).alias("h"), F.lit(v).alias("v")) for v in values]))
    ranked = stratum_rank(df, list(stratum), [hash_key(seed, salt, "id"), F.col("id")], "_r")
    return ranked.withColumn(out, F.element_at(ordered, (F.col("_r") % len(values) + 1).cast("int")).v).drop("_r")


def weighted_counts(weights: DataFrame, n: int) -> DataFrame:
    """value, count, low, high (cumulative range) of exact counts by largest remainder, ties in listed order (pos).

    The weights are a vocabulary (value, weight, pos), so its windows are small."""
    total = Window.partitionBy()
    share = weights.withColumn("_exact", F.col("weight") * n / F.sum("weight").over(total))
    share = share.withColumn("_floor", F.floor("_exact").cast("long"))
    rest = share.withColumns({"_left": F.lit(n) - F.sum("_floor").over(total), "_n": F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), "pos"))})
    counts = rest.select("value", "pos", (F.col("_floor") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).alias("count"))
    high = F.sum("count").over(Window.orderBy("pos"))
    return counts.withColumn("high", high).withColumn("low", F.col("high") - F.col("count"))


def weighted_deck(df: DataFrame, counts: DataFrame, salt: str, out: str, seed=0) -> DataFrame:
    """Deal exact counts in seeded order: the row of rank r gets the value whose range holds r."""
    ranked = stratum_rank(df, [], [hash_key(seed, salt, "id"), F.col("id")], "_r")
    ranges = F.broadcast(counts.select(F.col("value").alias(out), "low", "high"))  # one row for each word of a vocabulary
    return ranked.join(ranges, (F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high"))).drop("_r", "low", "high")


def deal_places(cards: DataFrame, regions: DataFrame, archetypes: DataFrame, seed=None) -> DataFrame:
    """Card i (0-based in order of id) gets region i div (N/R) and archetype i mod A of the seeded vocabularies, so pairs are
    unique; an error unless R divides N and N/R < A. Vocabularies have (value); a seed shuffles them differently."""
    n, r, a = cards.count(), regions.count(), archetypes.count()
    if n % r or n // r >= a:
        raise ValueError(f"{n} cards don't divide into {r} regions with under {a} cards each")
    salt = lambda c: F.lit(c if seed is None else f"{seed}|{c}")
    shuffled = [global_rank(v.select(F.col("value").alias(c)), F.md5(F.concat_ws("|", salt(c), c)), F.col(c), rank=f"_{c}") for v, c in ((regions, "region"), (archetypes, "archetype"))]
    ranked = global_rank(cards, F.col("id")).withColumns({"_region": F.expr(f"rank div {n // r}"), "_archetype": F.col("rank") % a})
    return ranked.join(shuffled[0], "_region").join(shuffled[1], "_archetype").drop("_region", "_archetype", "rank")


def exact_sample(df: DataFrame, k: int, salt: str, seed=0, where: Column | None = None) -> DataFrame:
    """df with `chosen`: exactly min(k, candidates) rows, by the order of their keys."""
    candidates = df.where(where) if where is not None else df
    ranked = global_rank(candidates.select("id", hash_key(seed, salt, "id").alias("_h")), F.col("_h"), F.col("id")).where(F.col("rank") < k)
    return df.join(ranked.select("id", F.lit(True).alias("chosen")), "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def holdout_split(df: DataFrame, suffixes: tuple[str, ...] = ("49", "99")) -> DataFrame:
    held = F.lit(False)
    for s in suffixes:
        held = held | F.col("id").cast("string").endswith(s)
    return df.withColumn("holdout", held)


def small_stratum_plan(counts: DataFrame, small: DataFrame) -> DataFrame:
    """value, pos, count: what is left of the plan's counts for the other rows once a small stratum has its own deck (value,
    count), so that counts over all rows stay exact; an error where the small stratum takes more than the plan has.
    Both tables are vocabularies."""
    rest = counts.select("value", "pos", "count").join(small.select("value", F.col("count").alias("_used")), "value", "left")
    left = F.col("count") - F.coalesce("_used", F.lit(0))
    left = F.when(left < 0, F.raise_error(F.concat(F.lit("too many rows of the small stratum for "), F.col("value").cast("string")))).otherwise(left)
    return rest.select("value", "pos", left.alias("count"))


def exact_share_deck(df: DataFrame, some: list[str], others: list[str], share: float, salt: str, out: str, stratum: list[str] = (), seed=0) -> DataFrame:
    """Deal the values of `some` to exactly round(share * n) rows of each stratum (halves to the even number) and those of `others` to the rest, each evenly:
    hostile weather outdoors, or a share of still scenes."""
    first = [hash_key(seed, f"{salt}.share", "id"), F.col("id")]
    ranked = stratum_rank(df, list(stratum), first, "_s")
    if stratum:
        sizes = df.groupBy(*stratum).agg(F.bround(F.count(F.lit(1)) * share).cast("long").alias("_k")).withColumnsRenamed({c: f"_{c}" for c in stratum})
        ranked = ranked.join(sizes, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stratum]).drop(*[f"_{c}" for c in stratum])
    else:
        ranked = ranked.withColumn("_k", F.lit(round(df.count() * share)))
    marked = ranked.withColumn("_in", F.col("_s") < F.col("_k")).drop("_s", "_k")
    dealt = [even_deck(marked.where(F.col("_in") == flag), values, f"{salt}.{flag}", out, list(stratum), seed) for flag, values in ((True, some), (False, others)) if values]
    return (dealt[0] if len(dealt) == 1 else dealt[0].unionByName(dealt[1])).drop("_in")
