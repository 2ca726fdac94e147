"""Ranks and running totals over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelyard.storage import keep, release


def hash_key(seed, salt: str, *ids: str) -> Column:
    """md5 hex of seed|salt|ids: a draw key that any SQL engine repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(i).cast("string") for i in ids]))


def hash01(key: Column) -> Column:
    """The first 8 hex digits of an md5 key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


_SHIFT = 33  # monotonically_increasing_id counts a partition's rows in its lower bits
_MASK = (1 << _SHIFT) - 1


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column], rank: str = "rank", ready: bool = False) -> DataFrame:
    """Each row's 0-based rank in the order and, by name, the totals of the values over the rows before it.

    The rows are kept first, since dealing them out by ranges samples them (ready: they are cheap to read twice, so that
    isn't needed); then they are sorted in ranges, numbered within each, and kept. A range's numbers are shifted by the counts
    and totals of the ranges before it (one row a range, so that table is bounded by the partition count and is broadcast).
    order must be total for a repeatable result; nulls of values count 0. Columns of df that have the names of results are
    replaced, all others stay. Give narrow rows: they are written twice.
    """
    df = df.drop(rank, *values)
    # whatever the columns are called, ours have longer names
    tag = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)) + "rank_"
    at, part, first = (tag + k for k in ("at", "part", "first"))
    amounts, bases = ({name: f"{tag}{kind}{i}" for i, name in enumerate(values)} for kind in ("value", "base"))
    rows = df.withColumns({amounts[name]: F.coalesce(value, F.lit(0)) for name, value in values.items()}) if values else df
    source = rows if ready else keep(rows, "to-rank")
    placed = keep(source.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")
    release(source)
    placed = placed.withColumn(part, F.shiftright(at, _SHIFT))
    so_far = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(first), *[F.sum(amounts[name]).alias(bases[name]) for name in values])
    parts = parts.select(part, *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in (first, *bases.values())])
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(parts), part).withColumn(rank, F.col(first) + F.col(at).bitwiseAND(F.lit(_MASK)))
    if values:
        out = out.withColumns({name: F.col(bases[name]) + F.coalesce(F.sum(amounts[name]).over(within), F.lit(0)) for name in values})
    return out.drop(at, part, first, *amounts.values(), *bases.values())


def running_total(df: DataFrame, order: list[Column], value: Column, rank: str = "rank", before: str = "before", ready: bool = False) -> DataFrame:
    """Each row's 0-based rank in the order and the total of value over the rows before it."""
    return running_totals(df, order, {before: value}, rank, ready)


def global_rank(df: DataFrame, *order: Column, rank: str = "rank", ready: bool = False) -> DataFrame:
    """0-based rank of each row in a total order."""
    return running_totals(df, list(order), {}, rank, ready)
