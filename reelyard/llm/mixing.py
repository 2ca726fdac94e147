"""Mixing sources to target weights, in DataFrame functions only.

Each source's words form one stream that is packed into blocks of a fixed number of words. A source's target decides how
many block slots it gets; how many of these each output shard takes is a multinomial draw, which gives it a run of slots, and a
slot's number goes through the source's own pseudorandom permutation of block numbers. Blocks and documents meet in a join
by block number.

A free multinomial draw of the source of every slot would miss the targets by the square root of the counts and could push
a source above twice its size; so the draw is made conditional on the sources' totals, which leaves each shard's source
counts multinomial given these totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelyard.operators.rank import running_total, running_totals
from reelyard.storage import keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 64
SHARDS = 64
SEED = 7
CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to targets, and source_start, the sizes of the sources before: weights repeat in code point order of the sources, null last; targets share
    `share` of all sizes by weight, stop at `cap` times the source's size, and what is cut goes to the others by weight.

    Sources fill in the order of cap to weight, so one pass of running totals finds the level that all uncapped ones share.
    """
    named = running_total(sizes, [F.col("source").asc_nulls_last()], F.col("source_size"), rank="source_rank", before="source_start", ready=True)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    named = named.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(cap)})
    named = named.withColumn("fills_at", F.col("cap") / F.col("weight"))
    weighed = running_totals(named, [F.col("fills_at"), F.col("source_rank")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, rank="_n", ready=True)
    all_of = weighed.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    weighed = weighed.join(F.broadcast(all_of))  # one row
    level = (F.col("_all") * share - F.col("cap_before")) / (F.col("_weights") - F.col("weight_before"))
    # the level at the first source, in that order, that doesn't fill holds for all after it
    full = F.col("fills_at") <= level
    bound = weighed.withColumn("_level", F.when(~full, level)).agg(F.min(F.struct(F.when(F.col("_level").isNull(), 1).otherwise(0).alias("none"), F.col("fills_at"), F.col("source_rank"), F.col("_level"))).alias("_first"))
    weighed = weighed.join(F.broadcast(bound))
    target = F.least(F.col("cap"), F.coalesce(F.col("_first._level") * F.col("weight"), F.col("cap")))
    return weighed.select("source", "source_rank", "source_size", "source_start", "weight", target.alias("target"))


def permuted(index: Column, n: Column, seed: Column, back: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1 for each seed, or its inverse: a Feistel network over a grid that just covers
    n, walked until the value is below n (the grid has fewer than sqrt(n) + 1 cells too many)."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    tall = F.ceil(n / wide).cast("long")
    sign = -1 if back else 1

    def half(h: int):
        if h % 2 == 0:
            return lambda s: F.struct(F.pmod(s.l + sign * F.pmod(F.xxhash64(seed, F.lit(h), s.r), wide), wide).alias("l"), s.r.alias("r"))
        return lambda s: F.struct(s.l.alias("l"), F.pmod(s.r + sign * F.pmod(F.xxhash64(seed, F.lit(h), s.l), tall), tall).alias("r"))

    def step(x: Column) -> Column:
        state = F.array(F.struct(F.floor(x / tall).cast("long").alias("l"), (x % tall).alias("r")))
        for h in range(3, -1, -1) if back else range(4):
            state = F.transform(state, half(h))
        return F.transform(state, lambda s: s.l * tall + s.r)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(index), lambda x, _: F.when(x < n, x).otherwise(step(x)))


def shard_counts(sized: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source_rank, shard, n, first: how many slots of each source each output shard takes, and the first of them. The counts of
    a source are a multinomial draw over the shards: of as many trials, each by hash, as the source has slots."""
    trials = sized.where("slots > 0").select("source_rank", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    # dealt out in chunks, so that one large source doesn't make all its trials in one task
    trials = trials.repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_rank", "chunk")
    trials = trials.select("source_rank", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")).alias("trial"))
    drawn = trials.groupBy("source_rank", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source_rank", "trial"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return drawn.withColumn("first", F.coalesce(F.sum("n").over(so_far), F.lit(0)))


def block_slots(targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per block slot: source_rank, slot, shard, block, words (how many leading words of the block it takes).

    Whole passes over a source take each of its blocks; the rest of its target takes blocks in permuted order, the last
    one cut to the word, so a source's words equal its rounded target.
    """
    sized = targets.where("source_size > 0").select(
        "source_rank",
        F.col("source_size").alias("words"),
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
        F.least(F.round("target").cast("long"), (F.col("source_size") * CAP).cast("long")).alias("want"),
    )
    sized = sized.withColumns({"passes": F.expr("want div words"), "rest": F.expr("want % words")})
    last = F.col("words") - (F.col("blocks") - 1) * block  # the source's last block may be short
    # slots of the broken pass: enough blocks for `rest` words, one more where the short block may be among them
    sized = sized.withColumns({"last": last, "extra": F.least(F.col("blocks"), F.ceil(F.col("rest") / block).cast("long") + F.when(F.col("rest") > 0, 1).otherwise(0))})
    sized = sized.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("extra"))
    last_key = F.xxhash64(F.lit(seed), F.col("source_rank"), F.col("passes"))
    sized = sized.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), last_key, back=True))
    counts = shard_counts(sized, shards, seed)
    chunks = sized.join(counts, "source_rank").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    chunks = chunks.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_rank", "shard", "chunk")
    slots = chunks.withColumn("slot", F.explode(F.expr(f"sequence(first + chunk * {CHUNK}, first + least(n, (chunk + 1) * {CHUNK}) - 1)")))
    key = F.xxhash64(F.lit(seed), F.col("source_rank"), F.expr("slot div blocks"))
    slots = slots.withColumn("block", permuted(F.expr("slot % blocks"), F.col("blocks"), key))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block))
    slots = slots.withColumn("length", length)
    # in the broken pass, slot i (from 0) has i blocks before it, one of them short if the short block came earlier
    at = F.col("slot") - F.col("passes") * F.col("blocks")
    broken = F.col("slot") >= F.col("passes") * F.col("blocks")
    before = at * block - F.when(F.col("short_at") < at, block - F.col("last")).otherwise(0)
    words = F.when(broken, F.least(F.col("length"), F.greatest(F.lit(0), F.col("rest") - before))).otherwise(F.col("length"))
    return slots.select("source_rank", "slot", "shard", "block", words.cast("int").alias("words")).where("words > 0")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): each document with size, source_rank, source_size, target and taken, and the mix itself.

    pieces says what output shard holds what: shard, source_rank, slot, block, doc_id, from_word, n_words. A document's
    taken is the words of its pieces, repeats counted. A null text has no words; a null source is a source of its own,
    after all others; documents without words and sources without words take part with size 0 and taken 0; each repeated
    row counts by itself; an empty table gives empty results. Only doc_id, text and source are read, and the column `key`,
    which goes with the documents and orders repeated rows.
    """
    keys = [key] if key else []
    light = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keys), "sizes")
    targets = keep(source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    ordered = running_total(light, [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("size"), *map(F.col, keys)], F.col("size"), rank="row", before="offset", ready=True)
    joined = ordered.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")), "left")
    rows = joined.select("o.doc_id", *[f"o.{k}" for k in keys], "o.size", "o.row", (F.col("o.offset") - F.col("t.source_start")).alias("at"), "t.source_rank", "t.source_size", "t.target")
    spans = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    # both sides grow after their last exchange, so their sizes there must not decide on a broadcast
    met = spans.join(block_slots(targets, block, shards, seed).hint("merge"), ["source_rank", "block"])
    low, high = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    pieces = met.select("shard", "source_rank", "slot", "block", "row", "doc_id", (low - F.col("at")).alias("from_word"), (high - low).alias("n_words")).where("n_words > 0")
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    documents = rows.join(taken, "row", "left").select("doc_id", *keys, "size", "source_rank", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row")
    return documents, pieces


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    documents, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
