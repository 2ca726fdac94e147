"""Exact similarity join of shingle sets by set relations.

Documents with equal sets are one class. The classes' sets share one order of shingles, by rising frequency among the very
frequent ones and by hash before these; two similar sets share one of the first shingles of both (prefix filter), so
postings of these prefixes are dealt by shingle. A list's entries are ordered by set size, and what sizes and positions rule
out is skipped as a block: a set meets none of the entries after the first that is too large for it, and an entry too far
down its own set meets larger sets' entries only.

In short lists all pairs that pass are candidates. A long list is settled by relations to leaders: its sets are compared with
a leader first, similar ones join its component, and whatever is inside one component needs no more answers, since what
matters of a set highly similar to its leader follows from the leader's. Lists in which several components still meet go on
with leaders of their largest component. What is left at last is compared in full, in cells of bounded size: the sets outside the
largest component with one another and with its members, as far as the bounds let pairs pass. Where a set still has MANY
partners of one component, it is compared with the whole component, of which the members come in blocks, so that these pairs
are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.components import components
from reelyard.llm.members import Members
from reelyard.llm.words import columns, mix, shingle_hashes, to_bytes, word_hashes
from reelyard.storage import keep, release

WIDTH = 5
SHORT = 8
HOT = 50_000
SALTS = 16
CELL = 4096
BLOCK = 512
FREQUENT = 48
FREQUENT_ROWS = 200_000
FLUSH = 1 << 18
FLUSH_SETS = 1 << 16
MANY = 16
FEW_IDS = 300_000
LEADERS = 1
_TOP = np.uint64(1) << np.uint64(63)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; 63 bits."""
    return np.unique(shingle_hashes(word_hashes(to_bytes(text)), width) >> np.uint64(1))


def frequent_shingles(docs: DataFrame, least: int = FREQUENT, rows: int = FREQUENT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most `rows` frequent shingles, rarest first, and their counts as far as seen. They only order the sets (any order gives the same answers), so each
    task may report what it saw often, and what is rare everywhere stays out."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        waiting = 0

        def merged(drop: int):
            both, inverse = np.unique(np.concatenate((keys, *fresh)), return_inverse=True)
            n = np.bincount(inverse, np.concatenate((counts, np.ones(sum(map(len, fresh)), np.int64))), len(both)).astype(np.int64)
            return both[n > drop], n[n > drop]

        for (texts,) in columns(batches, "text"):
            for text in texts:
                fresh.append(shingle_set(text))
                waiting += len(fresh[-1])
                if waiting > FLUSH:
                    (keys, counts), fresh, waiting = merged(1), [], 0
        keys, counts = merged(7)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    seen = docs.select("text").mapInArrow(often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = seen.where(F.col("n") >= least).orderBy(F.col("n").desc(), "shingle").limit(rows).toPandas()
    top = top.sort_values(["n", "shingle"])
    return top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)


class Order:
    """The common order of shingles: by hash, then the frequent ones by their place in the list."""

    def __init__(self, frequent: np.ndarray):
        place = np.argsort(frequent, kind="stable")
        self.known, self.place = frequent[place], place.astype(np.uint64)

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        """The first shingles of a set of n: n - ceil(3n/4) + 1 of them, in order."""
        keys = shingles
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            keys = np.where(self.known[at] == shingles, _TOP | self.place[at], shingles)
        n = len(shingles)
        first = n - (3 * n + 3) // 4 + 1 if n else 0
        order = np.argpartition(keys, first - 1)[:first] if 0 < first < n else np.arange(n)
        return shingles[order[np.argsort(keys[order], kind="stable")]]


def _five(x: np.ndarray) -> bytes:
    """40 bits of each shingle: postings that agree in them by chance are candidates that the check refuses."""
    return mix(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def parity_bits(shingles: np.ndarray) -> bytes:
    """For each of b = 2**k >= 2n values of the leading bits of a scrambled hash, whether an odd number of shingles has it.

    Of two sets at least as many shingles are in one only as their bitmaps differ in bits. Halving b adds neighbouring bits,
    so sets of different b compare at the smaller one.
    """
    size = max(8, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 8
    at = mix(shingles ^ np.uint64(0x5BF03635)) >> np.uint64(64 - (size.bit_length() - 1))
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def most_common(n1: int, bits1: bytes, n2: int, bits2: bytes) -> int:
    """No fewer than the sets have in common."""
    x, y = np.frombuffer(bits1, np.uint8), np.frombuffer(bits2, np.uint8)
    if len(x) != len(y):
        small = min(len(x), len(y))
        x, y = (np.packbits(np.bitwise_xor.reduce(np.unpackbits(b).reshape(small * 8, -1), axis=1)) if len(b) > small else b for b in (x, y))
    return min(n1, n2, (n1 + n2 - int(np.bitwise_count(x ^ y).sum())) // 2)


def digests(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, h1, h2 (hash of the set), prefix, bits of every row of docs."""
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            sets = [shingle_set(t) for t in texts]
            hashes = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([_five(order.value.prefix(s)) for s in sets], pa.binary()), pa.array([parity_bits(s) for s in sets], pa.binary())], ["doc_id", "n", "h1", "h2", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix binary, bits binary")


def postings(classes: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """The prefixes' postings in blobs by bucket: ids and sizes of sets, and for each posting a set's number, place, token.

    A posting's place is stored up to 65535 (a lower place only loosens the bounds). Tokens that are hot, very frequent ones,
    are dealt over SALTS buckets by set."""
    shared = classes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, tokens = [], [], []
        waiting = 0

        def flush():
            length = np.array([len(t) for t in tokens])
            token, which = np.concatenate(tokens), np.repeat(np.arange(len(tokens), dtype=np.uint16), length)
            place = np.minimum(np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length), 65535).astype(np.uint16)
            all_ids, all_sizes = np.array(ids, np.int64), np.array(sizes, np.uint32)
            salt = np.where(np.isin(token, shared.value), mix(all_ids.view(np.uint64))[which] % np.uint64(SALTS), np.uint64(0))
            bucket = ((token + salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                part = order[edges[b] : edges[b + 1]]
                if len(part):
                    here, number = np.unique(which[part], return_inverse=True)
                    raw = token[part].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    rows.append((b, all_ids[here].tobytes(), all_sizes[here].tobytes(), number.astype(np.uint16).tobytes(), place[part].tobytes(), raw))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], ["bucket", "ids", "sizes", "number", "place", "token"])

        for part_ids, part_sizes, prefixes in columns(batches, "rep", "n", "prefix"):
            for i, n, raw in zip(part_ids, part_sizes, prefixes, strict=True):
                ids.append(i)
                sizes.append(n)
                tokens.append(_from_five(raw))
                waiting += len(tokens[-1])
            if waiting > FLUSH or len(ids) > FLUSH_SETS - 256:
                yield flush()
                ids, sizes, tokens, waiting = [], [], [], 0
        if ids:
            yield flush()

    return classes.mapInArrow(run, "bucket int, ids binary, sizes binary, number binary, place binary, token binary")


def may_pass(n1, p1, n2, p2):
    """Whether sets of sizes n1 <= n2 that share the shingles at these places, and none before, can be similar: by their
    sizes, by the shorter index prefix that the smaller set needs, and by what can follow."""
    need = (3 * (n1 + n2) + 6) // 7
    return (4 * n1 >= 3 * n2) & (p1 <= n1 - (6 * n1 + 6) // 7) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= need)


def meetings(group: np.ndarray, n: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) places of entries of one group, of different kinds, that pass the bounds. The entries come by group,
    then size. An entry whose place is beyond its set's index prefix starts no pair; one that met a set too large for it, or
    the group's end, is skipped from there on."""
    live = np.flatnonzero(place <= n - (6 * n + 6) // 7)
    # of equal sizes either may be the smaller: let entries also look back among these
    found, step = [], 0
    while len(live):
        step += 1
        live = live[live + step < len(n)]
        live = live[(group[live] == group[live + step]) & (4 * n[live] >= 3 * n[live + step])]
        good = live[may_pass(n[live], place[live], n[live + step], place[live + step]) & (kind[live] != kind[live + step])]
        found.append((good, good + step))
    live, step = np.flatnonzero(place <= n - (6 * n + 6) // 7), 0
    while len(live):
        step += 1
        live = live[live - step >= 0]
        live = live[(group[live] == group[live - step]) & (n[live] == n[live - step])]
        good = live[may_pass(n[live], place[live], n[live - step], place[live - step]) & (kind[live] != kind[live - step])]
        found.append((good - step, good))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f for f, _ in found)]), np.concatenate([none, *(g for _, g in found)])


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)


def list_pairs(blobs: DataFrame, buckets: int, short: int, hot: np.ndarray) -> DataFrame:
    """From each shingle's list: a, b (pairs to check; token null) of short lists, and of long ones the pairs with two
    leaders; and the entries a, n, place, token of long ones."""
    shared = blobs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for ids, sizes, number, place, token in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "sizes", "number", "place", "token")), strict=True):
                which = np.frombuffer(number, np.uint16)
                parts.append((np.frombuffer(ids, np.int64)[which], np.frombuffer(sizes, np.uint32)[which].astype(np.int64), np.frombuffer(place, np.uint16).astype(np.int64), _from_five(token)))
        if not parts:
            return
        ids, n, place, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, n, token))
        ids, n, place, token = ids[order], n[order], place[order], token[order]
        edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        count = np.repeat(np.diff(edges), np.diff(edges))
        lengthy = (count > short) | np.isin(token, shared.value)
        brief = (count > 1) & ~lengthy
        one, two = meetings(token[brief], n[brief], place[brief], ids[brief])
        pairs = [np.stack((ids[brief][one], ids[brief][two]), axis=1)]
        ids, n, place, token = ids[lengthy], n[lengthy], place[lengthy], token[lengthy]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        if len(starts):
            lot, size = mix(ids.view(np.uint64)), np.diff(np.concatenate((starts, [len(token)])))
            by = np.lexsort((lot, np.repeat(np.arange(len(starts)), size)))
            for at in (by[starts], by[starts + size - 1]):  # the least and the greatest by lot lead
                lead = np.repeat(at, size)
                fits = (ids != ids[lead]) & (4 * np.minimum(n, n[lead]) >= 3 * np.maximum(n, n[lead]))
                pairs.append(np.stack((ids[fits], ids[lead][fits]), axis=1))
        found = np.concatenate(pairs)
        found = _distinct_pairs(found[:, 0], found[:, 1])
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), none, none, none], ["a", "b", "n", "place", "token"])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(n), pa.array(place), pa.array(token.view(np.int64))], ["a", "b", "n", "place", "token"])

    return blobs.repartitionById(buckets, "bucket").mapInArrow(run, "a long, b long, n long, place long, token long")


def possible(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, most: the pairs (a, b) whose bitmaps leave it possible that their similarity is num / den or more, with the
    greatest similarity that these leave possible; others can't be so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n1, n2, left, right in columns(batches, "a", "b", "n1", "n2", "left", "right"):
            most = [most_common(*x) for x in zip(n1, left, n2, right, strict=True)]
            ok = [den * m >= num * (x + y - m) for m, x, y in zip(most, n1, n2, strict=True)]
            bound = [m / (x + y - m) for m, x, y in zip(most, n1, n2, strict=True)]
            kept = [[v for v, good in zip(side, ok, strict=True) if good] for side in (a, b, bound)]
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.float64())], ["a", "b", "most"])

    one, two = (bits.select(F.col("rep").alias(k), F.col("n").alias(n), F.col("bits").alias(side)) for k, n, side in (("a", "n1", "left"), ("b", "n2", "right")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "left", "right").mapInArrow(run, "a long, b long, most double")


def full_sets(docs: DataFrame, ids: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """id, set of the documents with these ids. Texts aren't shuffled: up to `few` ids go to all tasks, and beyond that a bitmap
    of them, of bounded size, says which texts can be wanted."""
    wanted = keep(ids.distinct(), "wanted")
    texts = docs.select(F.col("doc_id").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts_ in columns(batches, "id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([shingle_set(t).tobytes() for t in texts_], pa.binary())], ["id", "set"])

    if wanted.count() <= few:
        made = texts.join(F.broadcast(wanted), "id", "left_semi").mapInArrow(run, "id long, set binary")
    else:
        made = Members.of(wanted, "id").filter(texts, "id").mapInArrow(run, "id long, set binary").join(wanted, "id", "left_semi")
    made = keep(made, "sets")
    release(wanted)
    return made


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection), either (of the union) of each pair (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in columns(batches, "a", "b", "left", "right"):
            one, two = [[np.frombuffer(x, np.uint64) for x in side] for side in (left, right)]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)]
            either = [len(x) + len(y) - n for x, y, n in zip(one, two, both, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, both long, either long")


SIMILAR = "100 * both >= 75 * either"


def link(pairs: DataFrame, labels: DataFrame | None, docs: DataFrame) -> DataFrame:
    """labels (node, component; nodes that are alone have no row) with the components that similar pairs (a, b, most) join.

    Pairs inside a component need no check. First the likeliest of each component are checked, then all that are still
    between components."""
    labels = labels if labels is not None else docs.sparkSession.createDataFrame([], "node long, component long")
    left, sets = keep(pairs.groupBy("a", "b").agg(F.max("most").alias("most")), "left"), None
    for last in (False, True):
        of_a, of_b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in ("a", "b"))
        named = left.join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", "most", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        before, left = left, keep(named.where("ca <> cb"), "left")
        release(before)
        if left.isEmpty():
            break
        sets = sets or full_sets(docs, left.select(F.explode(F.array("a", "b")).alias("id")))
        ask = left.select("a", "b")
        if not last:
            ends = left.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("most", "a", "b").alias("p"))
            ask = ends.groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
        checked = keep(overlaps(ask, sets), "checked")
        labels = joined(labels, checked.where(SIMILAR).select("a", "b"))
        if not last:
            before, left = left, keep(left.select("a", "b", "most").join(checked.select("a", "b"), ["a", "b"], "left_anti"), "left")
            release(before)
        release(checked)
    release(left, sets)
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with more links: the old components are stars around their names, so the graph has few steps."""
    new = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(links))
    release(labels)
    return new


def open_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries (a, n, place, token) of lists in which several components meet, with comp, and the list's largest
    component: main, how many entries it has: all, and how many aren't in main: rest."""
    named = entries.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").select("a", "n", "place", "token", F.coalesce("component", "a").alias("comp"))
    counts = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    lists = counts.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all")).where("all > top.k")
    return named.join(lists.select("token", F.col("top.comp").alias("main"), "all", F.expr("all - top.k").alias("rest")), "token")


def leader_pairs(entries: DataFrame, lot: int) -> DataFrame:
    """Pairs of the entries outside a list's largest component with one leader, by lot, of that component."""
    leads = entries.where("comp = main").groupBy("token").agg(F.min_by("a", F.xxhash64(F.lit(lot), "a")).alias("leader"), F.min_by("n", F.xxhash64(F.lit(lot), "a")).alias("m"))
    met = entries.where("comp <> main").join(leads, "token").where("4 * least(n, m) >= 3 * greatest(n, m)")
    return met.select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b")).distinct()


def cell_pairs(entries: DataFrame, cell: int = CELL, many: int = MANY) -> DataFrame:
    """a, b, whole: pairs of entries of different components that pass the bounds, or, with whole, a set a and the component b
    of more than `many` partners that it has in a cell.

    A list's largest component is cut into parts of about `cell`; the other entries meet each part. They meet one another in
    as many parts of their own, of which every two meet in a cell."""
    sized = entries.withColumns({"parts": F.ceil((F.col("all") - F.col("rest")) / cell).cast("int"), "own": F.ceil(F.col("rest") / cell).cast("int")})
    lot = F.xxhash64("a")
    inner = sized.where("comp = main").select("token", F.pmod(lot, F.col("parts")).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("part"), "a", "n", "place", "comp")
    outer = sized.where("comp <> main").withColumn("part", F.pmod(lot, F.col("own")).cast("int"))
    across = outer.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("part"), "a", "n", "place", "comp")
    among = outer.select("token", "part", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("other"), "a", "n", "place", "comp")
    among = among.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "a", "n", "place", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        token, i, j, part, ids, n, place, comp = (table.column(c).to_numpy() for c in ("token", "i", "j", "part", "a", "n", "place", "comp"))
        order = np.lexsort((ids, n, j, i, token))
        token, i, j, part, ids, n, place, comp = (x[order] for x in (token, i, j, part, ids, n, place, comp))
        group = np.cumsum(np.concatenate(([True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        one, two = meetings(group, n, place, comp)
        cross = (i[one] == j[one]) | (part[one] != part[two])  # what is in one part meets elsewhere
        one, two = one[cross], two[cross]
        mixed = part[one] != part[two]
        inward = (j[one] == -1) & mixed  # an outer entry, and one of the largest component
        asker, owner = np.where(part[one] == 1, one, two)[inward], np.where(part[one] == 1, two, one)[inward]
        by = np.lexsort((comp[owner], ids[asker], group[asker]))
        asker, owner = asker[by], owner[by]
        heads = np.flatnonzero(np.concatenate(([True], (asker[1:] != asker[:-1])))) if len(asker) else np.zeros(0, np.int64)
        count = np.repeat(np.diff(np.concatenate((heads, [len(asker)]))), np.diff(np.concatenate((heads, [len(asker)]))))
        few = count <= many
        found = _distinct_pairs(np.concatenate((ids[one[~inward]], ids[asker[few]])), np.concatenate((ids[two[~inward]], ids[owner[few]])))
        asks = np.unique(np.stack((ids[asker[~few]], comp[owner[~few]]), axis=1), axis=0)
        both = np.concatenate((found, asks))
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(found))], ["a", "b", "whole"])

    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = inner.unionByName(across).unionByName(among)
    return dealt.repartition(tasks, "token", "i", "j").mapInArrow(run, "a long, b long, whole boolean").distinct()


def found_inside(asks: DataFrame, labels: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: for each ask (a, a component main that a isn't in) and each block of the component's members, a link if there is
    one. Members' sets come once; an asker's set comes once to each block."""
    wanted = asks.select("main").distinct()
    members = labels.select(F.col("node").alias("a"), F.col("component").alias("main")).unionByName(wanted.select(F.col("main").alias("a"), "main")).distinct()
    members = keep(members.join(wanted, "main", "left_semi"), "members")
    sets = full_sets(docs, members.select(F.col("a").alias("id")).unionByName(asks.select(F.col("a").alias("id"))))
    blocks = members.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    owners = members.join(blocks, "main").select("main", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("part"), F.lit(0).alias("asks"), "a")
    askers = asks.join(blocks, "main").select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("asks"), "a")
    rows = owners.unionByName(askers).join(sets.select(F.col("id").alias("a"), "set"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held, table = None, [], [], None
        for mains, parts, asking, own, raw in columns(batches, "main", "part", "asks", "a", "set"):
            out = []
            for main, part, ask, a, data in zip(mains, parts, asking, own, raw, strict=True):
                if cell != (main, part):
                    cell, ids, held, table = (main, part), [], [], None
                mine = np.frombuffer(data, np.uint64)
                if not ask:
                    ids.append(a)
                    held.append(mine)
                    continue
                if table is None:
                    size = np.array([len(h) for h in held], np.int64)
                    every, whose = np.concatenate([*held, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(held)), size)
                    by = np.argsort(every, kind="stable")
                    table = every[by], whose[by], size
                every, whose, size = table
                low, high = np.searchsorted(every, mine), np.searchsorted(every, mine, side="right")
                n = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(whose[at], minlength=len(size))
                good = np.flatnonzero(100 * both >= 75 * (size + len(mine) - both))
                if len(good):
                    out.append((a, ids[good[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = keep(rows.repartition(tasks, "main", "part").sortWithinPartitions("main", "part", "asks").mapInArrow(run, "a long, b long"), "inside")
    release(members, sets)
    return links


def settle_long_lists(entries: DataFrame, labels: DataFrame, bits: DataFrame, docs: DataFrame, leaders: int = LEADERS, cell: int = CELL, many: int = MANY, block: int = BLOCK) -> DataFrame:
    """labels with all links between entries (a, n, place, token) of one list."""
    still = keep(open_entries(entries, labels), "open")
    for lot in range(leaders):
        labels = link(possible(leader_pairs(still, lot), bits, 3, 4), labels, docs)
        before, still = still, keep(open_entries(still.select("a", "n", "place", "token"), labels), "open")
        release(before)
    met = keep(cell_pairs(still, cell, many), "met")
    labels = link(possible(met.where("not whole").select("a", "b"), bits, 3, 4), labels, docs)
    of_a, of_b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in ("a", "b"))
    asks = met.where("whole").join(of_a, "a", "left").join(of_b, "b", "left").select("a", F.coalesce("ca", "a").alias("mine"), F.coalesce("cb", "b").alias("main")).where("mine <> main")
    asks = keep(asks.select("a", "main").distinct(), "asks")
    if not asks.isEmpty():
        labels = joined(labels, found_inside(asks, labels, docs, block))
    release(still, met, asks)
    return labels


def similarity_classes(docs: DataFrame, short: int = SHORT, **settings: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: sets of 5-word shingles, linked where 100 * intersection >=
    75 * union, components of links.

    A text under five words is one shingle; a null text or one without words has an empty set and is linked with nothing.
    Rows of one doc_id belong together; a null doc_id is a component of its own, null. Equal sets meet by their 128-bit
    hash; other columns are not read; an empty table gives an empty one. settings are those of settle_long_lists; none
    changes the result.
    """
    spark = docs.sparkSession
    frequent, seen = frequent_shingles(docs)
    hot = _from_five(_five(frequent[seen >= HOT]))
    signed = keep(digests(docs, frequent), "digests")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = keep(classes, "classes")
    bits = classes.select("rep", "n", "bits")
    total = classes.agg(F.sum(F.length("prefix") / 5)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (1 << 19)))
    listed = keep(list_pairs(postings(classes.select("rep", "n", "prefix"), buckets, hot), buckets, short, hot), "lists")
    plain = keep(possible(listed.where("b is not null").select("a", "b").distinct(), bits, 3, 4), "pairs")
    entries = listed.where("b is null").select("a", "n", "place", "token")
    labels = settle_long_lists(entries, link(plain, None, docs), bits, docs, **settings)
    release(listed, plain)
    of_class = classes.select("h1", "h2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_component"))
    known = signed.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    found = known.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("class_component", "doc_id")).alias("component_id"))
    found = keep(found, "classes-of-documents")  # narrow, so that the digests can go
    release(signed, classes)
    return found


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
