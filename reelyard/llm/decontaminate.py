"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle check.

For each benchmark item of n words, a document's windows of n words that hold a word run of some item are fingerprinted.
A fingerprint is a row of 64-bit SimHashes, one for each class of the window's 5-word shingles (a shingle's hash gives its
class), a shingle weighing its count. The items' SimHashes are indexed by RADIUS + 1 bit blocks: two that are within RADIUS
bits agree in one block at least, so the lookup finds every one within the radius. Each find is checked by the exact weighted
Jaccard similarity of the two shingle multisets.

Why nothing is lost: windows of a similarity of `least` differ from the item in `differing` shingles at most, each of which
touches one class. An item of n shingles with shingles in more classes than that has an untouched one, whose SimHashes are
equal, at distance 0. Items that fill fewer classes (of few different shingles) are candidates of every window that holds
one of their length's shingles. A window without any word run of an item has similarity 0 with every item.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.words import columns, mix, shingle_hashes, to_bytes, word_hashes

WIDTH = 5
LEAST = 0.75
RADIUS = 3
BLOCK_ITEMS = 5_000
BITS = 64
LOT = 2048  # windows at a time


def differing(size: int, least: float) -> int:
    """How many shingles a window can have that the item hasn't, or the other way round, at a similarity of least; the larger
    of the two has `size` shingles."""
    return int(np.floor(2 * size * (1 - least) / (1 + least) + 1e-9))


def classes(size: int, least: float) -> int:
    """The number of classes for items of `size` shingles: enough that all but few items fill more than `differing`."""
    return differing(size, least) * 3 // 2 + 1


def class_simhashes(shingles: np.ndarray, starts: np.ndarray, size: int, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, prints, owner): the different fingerprints of the classes of shingles[s : s + size] for all starts, the class
    of each, and for each start and class the place of its fingerprint, -1 where the window has no shingle of the class.

    Running bit counts over the shingles in order of classes; a window's part of a class is a stretch of these."""
    low, high = int(starts.min()), int(starts.max()) + size
    part = mix(shingles[low:high])
    of = (part % np.uint64(n_classes)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    total = np.zeros((len(part) + 1, BITS), np.int32)
    np.cumsum(np.unpackbits(mix(part[order]).view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=total[1:])
    before = np.zeros((len(part) + 1, n_classes), np.int64)
    np.cumsum(of[:, None] == np.arange(n_classes), axis=0, out=before[1:])
    first = np.concatenate(([0], np.cumsum(before[-1])[:-1]))
    begin, end = first + before[starts - low], first + before[starts - low + size]
    stretch, place = np.unique(np.where(end > begin, begin * (len(part) + 1) + end, -1), return_inverse=True)
    place = place.reshape(begin.shape)
    if stretch[0] == -1:
        stretch, place = stretch[1:], place - 1
    begin, end = stretch // (len(part) + 1), stretch % (len(part) + 1)
    votes = 2 * (total[end] - total[begin]) > (end - begin)[:, None]
    return of[order][begin], np.packbits(votes, axis=1).view(">u8").reshape(-1).astype(np.uint64), place


@functools.cache
def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks that cover the fingerprint."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def block_key(which: np.ndarray, prints: np.ndarray, shift: int, mask: int) -> np.ndarray:
    """A fingerprint's class and block as one number, exact while classes and block are below 2**31 each."""
    return which << 32 | (prints >> np.uint64(shift) & np.uint64(mask)).astype(np.int64)


def weighted_jaccard(a: dict, b: dict) -> float:
    """Sum of least counts over sum of greatest counts."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def counted(shingles: np.ndarray) -> dict[int, int]:
    found, n = np.unique(shingles, return_counts=True)
    return dict(zip(found.tolist(), n.tolist(), strict=True))


@dataclass
class Prints:
    """The class fingerprints of the items of one length: for each bit block its (class, value) in order, and whose they are."""

    n_classes: int
    prints: np.ndarray
    items: np.ndarray
    keys: list[np.ndarray]
    rows: list[np.ndarray]
    few: np.ndarray  # items that fill too few classes


@dataclass
class Items:
    """An index of benchmark items; its size is in proportion to the items' words."""

    radius: int = RADIUS
    least: float = LEAST
    ids: list[int] = field(default_factory=list)
    bags: list[dict] = field(default_factory=list)
    index: dict[int, Prints] = field(default_factory=dict)
    known: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[int, str]], radius: int = RADIUS, least: float = LEAST) -> Items:
        out = cls(radius, least)
        runs, lengths = defaultdict(list), defaultdict(list)
        for item, text in sorted(rows):
            words = word_hashes(to_bytes(text))
            if not len(words):
                continue
            shingles = shingle_hashes(words, WIDTH)
            runs[min(WIDTH, len(words))].append(shingles)
            lengths[len(words)].append((len(out.ids), shingles))
            out.ids.append(item)
            out.bags.append(counted(shingles))
        for length, found in lengths.items():
            out.index[length] = out._prints(found)
        out.known = {width: np.unique(np.concatenate(r)) for width, r in runs.items()}
        # for each length, which of the known shingles its items have
        out.member = {n: np.isin(out.known[min(WIDTH, n)], np.concatenate([s for _, s in found])) for n, found in lengths.items()}
        out.likely = np.zeros(1 << 20, bool)
        for known in out.known.values():
            out.likely[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def _prints(self, found: list[tuple[int, np.ndarray]]) -> Prints:
        size = len(found[0][1])
        n = classes(size, self.least)
        which, prints, items, few = [], [], [], []
        for at, shingles in found:
            of, mine, _ = class_simhashes(shingles, np.zeros(1, np.int64), size, n)
            if len(mine) <= differing(size, self.least):
                few.append(at)
            else:
                which.append(of)
                prints.append(mine)
                items.append(np.full(len(mine), at))
        which, prints, items = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((which, np.int64), (prints, np.uint64), (items, np.int64)))
        keys, rows = [], []
        for shift, mask in blocks_of(self.radius):
            key = block_key(which, prints, shift, mask)
            rows.append(np.argsort(key, kind="stable"))
            keys.append(key[rows[-1]])
        return Prints(n, prints, items, keys, rows, np.array(few, np.int64))

    def has(self, shingles: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle is one of some item, and which."""
        maybe = np.flatnonzero(self.likely[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        same = known[at] == shingles[maybe]
        return maybe[same], at[same]

    def near(self, length: int, which: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) of this length with a fingerprint of the same class within the radius, each once."""
        index = self.index[length]
        asked, met = [], []
        for (shift, mask), keys, rows in zip(blocks_of(self.radius), index.keys, index.rows, strict=True):
            key = block_key(which, prints, shift, mask)
            begin = np.searchsorted(keys, key)
            many = np.searchsorted(keys, key, "right") - begin
            one = np.repeat(np.arange(len(key)), many)
            row = rows[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(one))]
            close = np.bitwise_count(prints[one] ^ index.prints[row]) <= self.radius
            asked.append(one[close])
            met.append(index.items[row[close]])
        both = np.unique(np.stack((np.concatenate(asked), np.concatenate(met)), axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def candidates(self, length: int, shingles: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, items): the windows that the index lets pass, in lots."""
        index = self.index[length]
        edges = np.flatnonzero(np.diff(starts) > size) + 1  # windows far apart share no shingles
        for run in np.split(starts, edges):
            for low in range(0, len(run), LOT):
                lot = run[low : low + LOT]
                which, prints, place = class_simhashes(shingles, lot, size, index.n_classes)
                asked, item = self.near(length, which, prints)
                window, of = np.nonzero(place >= 0)
                print_ = place[window, of]
                # each window's fingerprints against the finds, which are in the fingerprints' order
                begin = np.searchsorted(asked, print_)
                many = np.searchsorted(asked, print_, "right") - begin
                row = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                pairs = np.stack((np.repeat(lot[window], many), item[row]), axis=1)
                if len(index.few):
                    pairs = np.concatenate((pairs, np.stack((np.repeat(lot, len(index.few)), np.tile(index.few, len(lot))), axis=1)))
                pairs = np.unique(pairs, axis=0)
                yield pairs[:, 0], pairs[:, 1]

    def matches(self, text: str | None, tally: dict[str, int] | None = None) -> dict[int, tuple[float, int]]:
        """Item id to its best (similarity, first word of the window) in the text; the index's work is added to the tally."""
        found: dict[int, tuple[float, int]] = {}
        words = word_hashes(to_bytes(text)) if self.ids else ()
        if not len(words):
            return found
        for width, known in self.known.items():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            hits, which = self.has(shingles, known)
            if len(hits):
                for length, member in self.member.items():
                    if min(WIDTH, length) == width:
                        self._windows(shingles, hits[member[which]], length, length - width + 1, found, tally)
        return found

    def _windows(self, shingles, hits, length: int, size: int, found: dict, tally: dict | None) -> None:
        """Windows of `size` shingles, or the whole of a shorter text."""
        items = len(np.unique(self.index[length].items)) + len(self.index[length].few)
        whole = len(shingles) < size
        size = min(size, len(shingles))
        most = len(shingles) - size
        shared = np.zeros(most + 2, np.int64)
        np.add.at(shared, np.maximum(hits - size + 1, 0), 1)
        np.add.at(shared, np.minimum(hits, most) + 1, -1)
        shared = np.cumsum(shared[: most + 1])
        starts = np.flatnonzero(shared)
        # what a similar window shares with the item, a first look of the exact check
        need = 1 if whole else max(1, int(np.ceil(2 * size * self.least / (1 + self.least) - 1e-9)))
        bags: dict[int, dict] = {}
        passed = 0
        for windows, places in self.candidates(length, shingles, starts, size):
            passed += len(windows)
            enough = shared[windows] >= need
            for start, at in zip(windows[enough].tolist(), places[enough].tolist(), strict=True):
                item = self.ids[at]
                if start not in bags:
                    bags[start] = counted(shingles[start : start + size])
                sim = weighted_jaccard(bags[start], self.bags[at])
                if sim >= self.least and (item not in found or (-sim, start) < (-found[item][0], found[item][1])):
                    found[item] = (sim, start)
        if tally is not None:
            for name, n in (("windows", len(starts)), ("pairs", len(starts) * items), ("candidates", passed)):
                tally[name] = tally.get(name, 0) + n


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS):
    """The benchmark's items in blocks of at most `size`, so that what is broadcast at once is bounded."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-rows.count() // size))
    for k in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, at_word for every document and item of which a window is similar enough.

    A larger benchmark than block_items is met block by block. Null or empty texts and items match nothing; items under
    five words are one shingle and match where it occurs; repeated rows give repeated matches; items repeated under one id
    are one item per text; empty tables give an empty result. Only doc_id, item_id and text are read.
    """
    out = None
    for rows in item_blocks(benchmark, block_items):
        items = docs.sparkSession.sparkContext.broadcast(Items.build([(r["item_id"], r["text"]) for r in rows], radius, least))

        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for ids, texts in columns(batches, "doc_id", "text"):
                hit = [(d, i, s, at) for d, t in zip(ids, texts, strict=True) for i, (s, at) in sorted(items.value.matches(t).items())]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hit], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "at_word"])

        part = docs.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, similarity double, at_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; rows with a null text stay."""
    for rows in item_blocks(benchmark, block_items):
        items = docs.sparkSession.sparkContext.broadcast(Items.build([(r["item_id"], r["text"]) for r in rows], radius, least))

        @F.pandas_udf("boolean")
        def leaked(text, items=items):
            return text.map(lambda t: bool(items.value.matches(t)))

        docs = docs.where(~leaked(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def index_report(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row on the index's work over all documents: windows fingerprinted (those with a word run of an item), pairs of these
    with the items of their length, candidates (the pairs that it let pass), candidates_per_window."""
    parts = None
    for rows in item_blocks(benchmark, block_items):
        items = docs.sparkSession.sparkContext.broadcast(Items.build([(r["item_id"], r["text"]) for r in rows], radius, least))

        def work(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            tally = {"windows": 0, "pairs": 0, "candidates": 0}
            for (texts,) in columns(batches, "text"):
                for text in texts:
                    items.value.matches(text, tally)
            yield pa.RecordBatch.from_pydict({name: pa.array([n], pa.int64()) for name, n in tally.items()})

        part = docs.select("text").mapInArrow(work, "windows long, pairs long, candidates long")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("windows", "pairs", "candidates")))
    return sums.withColumn("candidates_per_window", F.try_divide("candidates", "windows"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
