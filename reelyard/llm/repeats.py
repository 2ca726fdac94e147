"""Removal of long repeated byte strings by run-length compressed Burrows-Wheeler indexes.

Every window of `length` bytes of a text has an anchor: its least hashed 48-byte string, the leftmost of equals. Equal
windows have equal anchors at equal offsets, so only windows of one anchor need to meet. The windows of one anchor
occurrence form a segment of the text. Segments that are equal to the byte are one run: a run of two or more is repeated
wholly, and goes into the index once, however many they are. An anchor with different segments of which some occur once is
indexed, in buckets of anchors: the suffix array gives the BWT, of which the runs are kept with the suffixes at their ends;
common prefixes are compared at run heads only, and the matching statistics of all other positions follow by streaming the
text (each is one less than its left neighbour's). Windows that match `length` bytes elsewhere are marked.

An anchor with more than MOST different segments is split, with no loss, by longer anchors: the windows that start within
REACH places of one another hold a string of length - REACH + 1 bytes in common, which is their anchor then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.members import Members
from reelyard.llm.words import _Powers, columns, mix, to_bytes
from reelyard.storage import keep, release

LENGTH = 200
GRAM = 48
MOST = 1000
REACH = 8
LONGEST = 30_000
FLUSH = 1 << 19
BUCKET_BYTES = 4 << 20
TEXT_BYTES = 32 << 20
STRETCH = 8 << 20
_RAW = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# an occurrence of a segment: the row's key, first window, number of windows (and whether it is known to be repeated), anchor, segment
_RECORD = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("low", "<u4"), ("n", "<u2"), ("anchor", "<u4"), ("anchor_", "u1"), ("seg", "<i8")])
_TWICE = 1 << 15


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each maximal run of windows with one anchor occurrence."""
    found = [_stretch(data[at : at + STRETCH + length - 1], at, length) for at in range(0, max(len(data) - length + 1, 0), STRETCH)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _gram_keys(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor-sized string, and the keys (40 bits of the hash, then the place) whose least one is the anchor."""
    raw = np.frombuffer(data, np.uint8)
    gram = min(GRAM, length)
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RAW[raw] * up[: len(raw)], out=total[1:])
    n = len(raw) - gram + 1
    hashed = mix((total[gram:] - total[:n]) * down[:n])
    return hashed, (hashed & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)


def _stretch(data: bytes, offset: int, length: int):
    hashed, key = _gram_keys(data, length)
    width, span = length - min(GRAM, length) + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    at = (key & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first + offset, np.diff(np.concatenate((first, [len(at)]))), hashed[at[first]]


def block_ranks(symbols: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(rank of the block of symbols from each position, 0 past the end; block size): as many symbols as fit in 63 bits, then
    doubled twice, `length` at most."""
    n = len(symbols)
    used = np.zeros(int(symbols.max()) + 1, bool)
    used[symbols] = True
    dense = np.cumsum(used)[symbols]  # from 1, in the same order; 0 is past the end
    bits = int(dense.max()).bit_length()
    span = min(63 // bits, length)
    padded = np.concatenate((dense.astype(np.int64), np.zeros(span, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = key << bits | padded[k : k + n]
    for doubling in range(3):
        order = np.argsort(key)
        ranked = key[order]
        rank = np.zeros(n + length, np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1])))
        if doubling == 2 or 2 * span > length:
            return rank, span
        key = rank[:n] * (n + 1) + rank[span : span + n]
        span *= 2


def suffix_order(symbols: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at the starts in the order of their first `length` symbols."""
    rank, span = block_ranks(symbols, length)
    offsets = [*range(0, length - span, span), length - span]
    ranks = [rank[starts + at] for at in offsets]
    if len(ranks) % 2:
        ranks.append(np.zeros(len(starts), np.int64))
    keys = [x * (len(symbols) + 1) + y for x, y in zip(ranks[::2], ranks[1::2], strict=True)]
    return np.lexsort(keys[::-1])


class RunIndex:
    """The run-compressed BWT of the suffixes at some starts of a text: where runs begin, the suffixes at both sides of each
    beginning, and the common prefix of these two. That determines the matching statistics of all starts.

    Suffixes are ordered by `length` symbols, so a run also ends where the left neighbours of two suffixes aren't neighbours
    in that order (in a full suffix array equal BWT symbols imply that they are)."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, length: int):
        self.size = len(starts)
        self.order = order = suffix_order(symbols, starts, length)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        joined = np.concatenate(([False], np.diff(starts) == 1))  # has its left neighbour among the starts
        this, that = order[1:], order[:-1]
        inside = joined[this] & joined[that]
        inside &= symbols[starts[this] - 1] == symbols[starts[that] - 1]  # the BWT
        inside &= place[this - 1] == place[that - 1] + 1
        heads = np.concatenate(([0], np.flatnonzero(~inside) + 1))
        self.run_start, before = order[heads], order[np.maximum(heads - 1, 0)]
        self.common = self._common(symbols, starts[self.run_start], np.where(heads > 0, starts[before], -1))

    def _common(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, out = len(symbols), np.zeros(len(a), np.int64)
        live, width = np.flatnonzero(b >= 0), 16
        while len(live):
            padded, reach, again = np.concatenate((symbols, np.full(width, 511, symbols.dtype))), np.arange(width), []
            for low in range(0, len(live), 8192):
                part = live[low : low + 8192]
                x, y = a[part] + out[part], b[part] + out[part]
                same = padded[np.minimum(x, n)[:, None] + reach] == padded[np.minimum(y, n)[:, None] + reach]
                run = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), n - np.maximum(x, y))
                out[part] += run
                again.append(part[run == width])
            live, width = np.concatenate(again), 64
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each start, how long a string from there also begins at another one."""
        by_start = np.argsort(self.run_start)
        heads, values = self.run_start[by_start], self.common[by_start]
        last = np.searchsorted(heads, np.arange(self.size), side="right") - 1
        back = values[last] - (np.arange(self.size) - heads[last])  # in common with the suffix just before it in order
        in_order = back[self.order]
        out = np.empty(self.size, np.int64)
        out[self.order] = np.maximum(in_order, np.concatenate((in_order[1:], [0])))
        return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal [from, to) runs covered by windows of this length at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    low = starts[np.concatenate(([0], cut + 1))]
    high = starts[np.concatenate((cut, [len(starts) - 1]))] + length
    return list(zip(low.tolist(), high.tolist(), strict=True))


def bucket_marks(texts: list[bytes], times: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each segment of a bucket, the spans of its windows that occur in another segment or whose segment is repeated."""
    symbols = np.concatenate([np.concatenate((np.frombuffer(t, np.uint8).astype(np.int16), [256])) for t in texts]).astype(np.int16)
    windows = np.array([len(t) - length + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    at = np.concatenate(([0], np.cumsum(windows)))
    starts = np.repeat(first - at[:-1], windows) + np.arange(at[-1])
    matched = RunIndex(symbols, starts, length).matching_statistics() >= length
    return [covered(np.arange(k) if n > 1 else np.flatnonzero(matched[low : low + k]), length) for k, n, low in zip(windows.tolist(), times, at[:-1].tolist(), strict=True)]


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of [low, high) spans."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
    return low[first], reach[np.concatenate((first[1:], [len(low)])) - 1]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the key of the row: k1, k2. Rows of one doc_id and different texts have different keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64(F.col("doc_id").isNull(), text).alias("k2"))


_SPAN_ROW = "k1 long, k2 long, low int, high int"
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64()), ("twice", pa.bool_()), ("kinds", pa.int64())])
_FOUND_ROW = _SPAN_ROW + ", n int, anchor long, seg long, twice boolean, kinds long"


def _span_batch(k1, k2, low, high) -> pa.RecordBatch:
    """Rows of spans, without a segment; neighbouring and repeated spans of a row are one."""
    order = np.lexsort((low, k2, k1))
    k1, k2, low, high = (np.asarray(x, np.int64)[order] for x in (k1, k2, low, high))
    new = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))) if len(k1) else np.zeros(0, np.int64)
    base = np.zeros(len(k1), np.int64)  # shift each row's spans apart, so that one pass merges them all
    if len(k1):
        base = np.repeat(np.arange(len(new)) * (int(high.max()) + 2), np.diff(np.concatenate((new, [len(k1)]))))
        lows, highs = merged(low + base, high + base)
        at = np.searchsorted(low + base, lows)
        k1, k2, base = k1[at], k2[at], base[at]
        low, high = lows - base, highs - base
    none = {f.name: pa.nulls(len(k1), f.type) for f in _FOUND}
    return pa.RecordBatch.from_pydict(none | {"k1": pa.array(k1), "k2": pa.array(k2), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))}, schema=_FOUND)


def _repeated(anchor: np.ndarray, seg: np.ndarray, twice: np.ndarray):
    """Order of the occurrences by anchor and segment, starts of equal segments in it, which of them are repeated, and for each
    how many different ones its anchor has and how many of these occur once."""
    order = np.lexsort((~twice, seg, anchor))
    a, s = anchor[order], seg[order]
    head_a = np.concatenate(([True], a[1:] != a[:-1]))
    heads = np.flatnonzero(head_a | np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.concatenate((heads, [len(a)])))
    again = (count > 1) | twice[order[heads]]
    of_anchor = np.cumsum(head_a[heads]) - 1
    return order, heads, count, again, np.bincount(of_anchor)[of_anchor], np.bincount(of_anchor, ~again)[of_anchor]


def occurrences(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, rec (packed occurrences of the bucket's anchors), spans (packed k1, k2, low, high of segments met twice here).

    What a task sees twice it knows to be repeated: of these it sends one on, so an anchor that very many rows share is met
    by one occurrence of each different segment from each part of a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[np.ndarray] = []
        whole: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            rec, anchor = np.concatenate(part), np.concatenate(whole)
            order, heads, count, _, _, _ = _repeated(anchor, rec["seg"], np.zeros(len(rec), bool))
            sent, met = order[heads], order[np.repeat(count > 1, count)]
            spans = np.stack((rec["k1"][met], rec["k2"][met], rec["low"][met].astype(np.int64), rec["low"][met].astype(np.int64) + rec["n"][met] + length - 1))
            rec["n"][sent] |= np.where(count > 1, _TWICE, 0).astype(np.uint16)
            bucket = (anchor[sent] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            packed = [rec[sent[by[edges[b] : edges[b + 1]]]].tobytes() for b in full]
            # the spans go with any bucket: they only pass through
            aside = _span_batch(*spans)
            passed = np.stack([aside.column(k).to_numpy().astype(np.int64) for k in range(4)]).tobytes() if aside.num_rows else None
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary()), pa.array([passed if i == 0 else None for i in range(len(full))], pa.binary())], ["bucket", "rec", "spans"])

        for k1s, k2s, texts in columns(batches, "k1", "k2", "text"):
            for k1, k2, text in zip(k1s, k2s, texts, strict=True):
                data = to_bytes(text)
                low, n, anchor = segments(data, length)
                if not len(low):
                    continue
                view, rec = memoryview(data), np.zeros(len(low), _RECORD)
                rec["k1"], rec["k2"], rec["low"], rec["n"] = k1, k2, low, n
                rec["anchor"], rec["anchor_"] = (anchor >> np.uint64(32)).astype(np.uint32), (anchor >> np.uint64(24)).astype(np.uint8)
                rec["seg"] = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(low.tolist(), (low + n + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                part.append(rec)
                whole.append(anchor)
                waiting += len(rec)
                if waiting >= FLUSH:
                    yield flush()
                    part, whole, waiting = [], [], 0
        if part:
            yield flush()

    return docs.select("k1", "k2", "text").mapInArrow(cut, "bucket int, rec binary, spans binary")


def meet(cuts: DataFrame, length: int, buckets: int) -> DataFrame:
    """k1, k2, low, high of spans that are repeated wholly (anchor null), and the segments to index: of each anchor that has
    different ones of which some occur once, one occurrence of each, with twice (the segment is repeated) and kinds (how many
    different ones the anchor has)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for rec, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts.append(rec)
                if spans:
                    yield _span_batch(*np.frombuffer(spans, np.int64).reshape(4, -1))
        if not parts:
            return
        rec = np.frombuffer(b"".join(parts), _RECORD)
        del parts
        anchor = rec["anchor"].astype(np.int64) << 8 | rec["anchor_"]
        known = rec["n"] >= _TWICE
        n, low = (rec["n"] & (_TWICE - 1)).astype(np.int64), rec["low"].astype(np.int64)
        order, heads, count, again, kinds, single = _repeated(anchor, rec["seg"], known)
        met = order[np.repeat(again, count)]
        met = met[~known[met]]  # the others' spans are out already
        yield _span_batch(rec["k1"][met], rec["k2"][met], low[met], low[met] + n[met] + length - 1)
        ask = np.flatnonzero((kinds > 1) & (single > 0))
        at = order[heads[ask]]
        yield pa.RecordBatch.from_arrays([pa.array(rec["k1"][at]), pa.array(rec["k2"][at]), pa.array(low[at].astype(np.int32)), pa.array((low[at] + n[at] + length - 1).astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(anchor[at]), pa.array(rec["seg"][at]), pa.array(again[ask]), pa.array(kinds[ask])], schema=_FOUND)

    return cuts.repartitionById(buckets, "bucket").mapInArrow(match, _FOUND_ROW)


def parts_of(data: bytes, low: int, n: int, length: int, reach: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(longer anchor, first window, windows, bytes) of the parts of a segment whose windows start in one stretch of `reach`
    places before the anchor."""
    piece = data[low : low + n + length - 1]
    _, key = _gram_keys(piece[:length], length)
    anchor, reach = int(key.argmin()), min(reach, length)
    for stretch in range((anchor - n + 1) // reach, anchor // reach + 1):
        far, close = (stretch + 1) * reach - 1, stretch * reach  # how far before the anchor the windows start
        first, last = max(anchor - far, 0), min(anchor - close, n - 1)
        common = piece[anchor - close : anchor - far + length]  # in all windows of the stretch, wherever the segment ends
        yield xxhash.xxh3_64_intdigest(common, seed=stretch) >> 1, low + first, last - first + 1, piece[first : last + length]


def variants(docs: DataFrame, found: DataFrame, length: int, most: int, reach: int = REACH) -> DataFrame:
    """The segments to index with their bytes, those of anchors with over `most` kinds in parts of longer anchors."""
    wanted = found.where("anchor is not null").groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "n", "anchor", "seg", "twice", "kinds")).alias("cuts"))
    wanted = keep(wanted, "wanted")
    holders = Members.of(wanted, "k2").filter(docs, "k2")
    # one row of a repeated (doc_id, text) is enough
    sources = holders.select("k1", "k2", "text").join(wanted, ["k1", "k2"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for k1s, k2s, texts, cuts in columns(batches, "k1", "k2", "text", "cuts"):
            pieces, spans = [], []
            for k1, k2, text, here in zip(k1s, k2s, texts, cuts, strict=True):
                if last == (k1, k2):  # rows of one key come together
                    continue
                data, last = to_bytes(text), (k1, k2)
                for c in here:
                    low, n, twice = c["low"], c["n"], c["twice"]
                    if c["kinds"] <= most:
                        pieces.append([k1, k2, low, n, c["anchor"], c["seg"], twice, data[low : low + n + length - 1], None])
                    else:
                        for anchor, first, some, piece in parts_of(data, low, n, length, reach):
                            pieces.append([k1, k2, first, some, -1 - anchor, xxhash.xxh3_64_intdigest(piece) - 2**63, twice, piece, None])
            # of equal parts that meet here one goes on, known to be repeated; the spans of all of them are known then
            kept: dict[tuple, list] = {}
            for p in pieces:
                one = kept.setdefault((p[4], p[5]), p)
                if one is not p:
                    spans += [[q[0], q[1], q[2], None, None, None, None, None, q[2] + q[3] + length - 1] for q in (one, p) if not q[6]]
                    one[6] = True
            rows = [*kept.values(), *spans]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["k1", "k2", "low", "n", "anchor", "seg", "twice", "bytes", "high"])

    made = keep(sources.mapInArrow(slices, "k1 long, k2 long, low int, n int, anchor long, seg long, twice boolean, bytes binary, high int"), "variants")
    release(wanted)
    return made


def indexed(pieces: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """k1, k2, low, high of the windows that are repeated within the variants' buckets, by the run-length index."""
    total = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))

    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["anchor", "seg", "k1", "k2", "low"])
        kinds = part.groupby(["anchor", "seg"], sort=False)
        times = kinds["twice"].transform("max").to_numpy(bool) | (kinds["low"].transform("size").to_numpy() > 1)
        first = ~part.duplicated(["anchor", "seg"]).to_numpy()
        rows = []
        for k1, k2, low, n, done, more in zip(part["k1"], part["k2"], part["low"], part["n"], part["twice"], times, strict=True):
            if more and not done:
                rows.append((k1, k2, low, low + n + length - 1))
        chosen, often = part[first], times[first]
        marks = bucket_marks(chosen["bytes"].to_list(), np.where(often, 2, 1).tolist(), length)
        for k1, k2, low, more, spans in zip(chosen["k1"], chosen["k2"], chosen["low"], often, marks, strict=True):
            if not more:
                rows += [(k1, k2, low + a, low + b) for a, b in spans]
        return pd.DataFrame(rows, columns=["k1", "k2", "low", "high"])

    dealt = pieces.where("bytes is not null").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(index, _SPAN_ROW)


def repeat_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """k1, k2, spans: for each text (of keyed() rows) with repeats, byte spans (they may overlap) that hold every byte covered
    by a `length`-byte string which starts anywhere else too, in the same text or another."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TEXT_BYTES))
    found = keep(meet(occurrences(docs, length, buckets), length, buckets), "met")
    pieces = variants(docs, found, length, most)
    spans = found.where("anchor is null").select("k1", "k2", "low", "high")
    spans = spans.unionByName(pieces.where("bytes is null").select("k1", "k2", "low", "high")).unionByName(indexed(pieces, length, bucket_bytes))
    out = keep(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    release(found, pieces)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of docs.

    A null text is empty; texts under `length` bytes keep all; a repeated row is a text of its own, so both lose what they
    share; equal rows and ties give equal results; an empty table gives an empty one; other columns are not read. length is
    at most LONGEST.
    """
    if not 1 <= length <= LONGEST:
        raise ValueError(f"length must be from 1 to {LONGEST}")
    texts = keyed(docs)
    spans = repeat_spans(texts, length, most)
    # texts without spans are done here; only the others' bytes meet their spans
    hit = Members.of(spans, "k2").test("k2")
    light = texts.withColumn("hit", hit).select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("hit"), F.col("text")).alias("text"), F.when(~F.col("hit"), F.sha2("text", 256)).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, bodies, kepts, cuts in columns(batches, "doc_id", "n_bytes", "text", "kept", "spans"):
            out = []
            for size, text, whole, here in zip(sizes, bodies, kepts, cuts, strict=True):
                low = high = np.zeros(0, np.int64)
                if text is not None:
                    if here:
                        low, high = merged(np.array([s["low"] for s in here], np.int64), np.array([s["high"] for s in here], np.int64))
                    data, rest, at = to_bytes(text), hashlib.sha256(), 0
                    for a, b in zip(low.tolist(), high.tolist(), strict=True):
                        rest.update(data[at:a])
                        at = b
                    rest.update(data[at:])
                    whole = rest.hexdigest()
                out.append((size, int((high - low).sum()), len(low), whole, [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = light.join(spans, ["k1", "k2"], "left").select("doc_id", "n_bytes", "text", "kept", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:long,high:long>>")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
