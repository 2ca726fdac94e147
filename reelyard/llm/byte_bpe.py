"""Byte-level BPE encoding and decoding by replaying the merges over many words at once.

The pieces that a pattern cuts from a stretch of texts are gathered, and those not met lately form a small corpus. An inverted
index from each rank of a mergeable pair to the places where the pair stands takes the merges in order of rank: every place
of a rank is merged, and only the pairs to the left and right of it are looked up anew. Pieces are encoded once however often
they occur. Texts are walked in stretches of pieces, so memory doesn't grow with their length.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reelyard.llm.words import columns

STRETCH = 1 << 17  # pieces that are encoded together
MEMORY = 400_000  # pieces of a generation; a worker remembers two
PAIRS = 4_000_000  # pairs of tokens whose rank a worker remembers
LONG = 200  # longer pieces aren't remembered
WHOLE_TEXT = 1 << 21


class MergeReplay:
    """Ids of pieces by a table of ranks (token bytes to rank, the rank being the id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.double = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int64)
        self.joint: dict[int, int] = {}
        self.words = [str(r) for r in range(max(self.tokens) + 1)]
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def rank_of(self, left: int, right: int) -> int:
        """The rank of two neighbouring tokens' bytes, -1 where they don't merge."""
        if len(self.joint) >= PAIRS:
            self.joint.clear()
        found = self.joint[left << 32 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (none of them empty).

        As new pairs may rank before the pair that made them, a rank's later places wait until those are merged: each word
        then sees its own merges in the order of lowest rank and leftmost place.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        pairs = np.full(len(raw), -1, np.int64)
        pairs[:-1] = self.double[raw[:-1], raw[1:]]
        pairs[starts[1:] - 1] = -1
        places = np.flatnonzero(pairs >= 0)
        places = places[np.argsort(pairs[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(pairs[places], prepend=-1))
        index = {int(pairs[group[0]]): group.tolist() for group in np.split(places, cuts[1:]) if len(group)}
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        after[starts[1:] - 1], before[starts[:-1]] = -1, -1
        token, pair, after, before = (x.tolist() for x in (self.single[raw], pairs, after, before))
        heap = list(index)
        heapq.heapify(heap)

        joint, rank_of, push, pop, places_of = self.joint.get, self.rank_of, heapq.heappush, heapq.heappop, index.get
        while heap:
            rank = pop(heap)
            group = index.pop(rank)
            group.sort()
            for n, at in enumerate(group, 1):
                if pair[at] != rank:  # a neighbour was merged
                    continue
                gone, previous, waits = after[at], before[at], False
                following = after[gone]
                token[at], pair[gone], pair[at], after[at] = rank, -1, -1, following
                if following >= 0:
                    before[following] = at
                    new = joint(rank << 32 | token[following])
                    if new is None:
                        new = rank_of(rank, token[following])
                    if new >= 0:
                        pair[at] = new
                        places = places_of(new)
                        if places is None:
                            index[new] = [at]
                            push(heap, new)
                        else:
                            places.append(at)
                        waits = new < rank
                if previous >= 0:
                    new = joint(token[previous] << 32 | rank)
                    if new is None:
                        new = rank_of(token[previous], rank)
                    pair[previous] = new
                    if new >= 0:
                        places = places_of(new)
                        if places is None:
                            index[new] = [previous]
                            push(heap, new)
                        else:
                            places.append(previous)
                        waits = waits or new < rank
                if waits and n < len(group):
                    index[rank] = group[n:]
                    push(heap, rank)
                    break
        out = []
        for at in starts[:-1].tolist():
            ids = []
            while at >= 0:
                ids.append(token[at])
                at = after[at]
            out.append(ids)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known: a whole piece that is a token is that token, all others by the merges. Pieces
        that come again within two generations are still known."""
        if len(self.ids) >= MEMORY:
            self.older, self.ids = self.ids, {}
        ids, older = self.ids, self.older
        new = []
        for p in pieces.difference(ids):
            found = older.get(p)
            if found is None:
                new.append(p)
            else:
                ids[p] = found
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        found = [self.ranks.get(w) for w in raw]
        collecting = gc.isenabled()
        gc.disable()  # the many short lists of a replay hold no cycles
        try:
            merged = iter(self.replay([w for w, r in zip(raw, found, strict=True) if r is None]) if None in found else ())
        finally:
            if collecting:
                gc.enable()
        for piece, rank in zip(new, found, strict=True):
            ids[piece] = array("I", next(merged) if rank is None else [rank]).tobytes()
            if len(piece) > LONG:
                self.long.append(piece)

    def forget_long(self) -> None:
        for piece in self.long:
            self.ids.pop(piece, None)
        self.long.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Digest:
    """What is kept of one text's ids and of the bytes that they decode to."""

    def __init__(self) -> None:
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def take(self, machine: MergeReplay, pieces: list[str]) -> None:
        ids = array("I", b"".join(map(machine.ids.__getitem__, pieces)))
        if ids:
            self.ids.update((("," if self.n else "") + ",".join(map(machine.words.__getitem__, ids))).encode())
            self.decoded.update(machine.decode(ids))
            self.n += len(ids)


def stretches(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= WHOLE_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, STRETCH)):
        yield part


def digests(machine: MergeReplay, pattern: regex.Pattern, texts: list[str | None]) -> list[Digest]:
    out, held, size = [Digest() for _ in texts], [], 0

    def flush() -> None:
        machine.learn(set().union(*(p for _, p in held)))
        for digest, part in held:
            digest.take(machine, part)
        machine.forget_long()
        held.clear()

    for digest, text in zip(out, texts, strict=True):
        for part in stretches(pattern, text or ""):
            held.append((digest, part))
            size += len(part)
            if size >= STRETCH:
                flush()
                size = 0
    flush()
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def machine(vocabulary: str) -> tuple[MergeReplay, regex.Pattern]:
    """One for each Python worker, which serves many tasks."""
    import public_tokenizers

    return MergeReplay(load_ranks(public_tokenizers.path(vocabulary))), regex.compile(public_tokenizers.PATTERN)


def encode_ids(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids of every row: the token ids of whole texts, as token_digests() digests them; null and empty texts have none."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pattern = machine(vocabulary)
        for keys, texts in columns(batches, "doc_id", "text"):
            for key, text in zip(keys, texts, strict=True):
                ids = array("I")
                for part in stretches(pattern, text or ""):
                    replay.learn(set(part))
                    ids.frombytes(b"".join(map(replay.ids.__getitem__, part)))
                    replay.forget_long()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key], pa.int64()), "ids": pa.array([np.frombuffer(ids, np.uint32).astype(np.int32)], pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, decoded (binary) of rows (doc_id, ids); null ids decode to nothing, an unknown id is an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, _ = machine(vocabulary)
        for keys, ids in columns(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "decoded": pa.array([replay.decode(x or ()) for x in ids], pa.binary())})

    return rows.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, decoded binary")


def token_digests(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)
    of every row of docs, in one pass without a shuffle.

    A null or empty text has no tokens and the digests of nothing; repeated rows each give a row; an empty table gives none;
    other columns are not read. The vocabulary is a file of the public tokenizers, found on each executor. Memory: the ranks,
    the pieces of a stretch and MEMORY remembered pieces for a Python worker.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pattern = machine(vocabulary)
        for keys, texts in columns(batches, "doc_id", "text"):
            found = digests(replay, pattern, texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array([d.n for d in found], pa.int64()),
                "ids_sha256": pa.array([d.ids.hexdigest() for d in found]), "decoded_sha256": pa.array([d.decoded.hexdigest() for d in found]),
            })

    return docs.select("doc_id", "text").mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
