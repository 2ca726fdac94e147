"""Token counts by a finite-state transducer compiled from a merge-ordered piece vocabulary.

A text is normalised to pieces' alphabet (a leading word mark, spaces as word marks). Pieces hold word marks at their start
only, or nothing else, so a word mark after another character always starts anew: the transducer returns to its start state
there. Inside such a unit, the last piece of every prefix's encoding follows from the last pieces of shorter prefixes: it is
the longest piece ending there whose pairing with the piece before it is stable under the merges. A state therefore holds
the last pieces and relative counts of as many prefixes as some piece can still reach back to. States and transitions are
made when a text first needs them; each transition carries the number of tokens by which it moves the count.

A chunk of text acts on what comes before it as a map: the characters up to its first unit start extend the open unit,
then a fixed count follows, then its tail is the new open unit. These maps compose associatively, so a long text's chunks
are scanned in parallel prefix order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelyard.llm.words import columns

MARK = "▁"
OVER = 4096
CHUNK = 1 << 16
MEMORY = 800_000
STRIDE = 4


class Transducer:
    """Counts pieces unit by unit; `pieces` maps each piece to its rank (lower merges first, equal ranks from the left)."""

    def __init__(self, pieces: dict[str, float]):
        self.rank = pieces
        self.longest = max(map(len, pieces), default=1)
        self.heads = {p[:i] for p in pieces for i in range(1, len(p))}
        self.stable: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        # state: (open tail, last pieces and counts of the prefixes that end inside the tail or just before it)
        self.start = ("", ((None, 0),))
        # a state is the table of its transitions: characters to (next state, tokens added), and "" to what it stands for
        self.first: dict = {"": self.start}
        self.states: dict[tuple, dict] = {self.start: self.first}
        self.size = 0

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by the merges themselves; a character that is no piece stays as it is."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pairs(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        found = self.stable.get((left, right))
        if found is None:
            found = self.stable[left, right] = self.merge(left + right) == [left, right]
        return found

    def whole(self, piece: str) -> bool:
        """Whether the merges make this piece of its characters."""
        found = self.stable.get((piece, ""))
        if found is None:
            found = self.stable[piece, ""] = self.merge(piece) == [piece]
        return found

    def move(self, state: dict, char: str) -> tuple[dict, int]:
        """Next state and the tokens that char adds to the count of the open unit."""
        tail, behind = state[""]
        text = tail + char
        here = None
        for k in range(min(len(text), self.longest), 0, -1):
            piece = text[-k:]
            if k > 1 and piece not in self.rank or k > len(behind):
                continue
            last, count = behind[-k]
            if self.pairs(last, piece) and (k == 1 or self.whole(piece)):
                # a character that is no piece is spelled in bytes
                here = (piece, count + (1 if k > 1 or char in self.rank else len(char.encode("utf-8", "surrogatepass"))))
                break
        keep = next((k for k in range(min(len(text), self.longest - 1), 0, -1) if text[-k:] in self.heads), 0)
        added = here[1] - behind[-1][1]
        seen = (*behind, here)[-(keep + 1) :]
        base = seen[-1][1]
        new = (text[len(text) - keep :], tuple((p, c - base) for p, c in seen))
        target = self.states.get(new)
        if target is None:
            target = self.states[new] = {"": new}
        return target, added

    def stride(self, state: dict, chars: str) -> tuple[dict, int]:
        """The transition over a few characters at once, kept in the state's table."""
        target, total = state, 0
        for char in chars:
            step = target.get(char)
            if step is None:
                step = target[char] = self.move(target, char)
                self.size += 1
            target, added = step
            total += added
        self.size += 1
        state[chars] = target, total
        return target, total

    def count(self, unit: str) -> int:
        """Tokens of a unit, from the start state."""
        if self.size > 2 * MEMORY:
            self.reset()
        state, total = self.first, 0
        for i in range(0, len(unit), STRIDE):
            chars = unit[i : i + STRIDE]
            try:
                state, added = state[chars]
            except KeyError:
                state, added = self.stride(state, chars)
            total += added
        return total


class UnitCounts(dict):
    """Counts of units seen lately; what a full table forgets is counted again."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        n = self.machine.count(unit)
        if len(unit) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = n
        return n


UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def chunk_map(text: str, counts: UnitCounts) -> tuple[str, int | None, str]:
    """(head, tokens, tail) of a chunk: head extends the unit open before it; tokens is None where no unit starts inside."""
    first = re.search(f"(?<=[^{MARK}]){MARK}", text)
    if first is None:
        return text, None, ""
    units = UNIT.findall(text, first.start())
    return text[: first.start()], sum(map(counts.__getitem__, units[:-1])), units[-1]


def compose(a: tuple, b: tuple, counts: UnitCounts) -> tuple:
    """The map of two neighbouring chunks; a unit may also start right at their border."""
    (head, n, tail), (head2, n2, tail2) = a, b
    open_unit = (head if n is None else tail) + head2
    cut = re.search(f"(?<=[^{MARK}]){MARK}", open_unit)
    if cut is None:
        if n is None:
            return open_unit, n2, tail2
        return (head, n, open_unit) if n2 is None else (head, n + counts[open_unit] + n2, tail2)
    left, right = open_unit[: cut.start()], open_unit[cut.start() :]
    before = (left, 0) if n is None else (head, n + counts[left])
    return (*before, right) if n2 is None else (before[0], before[1] + counts[right] + n2, tail2)


def scan(maps: list[tuple], counts: UnitCounts) -> tuple:
    """All chunk maps composed, pairwise in log steps."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], counts) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(text: str | None, counts: UnitCounts, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    marked = MARK + text.replace(" ", MARK)
    if len(marked) <= chunk:
        return sum(map(counts.__getitem__, UNIT.findall(marked)))
    head, n, tail = scan([chunk_map(marked[i : i + chunk], counts) for i in range(0, len(marked), chunk)], counts)
    return counts[head] if n is None else counts[head] + n + counts[tail]


def load_pieces(path: str) -> dict[str, float]:
    """Piece to merge rank of a model file; bytes, control and unused pieces don't merge."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return {model.id_to_piece(i): -model.get_score(i) for i in ids}


@functools.lru_cache(maxsize=2)
def machine(vocabulary: str) -> UnitCounts:
    """One for each Python worker, which serves many tasks."""
    import public_tokenizers

    return UnitCounts(Transducer(load_pieces(public_tokenizers.path(vocabulary))))


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, in one pass without a shuffle.

    A null or empty text has no tokens; repeated rows each give a row; an empty table gives none; other columns are not
    read. The vocabulary is a file of the public tokenizers, found on each executor. Memory: one compiled transducer and
    two tables of at most MEMORY entries for a Python worker; a text is walked in chunks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = machine(vocabulary)
        for ids, texts in columns(batches, "doc_id", "text"):
            n = [count_tokens(t, counts) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > over for x in n], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
