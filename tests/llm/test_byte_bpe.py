import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from reelyard.llm import byte_bpe
from tests.llm.cases import LONG, ODD, none, odd

SF = "/root/testdata/sf0.01"
NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(NAME))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_all_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = byte_bpe.token_digests(docs).collect()
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(library, texts[r["doc_id"]]) for r in rows)


def test_drawn_texts_equal_the_library(library):
    """Adjacent repeats, where a new pair can rank before the one that made it, and characters of every kind."""
    draw, (replay, pattern) = random.Random(5), byte_bpe.machine(NAME)
    texts = ["".join(draw.choice("abetnrsio") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice("aAé ß日本\t\n  0123'sll!?#<|endoftext|>  \x1c\x00😀") for _ in range(draw.randint(1, 80))) for _ in range(3000)]
    texts += ["x" * 5000, "ab" * 3000, " " * 300 + "a", "the" * 999, "".join(map(chr, range(1, 0xD800))), "", None]
    for text, found in zip(texts, byte_bpe.digests(replay, pattern, texts), strict=True):
        assert (found.n, found.ids.hexdigest(), found.decoded.hexdigest()) == want(library, text)


def test_merges_that_rank_before_their_maker():
    """With made ranks a later place of a rank must wait for a pair that the first place brought about."""
    ranks = {bytes([b]): b + 1000 for b in range(256)} | {b"ab": 9, b"aba": 3, b"abab": 2, b"bb": 5}

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw, replay = random.Random(1), byte_bpe.MergeReplay(ranks)
    words = [bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 14))) for _ in range(2000)] + [b"ababab", b"aababb"]
    assert replay.replay(words) == [plain(w) for w in words]


def test_stretches_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 50)
    monkeypatch.setattr(byte_bpe, "WHOLE_TEXT", 1000)
    monkeypatch.setattr(byte_bpe, "MEMORY", 60)
    replay, pattern = byte_bpe.MergeReplay(byte_bpe.load_ranks(public_tokenizers.path(NAME))), byte_bpe.machine(NAME)[1]
    texts = [LONG[:20_000], "z" * 700, None, LONG[5_000:9_000]]
    for text, found in zip(texts, byte_bpe.digests(replay, pattern, texts), strict=True):
        assert (found.n, found.ids.hexdigest(), found.decoded.hexdigest()) == want(library, text)
    assert len(replay.older) <= 200 and "z" * 700 not in replay.ids | replay.older


def test_odd_rows_and_round_trip(spark, library):
    rows = byte_bpe.token_digests(odd(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted((r[0] or 0, *want(library, r[1])) for r in ODD)
    assert byte_bpe.token_digests(none(spark)).count() == 0
    ids = byte_bpe.encode_ids(odd(spark))
    back = [(r["doc_id"], bytes(r["decoded"]).decode()) for r in byte_bpe.decode_ids(ids).collect()]
    assert sorted(back, key=str) == sorted(((r[0], r[1] or "") for r in ODD), key=str)
