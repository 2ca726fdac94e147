import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelyard.llm import resampling
from tests.llm.cases import ODD, none, odd

SF = "/root/testdata/sf0.01"


def features(text, longest=1):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows, target, n=10_000, longest=1, percent=10, least=20):
    """The rule read literally: doc_id, n_features, weight, score, rank."""
    bucket = lambda f: zlib.crc32(f) % n
    found = [(i, *features(t, longest)) for i, t in rows]
    s, t = Counter(bucket(f) for _, fs, _ in found for f in fs), Counter(bucket(f) for x in target for f in features(x, longest)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out, known = [], 0
    for i, fs, words in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
        known += words >= least
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))[: percent * known // 100]
    rank = {r[0]: k for k, r in enumerate(order, 1)}
    return sorted((*r[:4], rank.get(r[0])) for r in out)


@pytest.mark.parametrize(("longest", "n", "percent"), [(1, 10_000, 10), (3, 500, 37)])
def test_equals_the_plain_rule(spark, longest, n, percent):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], n, longest, percent)
    got = sorted(tuple(r) for r in resampling.resample(docs, target, percent, n=n, longest=longest).collect())
    assert got == want and any(r[4] for r in got)


def test_blocks_hold_every_document(spark, monkeypatch):
    texts = [(i, " ".join(f"w{j % (i + 1)}" for j in range(i))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    blocks = resampling.bucket_streams(docs).collect()
    for b in blocks:
        stream = np.frombuffer(b["stream"], "<u2")
        assert len(b["offsets"]) == len(b["ids"]) + 1 and b["offsets"][-1] == len(stream)
        for i, low, high in zip(b["ids"], b["offsets"], b["offsets"][1:], strict=False):
            assert stream[low:high].tolist() == [zlib.crc32(f) % 10_000 for f in features(texts[i][1])[0]]
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(300))


def test_run_lengths():
    values = np.array([5, 1, 5, 5, 65535, 1, 0], np.uint16)
    got = resampling.run_lengths(values)
    assert [x.tolist() for x in got] == [[0, 1, 5, 65535], [1, 2, 3, 1]]
    assert [len(x) for x in resampling.run_lengths(values[:0])] == [0, 0]


def test_odd_rows(spark):
    target = spark.createDataFrame([(1, "word1 runs2 a b"), (2, None)], "item_id long, text string")
    rows = resampling.resample(odd(spark), target, percent=50, least_words=3).collect()
    assert len(rows) == len(ODD)
    known = sum(features(r[1])[1] >= 3 for r in ODD)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, known // 2 + 1))
    assert all(r["weight"] == 0 and r["rank"] is None for r in rows if r["n_features"] == 0)
    copies = [tuple(r)[:4] for r in rows if r["doc_id"] == 11]
    assert len(copies) == 2 and copies[0] == copies[1]
    assert resampling.resample(none(spark), target).count() == 0
    flat = resampling.resample(odd(spark), target.limit(0), percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in flat) == list(range(1, len(ODD) + 1))
