import hashlib
import random
from collections import Counter

import pytest

from reelyard.llm import repeats
from tests.llm.cases import ODD, none, odd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("most", [1000, 1])
def test_against_brute_force(spark, most):
    draw = random.Random(most)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(45)
    texts = [text(80) for _ in range(6)]
    texts += [text(20) + shared + text(20) for _ in range(8)] + [line + text(9) for _ in range(9)] + [shared[:260] + text(5) + shared[100:]] * 3
    texts += ["ab" * 300, "ab" * 150 + text(30), text(90) + line + text(3) + line, None, "", "x" * 199, "y" * 200, "y" * 200, "z" * 201]
    base = text(120)
    for _ in range(8):
        at = draw.randrange(len(base))
        texts.append(base[:at] + word() + base[at + 3 :])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *w) for i, w in enumerate(brute(texts, 200)))
    assert rows_of(repeats.remove_repeats(docs, most=most)) == want


@pytest.mark.parametrize("length", [20, 200, 320, 500])
def test_other_lengths_and_null_ids(spark, length):
    draw = random.Random(length)
    text = lambda n: "".join(draw.choice("abcd ") for _ in range(n))
    shared = text(900)
    texts = [text(300) + shared[draw.randrange(200) : 900 - draw.randrange(200)] + text(300) for _ in range(7)] + [text(1200) for _ in range(4)] + [shared, shared, None, ""]
    for ids in (range(len(texts)), [None] * len(texts), [1] * len(texts)):
        rows = list(zip(ids, texts, strict=True))
        want = sorted((-1 if i is None else i, *w) for (i, _), w in zip(rows, brute(texts, length), strict=True))
        assert rows_of(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, most=3)) == want


def test_a_hot_anchor_with_very_many_segments(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(400):
        copy = [word(), *passage, word()]
        copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(repeats.remove_repeats(docs, most=20)) == sorted((i, *w) for i, w in enumerate(brute(texts, 200)))


def test_matching_statistics():
    import numpy as np

    draw = random.Random(5)
    for _ in range(40):
        symbols = np.array([draw.randint(0, 2) for _ in range(draw.randint(1, 60))], np.int16)
        n = len(symbols)
        got = repeats.RunIndex(symbols, np.arange(n), 200).matching_statistics()
        s = symbols.tolist()
        common = lambda i, j: next((k for k in range(n - max(i, j)) if s[i + k] != s[j + k]), n - max(i, j))
        assert got.tolist() == [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]


def test_odd_rows(spark):
    want = sorted((r[0] or -1, *w) for r, w in zip(ODD, brute([r[1] for r in ODD], 200), strict=True))
    assert rows_of(repeats.remove_repeats(odd(spark))) == want
    assert repeats.remove_repeats(none(spark)).count() == 0
