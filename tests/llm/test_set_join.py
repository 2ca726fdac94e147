import random
from itertools import combinations

import numpy as np
import pytest

from reelyard.llm import set_join
from tests.llm.cases import ODD, none, odd


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    sets, up = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("sizes", [{}, {"short": 2, "leaders": 0, "cell": 8, "many": 1}])
def test_against_brute_force(spark, sizes):
    draw = random.Random(9)
    word = lambda: f"w{draw.randint(0, 4000)}"
    line, rows = " ".join(word() for _ in range(12)), []
    for family in range(14):
        base = [word() for _ in range(draw.choice((6, 20, 60, 120)))]
        for _ in range(draw.choice((1, 2, 5, 14))):
            copy = list(base)
            for _ in range(draw.choice((0, 1, 2, 4))):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy[: len(copy) - draw.choice((0, 0, 2))]) + (f" {line}" if family % 2 else "")))
    rows += [(len(rows) + k, line) for k in range(3)]
    got = sorted(tuple(r) for r in set_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"leaders": 0, "cell": 32, "many": 2, "block": 32}])
def test_many_near_copies_of_one_another(spark, sizes):
    draw = random.Random(4)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    base, rows = [word() for _ in range(80)], []
    for _ in range(300):
        copy = list(base)
        for _ in range(draw.choice((1, 2, 2, 3, 4))):
            copy[draw.randrange(len(copy))] = word()
        rows.append((len(rows), " ".join(copy)))
    tail = [word() for _ in range(60)]
    rows += [(len(rows) + k, " ".join([word() for _ in range(draw.choice((6, 9, 14, 40)))] + tail)) for k in range(60)]
    got = sorted(tuple(r) for r in set_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect())
    assert got == brute(rows)


def test_meetings_are_all_pairs_within_the_bounds():
    draw = np.random.default_rng(3)
    n = draw.integers(4, 60, 400)
    group, place = draw.integers(0, 12, 400), (draw.random(400) * n / 4).astype(np.int64)
    kind = draw.integers(0, 9, 400)
    order = np.lexsort((n, group))
    group, n, place, kind = group[order], n[order], place[order], kind[order]
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in set_join.meetings(group, n, place, kind)), strict=True)}
    want = set()
    for i, j in combinations(range(400), 2):
        if group[i] == group[j] and kind[i] != kind[j] and any(n[x] <= n[y] and set_join.may_pass(n[x], place[x], n[y], place[y]) for x, y in ((i, j), (j, i))):
            want.add((i, j))
    assert got == want


def test_odd_rows(spark):
    named = [(r[0], r[1]) for r in ODD if r[0] is not None]
    want = brute(list(dict(named).items()))
    rows = set_join.similarity_classes(odd(spark)).collect()
    assert sorted({tuple(r) for r in rows if r["doc_id"] is not None}) == want and len(rows) == len(ODD)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert set_join.similarity_classes(none(spark)).count() == 0
