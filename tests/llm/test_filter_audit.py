import re
from itertools import permutations

import pytest

from reelyard.llm import filter_audit
from tests.llm.cases import none, odd

SF = "/root/testdata/sf0.01"


def masks(rows):
    """(doc_id, part, letters failed) of rows (doc_id, text, lang), by the rule read literally."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        yield i, lang or "", {k for k, bad in failed.items() if bad}


def plain(rows, labels):
    """Every order applied document by document."""
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    docs = list(masks(rows))
    out = {}
    for part in {p for _, p, _ in docs}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in docs if p == part]
            every = left
            for step, letter in enumerate(order, 1):
                here = [(i, f) for i, f in left if letter in f]
                gone = sum(letter in f for _, f in every) - len(here)
                left = [(i, f) for i, f in left if letter not in f]
                lost = [sum(i in ids for i, _ in here) for ids in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(here), gone, sum(f == {letter} for _, f in every), *lost]
    for key in out:
        letter = key[1][key[2] - 1]
        out[key].append(sum(v[1] for k, v in out.items() if k[0] == key[0] and k[1][k[2] - 1] == letter))
    return out


@pytest.mark.parametrize("given", ["table", "odd"])
def test_equals_the_plain_rule(spark, given):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if given == "table" else odd(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    if given == "odd":
        labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (7, None, 1), (None, 1, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    want = plain([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()])
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert got == want


def test_copies(spark):
    """The smallest doc_id of a text stays, in whatever part it is; rows of that id are no copies; null ids neither."""
    rows = [(5, "a", "x"), (3, "a", "y"), (3, "a", "y"), (None, "a", "x"), (9, "a", "x"), (1, None, "x"), (2, "", "x"), (None, None, None)]
    cells = filter_audit.failure_cells(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), {})
    got = sorted((r["part"], r["mask"], r["n"]) for r in cells.collect() if r["n"])
    assert got == [("", 0, 1), ("x", 0, 2), ("x", 1, 3), ("y", 0, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none(spark), empty).count() == 0
    assert filter_audit.filter_audit(odd(spark), empty).where("good_lost + toxic_lost > 0").count() == 0


def test_other_filters_and_orders(spark):
    cells = spark.createDataFrame([("p", 3, True, False, 10), ("p", 1, False, True, 5), ("p", 0, False, False, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): [2, 15, 0, 5, 10, 5, 20], ("XY", 2): [2, 0, 10, 0, 0, 0, 10], ("YX", 1): [7, 10, 0, 0, 10, 0, 10], ("YX", 2): [2, 5, 10, 5, 0, 5, 20]}
