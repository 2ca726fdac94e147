from collections import Counter

from reelyard.llm import decontaminate
from tests.llm.cases import none, odd

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def bag(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def brute(docs, items):
    found = {}
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            n = len(words(item))
            if n and ws:
                best = max(similarity(bag(ws[s : s + n]), bag(words(item))) for s in range(max(1, len(ws) - n + 1)))
                if best >= 0.75:
                    found[d, i] = max(best, found.get((d, i), 0))
    return found


def test_against_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(40))
    near = item.replace("w3 ", "other ")
    docs = [(1, f"lead {item} tail"), (2, f"lead {near} tail"), (3, item[: len(item) // 2]), (4, item.replace("w20", "x")), (5, item.replace("w10", "x").replace("w20", "y").replace("w30", "z")), (6, None), (7, "two words"), (8, "Before TWO words after"), (9, item + " " + item), (10, "")]
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(30)) + " q"), (6, "w1 w2 w3 w4 w5 w6")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(i, t) for i, t in items if t])
    for size in (5000, 2):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(left, right, block_items=size).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert {r["doc_id"] for r in decontaminate.clean_rows(left, right, block_items=size).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").limit(60), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.limit(12).collect()])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items.limit(12)).collect()}
    assert got == set(want)


def test_recall_of_the_index_over_all_documents_and_items(spark):
    """Every similar window of all documents and items, found without fingerprints, is found; the index lets few others pass."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, items).collect()}
    texts, of = [(r["item_id"], words(r["text"])) for r in items.collect()], {}
    for i, ws in texts:
        for k in bag(ws):
            of.setdefault(k, set()).add(i)
    sized, want = dict(texts), {}
    for r in docs.collect():
        ws, starts = words(r["text"]), {}
        for width in {min(5, len(w)) for _, w in texts}:
            for at in range(len(ws) - width + 1):
                for i in of.get(tuple(ws[at : at + width]), ()):
                    n = len(sized[i])
                    starts.setdefault(i, set()).update(range(max(0, at + width - n), max(0, min(at, len(ws) - n)) + 1))
        for i, found in starts.items():
            best = max(similarity(bag(ws[s : s + len(sized[i])]), bag(sized[i])) for s in found)
            if best >= 0.75:
                want[r["doc_id"], i] = best
    assert len(want) >= 20 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    work = decontaminate.index_report(docs, items).first()
    assert work["windows"] > 0 and len(want) <= work["candidates"] <= 0.5 * work["pairs"]


def test_windows_at_the_threshold_are_never_lost():
    """Items of many lengths, with words changed, moved or repeated: the index finds what the exact similarity says."""
    import numpy as np

    draw, hits = np.random.default_rng(7), 0
    for n in (3, 5, 6, 9, 14, 30, 60, 200):
        base = [[f"t{w}" for w in draw.integers(0, 4 if n == 30 else 10_000, n)] for _ in range(8)]
        index = decontaminate.Items.build([(i, " ".join(w)) for i, w in enumerate(base)])
        for i, ws in enumerate(base):
            for changes in range(0, 2 + n // 12):
                text = list(ws)
                for at in draw.integers(0, n, changes):
                    text[at] = "new"
                text = ["lead"] * int(draw.integers(0, 9)) + text + ["tail"] * int(draw.integers(0, 9))
                want = {j for j, other in enumerate(base) if max(similarity(bag(text[s : s + n]), bag(other)) for s in range(max(1, len(text) - n + 1))) >= 0.75}
                assert set(index.matches(" ".join(text))) == want
                hits += len(want)
    assert hits > 100


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.matches(odd(spark), items).collect()) == [11, 11, 12]
    assert decontaminate.matches(odd(spark), items.limit(0)).count() == 0 and decontaminate.matches(none(spark), items).count() == 0


def test_lookup_finds_all_within_the_radius():
    import numpy as np

    draw = np.random.default_rng(2)
    for radius in (0, 3, 12):
        items = decontaminate.Items.build([(i, " ".join(map(str, draw.integers(0, 50, 20)))) for i in range(60)], radius)
        index = items.index[20]
        own = draw.integers(0, len(index.prints), 300)
        kinds = np.zeros(len(index.prints), np.int64)
        kinds[index.rows[0]] = index.keys[0] >> 32
        which, asked = kinds[own], index.prints[own].copy()
        for k in range(300):
            for bit in draw.choice(64, draw.integers(0, radius + 5), replace=False):
                asked[k] ^= np.uint64(1) << np.uint64(bit)
        want = {(k, int(p)) for k in range(300) for p, f, c in zip(index.items, index.prints, kinds, strict=True) if c == which[k] and int(asked[k] ^ f).bit_count() <= radius}
        assert set(zip(*(x.tolist() for x in items.near(20, which, asked)), strict=True)) == want
