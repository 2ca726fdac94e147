import zlib
from itertools import product

import numpy as np

from reelyard.llm.sharding import hilbert, hilbert_shards, measured, with_level
from tests.llm.cases import ODD, none, odd


def test_curve_visits_every_cell_by_unit_steps():
    cells = np.array(list(product(range(8), repeat=3))).T
    order = np.argsort(hilbert(cells, 3))
    assert sorted(hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[:, order], axis=1)).sum(axis=0) == 1).all()


def test_counts_slots_and_digests(spark):
    rows = hilbert_shards(measured(odd(spark)), 4).collect()
    assert len(rows) == len(ODD)
    counts = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(4)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)
    texts = {r[0]: (r[1] or "").encode() for r in ODD}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    assert {r["rank"] for r in rows} == {"x"}
    order = [(r["hilbert"], r["text_crc32"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_values_keep_their_order(spark):
    names = ["web", "web2", "wiki", "books", None, "w"]
    rows = with_level(spark.createDataFrame([(n,) for n in names * 3], "source string"), "source", "level").distinct().collect()
    level = {r["source"]: r["level"] for r in rows}
    assert level[None] == 0 and [n for n, _ in sorted(level.items(), key=lambda x: x[1]) if n] == sorted(n for n in names if n) and max(level.values()) == 1023


def test_shards_are_narrow_in_every_dimension(spark):
    draw = np.random.default_rng(2)
    kinds = [(int(i), "x" * int(draw.integers(1, 4000)), str(draw.choice(["de", "en", "es", "fr"])), str(draw.choice(["web", "web2", "wiki", "books"]))) for i in range(800)]
    rows = hilbert_shards(measured(spark.createDataFrame(kinds, "doc_id long, text string, lang string, source string")).drop("text"), 8).collect()
    seen = [len({(r["lang"], r["source"]) for r in rows if r["shard"] == k}) for k in range(8)]
    assert sum(seen) / 8 < 9  # of 16, dealt at random all


def test_few_rows_and_none(spark):
    assert hilbert_shards(measured(none(spark)), 8).count() == 0
    assert sorted(r["slot"] for r in hilbert_shards(measured(odd(spark).limit(3)), 8).collect()) == [0, 0, 0]
