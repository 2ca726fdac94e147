import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelyard.llm import bit_slices

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k=5):
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(q):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(q) if a != b and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, **sizes):
    vectors = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).select("vec_id", bit_slices.quantised(F.col("embedding")).alias("q")).where("q is not null and vec_id is not null")
    return sorted(tuple(r) for r in bit_slices.top_k(vectors, F.col("vec_id") % 50 == 0, **sizes).collect())


def test_signed_digits():
    for n in range(-300, 300):
        digits = bit_slices.signed_digits(n)
        assert sum(s << p for p, s in digits) == n and all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:], strict=False))


@pytest.mark.parametrize("sizes", [{}, {"row_block": 40, "least_block": 1}])
def test_against_brute_force(spark, sizes):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=6).astype(np.float32)]) for i in range(220)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 420)]  # ties
    rows += [(500, None), (501, []), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (551, [float("nan")] * 6), (552, [float("inf")] * 6), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (None, [1.0] * 6), (650, [0.0] * 6), (700, [9.0]), (50, rows[7][1]), (50, rows[8][1]), (51, rows[9][1]), (51, rows[9][1]), (750, []), (751, []), (751, [])]
    assert search(spark, rows, **sizes) == brute(rows)


def test_empty(spark):
    assert search(spark, []) == []


def test_scores_that_pass_62_bits_are_an_error(spark):
    with pytest.raises(Exception, match="62 bits"):
        search(spark, [(50, [1e8, 1e8]), (51, [1e8, 1.0])])
    for wide in (-3e38, 3e38, -float(2**54)):  # cut to 64 bits such a component would look like any other
        with pytest.raises(Exception, match="62 bits"):
            search(spark, [(50, [1.0, 1.0]), (51, [wide, 1.0])])


def test_sql_with_repeated_ids_and_empty_vectors(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in draw.normal(size=3).astype(np.float32)]) for i in draw.integers(0, 120, 90)] + [(50, []), (51, []), (None, [1.0] * 3), (100, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({bit_slices.OP4_SQL})").fetchall())
    assert want == brute(rows) and sorted(tuple(r) for r in bit_slices.op4_query(spark, str(tmp_path)).collect()) == want


def test_given_table_and_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({bit_slices.OP4_SQL})").fetchall())
    assert sorted(tuple(r) for r in bit_slices.op4_query(spark, "/root/testdata/sf0.001").collect()) == want
