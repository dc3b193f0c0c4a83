"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from quern.llm import topk


def brute(rows, asked, k=5):
    """The contract, row by row: every row is a candidate but the query's own."""
    vectors = [(vec_id, [math.floor(256 * x) for x in v]) for vec_id, v in rows if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, own) in enumerate(vectors):
        if q in asked:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), c) for at, (c, v) in enumerate(vectors) if at != place)
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("params", [topk.TopKParams(), topk.TopKParams(block=64, query_block=8, bucket=16, coordinate_from=0.2), topk.TopKParams(block=30, query_block=500, bucket=7, ranges=3)], ids=["plain", "pruned", "ranges"])
def test_norms_ties_and_repeats(spark, params):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(size=6) * np.exp(rng.normal())).tolist()) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(30)]  # one very common vector
    rows += [(500, None), (501, []), (502, [1.0, None, 2.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (505, [0.0] * 6), (506, [1.0]), (7, rows[7][1]), (10, rows[10][1]), (10, rows[11][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, score string")
    asked = [k for k in range(0, 507, 10)] + [501, 505, 506]
    assert rows_of(topk.top_k(df.filter(df.vec_id.isin(asked)), df, params)) == brute(rows, asked)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows_of(topk.top_k(df, df)) == [(0, 1, 1, 256 * 512), (1, 1, 0, 256 * 512)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_blocks_of_random_lengths():
    rng = np.random.default_rng(0)
    for _ in range(10):
        c = np.floor(rng.normal(size=(700, 8)) * np.exp(rng.normal(size=(700, 1))) * 50)
        ids = np.arange(700)
        i, s, v = topk.search_block(ids[::9], c[::9], ids, c, topk.TopKParams(bucket=64, coordinate_from=0.3))
        full = c[::9] @ c.T
        for k, own in enumerate(ids[::9]):
            want = sorted((-int(full[k, x]), int(x)) for x in ids if x != own)[:5]
            assert sorted(zip((-s[i == k]).tolist(), v[i == k].tolist(), strict=True)) == want


def test_large_components_are_exact_or_an_error(spark):
    rows = [(k, [float((-1) ** k * (2**31 + 7 * k)), float(k)]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, df).collect()
    small = [(k, [x / 2**15 for x in v]) for k, v in rows]
    df = spark.createDataFrame(small, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, df)) == brute(small, range(12))
    mixed = [(0, [2.0**40, 1.0]), (1, [2.0**6, 3.0]), (2, [-(2.0**6), 0.5])]  # beyond doubles, within a long
    df = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df.filter("vec_id = 0"), df)) == brute(mixed, [0])
    q, c = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**21 + 3, -7.0]])
    assert topk.exact_kind(q, c, 2.0**63) is object
    assert topk.products(topk.as_kind(q, object), topk.as_kind(c, object), object).tolist() == [[int(q[0, 0]) * int(v[0]) + 3 * int(v[1]) for v in c]]


def test_short_ranges_are_not_asked(spark):
    """Queries whose best come from the longest vectors send nothing to the ranges of short ones."""
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=4) * (1000 if k < 100 else 0.001)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = topk.TopKParams(block=100, ranges=4)
    asked = df.filter("vec_id % 50 = 0 and vec_id < 100")
    assert rows_of(topk.top_k(asked, df, p)) == brute(rows, [0, 50])


def test_equals_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert rows_of(topk.op3_topk(spark, small)) == sorted(con.execute(topk.TOPK_SQL).fetchall())
