import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitengine.llm import hard_negatives as H

ROWS = "vec_id long, label int, embedding array<float>, key string, block int, dim int"


def plain(rows, anchors=100, positives=5, negatives=10):
    """By definition, over every pair; rows are told apart by their place."""
    used = []
    for k, r in enumerate(rows):
        if r[0] is None or r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[2]):
            continue
        used.append((k, r[0], (r[1] + 1) % 10 if r[0] % 7 == 0 else r[1], [math.floor(256 * float(np.float32(x))) for x in r[2]]))
    out = []
    for k, i, label, v in used:
        if i % anchors:
            continue
        others = [(sum(map(int.__mul__, v, w)), j, other) for m, j, other, w in used if m != k and len(w) == len(v)]
        ordered = sorted(others, key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in ordered if x[2] == label][:positives]:
            hard = [x for x in ordered if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(i, pid, rank, x[1], p, x[0]) for rank, x in enumerate(hard, 1)]
    return sorted(out)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    for dim, spread in ((64, 32), (7, 1000), (1, 3), (0, 1), (6, 2**25)):
        vectors = np.rint(rnd.normal(0, spread, (500, dim))).astype(np.int64)
        vectors[:200] = vectors[0] if dim else 0  # a hot vector
        cells, lows, highs = H.cells_of(vectors)
        n = len(vectors)
        raw = {"dim": dim, "ids": np.arange(n), "labels": np.zeros(n, np.int64), "keys": np.arange(n), "vectors": vectors.astype(np.int32), "cells": cells, "lows": lows, "highs": highs}
        block = H.Block({k: v if k == "dim" else np.ascontiguousarray(v).tobytes() for k, v in raw.items()})
        lower, upper = block.bounds(vectors[100:260])
        exact = vectors[100:260] @ vectors.T
        assert (lower <= exact).all() and (exact <= upper).all()
        if dim == 64:
            best = np.sort(lower, axis=1)[:, -5]
            assert (upper >= best[:, None]).mean() < 0.6


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{folder}/embeddings.parquet'")
    want = con.sql(H.ORACLE)
    got = H.query(spark, f"/root/testdata/{folder}")
    assert got.columns == want.columns and [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 200


def odd_rows():
    rnd = random.Random(2)
    rows = []
    for k in range(400):
        v = [rnd.gauss(0, 0.3) for _ in range(6)]
        rows.append((k, rnd.randrange(3), v, "k", 1, 2))
    hot = [0.5, -0.25, 0.125, 0.3, 0.1, 0.2]
    rows += [(1000 + k, k % 2, hot, None, None, None) for k in range(150)]  # one vector, many ties
    rows += [(100, 1, hot, "k", 0, 0), (100, 1, hot, "k", 0, 0), (205, 2, hot, "k", 0, 0), (205, 2, hot, "k", 0, 0)]  # repeated rows and ids
    rows += [(300, None, hot, "", 0, 0), (400, 1, None, "", 0, 0), (500, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1], "", 0, 0), (600, 1, [0.1, math.nan, 0.1, 0.1, 0.1, 0.1], "", 0, 0), (700, 1, [math.inf] * 6, "", 0, 0), (None, 1, hot, "", 0, 0)]
    rows += [(800, 1, [0.5, 0.5, 0.5], "", 0, 0), (801, 1, [0.5, 0.25, 0.5], "", 0, 0), (803, 2, [0.25, 0.25, 0.25], "", 0, 0), (900, 1, [], "", 0, 0), (901, 1, [], "", 0, 0), (902, 2, [], "", 0, 0), (5000, 1, [0.0] * 6, "", 0, 0), (-100, 1, hot, "", 0, 0)]
    return rows


@pytest.mark.parametrize("blocks", [10**6, 600])
def test_odd_rows_match_brute_force(spark, tmp_path, monkeypatch, blocks):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS)
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(H, "BLOCK_VALUES", blocks)
    monkeypatch.setattr(H.mine, "__defaults__", (5, 10, (30, 90), blocks, 2 if blocks == 600 else 4096))
    got = sorted(tuple(r) for r in H.query(spark, str(tmp_path)).collect())
    assert got == plain(rows) and {r[0] for r in got} >= {-100, 0, 100, 800, 900}


def test_empty_tables_and_no_anchors(spark):
    none = spark.createDataFrame([], ROWS)
    assert H.mine(H.usable(none, "vec_id", F.col("label"), "embedding", 256), F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame([r for r in odd_rows() if r[0] and r[0] % 100], ROWS)
    assert H.mine(H.usable(some, "vec_id", F.col("label"), "embedding", 256), F.col("vec_id") % 100 == 0).count() == 0
