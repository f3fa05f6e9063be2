import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlog.llm import topk


def brute(rows, k, step):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        own = min(v for i, v in usable if i == q)
        near = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return out


def run(spark, rows, k=5, step=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % step == 0, k).collect())


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, .3, 6)]) for i in range(60)]
    rows += [(i, rows[7][1]) for i in range(60, 90)]  # a large group of equal vectors
    rows += [(100, None), (105, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (110, [float("nan")] * 6), (115, [float("inf")] * 6), (None, [0.1] * 6)]
    rows += [(120, [0.5, 0.25]), (121, [0.5, 0.5]), (125, [1.0] * 9), (61, rows[61][1]), (10, rows[10][1])]
    assert run(spark, rows) == sorted(brute(rows, 5, 5))


def test_fewer_candidates_blocks_and_empty(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (6, [-1.0, 2.0])]
    assert run(spark, rows) == sorted(brute(rows, 5, 5))
    assert run(spark, []) == []
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    many = [(i, [float(i % 7), -float(i % 3)]) for i in range(40)]
    assert run(spark, many, 3) == sorted(brute(many, 3, 5))


def test_scores_beyond_doubles_are_exact_and_beyond_longs_raise():
    block = topk.Block(np.array([0]), np.array([[2.0 ** 30, 1.0]]))
    assert block.scores(np.array([[2.0 ** 30, 1.0]])).tolist() == [[2 ** 60 + 1]]
    with pytest.raises(OverflowError):
        block.scores(np.array([[2.0 ** 40, 1.0]]))
    assert block.scores(np.array([[1.0, 2.0 ** 40]])).tolist() == [[2 ** 30 + 2 ** 40]]


def test_large_components_whose_scores_fit(spark):
    rows = [(i, [2.0 ** 30 if i % 2 else 0.0, float(i), 0.0 if i % 2 else 2.0 ** 30]) for i in range(20)]
    kept = [r for r in rows if r[0] % 2 == 0][:1] + [r for r in rows if r[0] % 2]
    assert run(spark, kept, 3, 10) == sorted(brute(kept, 3, 10))


def test_blocks_leave_no_broadcast_and_a_plan_of_one_scan(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    alive, make = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: alive.append(make(v)) or alive[-1])
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") % 10 == 0)
    assert found.count() == 15 and found._jdf.queryExecution().toString().count("FileScan") <= 2
    assert len(alive) >= 6 and not any(b._jbroadcast.isValid() for b in alive)
