"""Hard-negative mining against brute force over all pairs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlog.llm import negatives as N

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                     T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.IntegerType())])


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    good = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in good:
        if is_anchor(i) and (i not in anchors or (label, v) < anchors[i]):
            anchors[i] = (label, v)
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if i != a and len(w) == len(v))
        for place, (ps, pid, _) in enumerate([s for s in scored if s[2] == label][:positives], 1):
            window = [s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(a, pid, rank, nid, -ps, -ns, place) for rank, (ns, nid, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, ROWS)
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % 5 == 0, **more).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 64), (64, 64, 64), (65, 70, 33), (5, 200, 90), (128, 65, 31)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    n, k, m = shape
    for reach in (4, 1 << 20, 1 << 28):  # sums of the recursion may wrap, the product may not
        a, b = rng.integers(-reach, reach, (n, k)), rng.integers(-reach, reach, (k, m))
        assert (N.strassen(a, b, 4) == a.astype(object) @ b.astype(object)).all()


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        v = [rng.choice([0.5, 0.25, -0.25, rng.uniform(-1, 1)]) for _ in range(8)]
        rows.append((i, rng.randint(0, 2), v, 1))
    rows += [(200 + i, i % 3, [0.5] * 8, 1) for i in range(40)]                  # one vector, many rows
    rows += [(1, 0, rows[1][2], 1), (10, 1, rows[10][2], 1), (10, 0, rows[11][2], 1)]   # repeated ids
    rows += [(300, 1, None, 1), (305, None, [0.5] * 8, 1), (None, 1, [0.5] * 8, 1), (310, 1, [float("nan")] * 8, 1),
             (315, 1, [None] * 8, 1), (320, 1, [float("inf")] * 8, 1), (325, 1, [], 1), (330, 1, [1.0, 2.0], 1), (335, 1, [2.0, 1.0], 1), (331, 2, [2.0, 0.0], 1)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(N, "CELL_ANCHORS", 7)
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    monkeypatch.setattr(N, "TILE_ANCHORS", 3)
    monkeypatch.setattr(N, "TILE_ROWS", 6)
    monkeypatch.setattr(N, "LEAF", 2)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=1, low=10, high=60) == brute(rows, lambda i: i % 5 == 0, 2, 1, 10, 60)


def test_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], 1)]) == []
    with pytest.raises(Exception, match="64 bits|62 bits"):
        mined(spark, [(0, 1, [3e37], 1), (1, 1, [3e37], 1)])


def test_speed_of_a_tile():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-200, 200, (512, 64)), rng.integers(-200, 200, (64, 2048))
    took = []
    for leaf in (1 << 20, 64, 32, 16):
        t = time.perf_counter()
        N.strassen(a, b, leaf)
        took.append(round(time.perf_counter() - t, 4))
    print("\nplain, 0, 1, 2 levels:", took)
