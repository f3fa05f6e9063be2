import random

import numpy as np
import zlib
from pyspark.sql import functions as F

from packetlog.llm import toxicity


def brute_segments(s):
    """All maximal segments by definition: repeatedly the best one, left and right of it again."""
    if len(s) == 0:
        return []
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*brute_segments(s[:a]), (a, b, best[0]), *[(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]]


def test_segments_match_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1.5, -1, 1, 2.25, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(s, float))
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def corpus():
    rng = random.Random(4)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(5):
                text[rng.randrange(60)] = rng.choice(["nastyone", "vileword", "rottenest"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy_passages_and_edges(spark, docs, empty):
    rows, labels = corpus()
    lab = spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    table = docs([*rows, (900, None), (901, ""), (None, "nastyone vileword"), (0, rows[0][1])])
    model = toxicity.fit(table, lab)
    found = toxicity.score_toxicity(table, model).withColumn("held_out", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert held and sum((r.score >= toxicity.CUT) == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in found}
    assert by[900].score == by[901].score == 0 and by[None].score >= toxicity.CUT
    assert all(0 <= r.score <= 1 for r in found) and by[0].passages and all(p.e_value <= toxicity.E_VALUE for p in by[0].passages)
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_nothing_to_learn_scores_zero(spark, docs):
    table = docs(["a b", "c d"])
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(table, labels) is None
    assert [r.score for r in toxicity.score_toxicity(table, None).collect()] == [0.0, 0.0]
    assert toxicity.fit(table, labels.where(F.lit(False))) is None
