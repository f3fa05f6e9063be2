"""Quality classifier: vectors and pooling by definition, held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from packetlog.llm import common as C
from packetlog.llm import quality as Q

SF = "/root/testdata/sf0.1"


def vectors_by_definition(texts):
    places, signs = Q.index_vectors()
    index = np.zeros((Q.BUCKETS, Q.DIM))
    for b in range(Q.BUCKETS):
        index[b, places[b]] = signs[b]
    sums = np.zeros((Q.BUCKETS, Q.DIM))
    for text in texts:
        ids = [zlib.crc32(w.encode()) % Q.BUCKETS for w in Q.WORD.findall(text)]
        for k, b in enumerate(ids):
            for j in (k - 1, k + 1):
                if 0 <= j < len(ids):
                    sums[b] += index[ids[j]]
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def test_word_vectors_and_pooling(docs, monkeypatch):
    texts = ["one two, three one", "", None, "two two two !!! four", "один два — три", "x"]
    monkeypatch.setattr(Q, "CHUNK", 3)
    got = Q.word_vectors(docs(texts))
    want = vectors_by_definition([t for t in texts if t])
    assert np.allclose(got, want, atol=1e-6)
    x = Q.pooled([t or "" for t in texts], Q.Buckets(), got)
    for row, text in zip(x, texts):
        ids = [zlib.crc32(w.encode()) % Q.BUCKETS for w in Q.WORD.findall(text or "")]
        if not ids:
            assert not row.any()
            continue
        v = want[ids]
        assert np.allclose(row, np.hstack([v.mean(axis=0), v.std(axis=0), np.log1p(len(ids)) / 10, len(set(ids)) / len(ids)]), atol=1e-3)


def test_held_out_accuracy(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    rows = Q.op12_quality(spark, SF).join(labels, "doc_id").where("quality IS NOT NULL").toPandas()
    assert Q.op12_quality(spark, SF).count() == docs.count()
    held = rows[rows["held_out"]]
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    auc = ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2
    kept, caught = (good >= Q.CUT).mean(), (bad < Q.CUT).mean()
    gap = abs(held["score"].mean() - held["quality"].mean())
    print(f"\nAUC {auc:.4f}, good kept {kept:.4f}, bad caught {caught:.4f}, calibration gap {gap:.4f}, n {len(held)}")
    assert auc > 0.95 and kept > 0.98 and caught > 0.8 and gap < 0.05
    assert (rows["predicted"] == (rows["score"] >= Q.CUT)).all()


def test_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (2, 1), (None, 1)], "doc_id long, quality int")
    rows = docs([(0, "a b c"), (1, None), (1, None), (2, ""), (None, "word " * 300_000), (3, "a b c")])
    got = Q.score_quality(rows, Q.fit(rows, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    one = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in Q.score_quality(rows, Q.fit(rows, one)).collect()} == {1.0}
    assert {r["score"] for r in Q.score_quality(rows, Q.fit(rows, one.limit(0))).collect()} == {0.5}
    assert Q.score_quality(empty, Q.fit(empty, labels)).collect() == []


def test_scores_do_not_depend_on_partitions(docs):
    texts = [f"word{k % 7} and {'!!!' if k % 3 else 'more'} text {k % 5}" for k in range(60)]
    table = docs(texts)
    labels = table.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    a, b = (Q.score_quality(d, Q.fit(d, labels)).toPandas().sort_values("doc_id") for d in (table.coalesce(1), table.repartition(7)))
    assert np.allclose(a["score"].to_numpy(), b["score"].to_numpy(), atol=1e-6)
