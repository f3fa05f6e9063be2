import zlib
from collections import Counter

from pyspark.sql import functions as F

from packetlog.llm import sharding
from packetlog.llm.sharding import Shard, default_tree, descend, grow


def placed(spark, tree, n=6000):
    return [r.s for r in descend(spark.range(n).withColumn("k", F.col("id").cast("string")), tree, "k", "s").orderBy("id").collect()]


def test_rows_slots_and_growth(spark, docs, empty):
    rows = [(k, "x" * (k % 50)) for k in range(3000)] + [(5000, None), (None, "é"), (None, None), (7, "other"), (8, "x" * 8), (8, "x" * 8)]
    rows += [(9, "same")] * 300  # a hot id
    found = sharding.assign(docs(rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == sizes
    for shard in range(24):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in found) and any(r.grown_shard == 24 for r in found)
    assert len({r.shard for r in found if r.doc_id == 9}) == 1
    assert sharding.assign(empty).count() == 0


def test_weights_draw_in_proportion_and_confine_movement(spark):
    tree = [s._replace(weight=1.0 + s.shard % 3) for s in default_tree(12)]
    before = placed(spark, tree)
    total = sum(s.weight for s in tree)
    for s in tree:
        assert abs(before.count(s.shard) / len(before) - s.weight / total) < 0.02
    heavier = [s._replace(weight=s.weight * 3) if s.shard == 5 else s for s in tree]
    region = {s.shard: s.region for s in tree}
    rack = {s.shard: s.rack for s in tree}
    for a, b in zip(before, placed(spark, heavier)):
        if a != b:  # towards the subtree that gained weight, at some level
            assert region[b] == region[5] and (region[a] != region[b] or rack[b] == rack[5])
    assert all(b in (a, 12) for a, b in zip(before, placed(spark, grow(tree))))
    assert 3 not in placed(spark, [s._replace(weight=0.0) if s.shard == 3 else s for s in tree])
    assert set(placed(spark, [Shard(4, "r", "k")], 10)) == {4}
