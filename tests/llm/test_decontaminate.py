import random
import re

from pyspark.sql import functions as F

from packetlog.llm import decontaminate


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def test_against_brute_force(spark, docs, empty):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([5, 6, 7, 9, 12, 14, 20, 33, 40, 59, 90, 200])]
    rows = []
    for k in range(60):
        text = say(rng.choice([0, 3, 30, 300]))
        for _, t in rng.sample(items, rng.randint(0, 3)):
            part = t.split(" ")
            cut = rng.random()
            if cut < .3:  # an edit, or a part only
                part[rng.randrange(len(part))] = "edited"
            elif cut < .5:
                part = part[:max(1, int(len(part) * rng.random()))]
            at = rng.randint(0, len(text))
            text[at:at] = part if rng.random() < .5 else [p.upper() + "," for p in part]
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, " ".join(say(20000) + items[8][1].split(" ") + say(500))), (5, rows[5][1]), (None, items[7][1])]
    items += [(50, None), (51, ""), (52, "too short here"), (None, items[6][1]), (6, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("keys", F.lit(0))
    want = {}
    for i, t in rows:
        for j, u in items:
            s = shingles(u)
            if s and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9:
                want[i, j] = (len(s & shingles(t)), len(s))
    found = decontaminate.contained_items(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in found} == want and len(found) == len(want) > 20
    kept = decontaminate.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    bad = {i for i, _ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in bad)
    assert decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs(rows), bench.where("false")).count() == len(rows)


def test_size_classes():
    assert [decontaminate.size_class(n) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17)] == [0, 1, 2, 2, 3, 3, 4, 4, 5]


def test_items_with_repeated_shingles(spark, docs):
    rng = random.Random(21)
    new = iter(range(10 ** 6))
    fresh = lambda n: [f"r{next(new)}" for _ in range(n)]
    items, rows = [], []
    for k in range(60):
        refrain = fresh(rng.choice([1, 2, 3, 5, 8]))
        item = refrain * (64 // len(refrain))
        if k % 3 == 0:  # different shingles far apart
            item = [w for _ in range(6) for w in [*fresh(6), *refrain * 40]]
        items.append((k, " ".join(item)))
        once = item if k % 3 == 0 else refrain * (4 // len(refrain) + 2)
        rows += [(2 * k, " ".join(fresh(rng.randint(0, 300)) + item + fresh(300))), (2 * k + 1, " ".join(fresh(200) + once + fresh(200)))]
    rows.append((1000, " ".join(fresh(500))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j): len(shingles(u) & shingles(t)) for i, t in rows for j, u in items if len(shingles(u) & shingles(t)) >= 0.8 * len(shingles(u)) - 1e-9}
    found = decontaminate.contained_items(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want and len(found) == len(want) == 120
