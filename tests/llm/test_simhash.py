import itertools
import random

import numpy as np
import xxhash

from packetlog.llm import simhash
from packetlog.llm.components import connected_components


def brute_fingerprint(text, shingle=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits):
    group = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= bits and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    known = lambda g: [i for i, h in zip(ids, group) if h == g and i is not None]
    return [min(known(g), default=None) for g in group]


def test_fingerprints():
    for text in ("", " \t\n", "One", "a b c", "A b C d e", "É È a b c d", "x y " * 500, "no break here at all", "a\x1cb c d e"):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_keys_meet_at_two_errors():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    keys = [set(k[k >= 0].tolist()) for k in golay.keys(words)]
    assert {len(k) for k in keys} <= {1, 6}
    for w, own in zip(words.tolist(), keys):
        for a, b in [(rng.integers(23), rng.integers(23)) for _ in range(20)]:
            other = golay.keys(np.array([w ^ (1 << int(a)) ^ (1 << int(b)) if a != b else w ^ (1 << int(a))]))[0]
            assert own & set(other[other >= 0].tolist())


def test_every_pair_within_four_bits_shares_a_key():
    golay, rng = simhash.Golay(), random.Random(2)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows, keys = simhash.search_keys(np.array([a, b], np.uint64).view(np.int64), golay)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_links_of_small_and_large_groups(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:  # a dense ball, some strangers, a chain
        x = centre
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << bit
        fps.add(x)
    chain = rng.getrandbits(64)
    for step in range(10):
        fps.add(chain)
        for bit in range(4 * step, 4 * step + 4):
            chain ^= 1 << bit
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    want = brute_components(fps, fps, 4)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for block in (8192, 20):  # the second deals groups over blocks
        links = simhash.fingerprint_links(nodes, 4, block)
        label = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(links).collect()}
        got = {}
        for f in fps:
            got.setdefault(label.get(f, f), set()).add(f)
        assert {frozenset(g) for g in got.values()} == {frozenset(f for f, w in zip(fps, want) if w == v) for v in set(want)}
        assert links.count() < 3 * len(fps) * 10


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, **{200 + k: 100 for k in range(50)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operator(spark, docs, empty):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, base[0]) for k in range(15)] + [(40 + k, base[1].replace(" w7 ", f" q{k} ", 1)) for k in range(10)]
    rows += [(60, None), (61, ""), (62, " \n"), (None, base[2]), (3, base[3]), (70, base[4] + " " + base[5]), (71, "w " * 20000)]
    table = docs(rows)
    found = simhash.near_duplicates(table).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps, 4)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=key) == sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, want)), key=key)
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.drop_near_duplicates(empty).count()


def test_large_keys_stream_past(monkeypatch):
    """Members of a key above the block size come out as members, whatever the
    batches, and the other keys' links stay the same."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    rows = sorted((key, rng.getrandbits(40)) for key in (1, 2, 3, 4) for _ in range({2: 90, 4: 40}.get(key, 5)))
    for size in (1, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k:k + size]]), pa.array([r[1] for r in rows[k:k + size]])], names=["key", "fp"])
                   for k in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in simhash.link_sorted(iter(batches), 4, 30) for r in b.to_pylist()]
        assert sorted((k, a) for k, a, _ in out if k is not None) == sorted(r for r in rows if r[0] in (2, 4))
        assert all(k is None and np.bitwise_count(np.int64(a) ^ np.int64(b)) <= 4 for k, a, b in out if k is None)
