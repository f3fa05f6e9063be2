"""SimHash near-duplicates with Golay-code fuzzy hashing (operator 10).

Fingerprint: the text with A-Z lower-cased, words between ASCII white space,
word shingles (repeats included; a text with fewer words is one shingle; no
words: fingerprint zero), XXH64 with seed 42 of each; a bit is set if more than
half of the hashes have it.

Links: two fingerprints that differ in at most ``max_bits`` (up to 4) bits. The
64 bits are cut into segments A, B (23 bits) and C (18). The binary Golay code
is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A
segment's *Golay keys* are the indices of the codewords within 4 bits: one
where the nearest codeword is at most 2 bits away, else six. Two segments that
differ in at most 2 bits share a key: take a word z within one bit of both; its
codeword is within 3 bits of z, so within 4 of both. With at most 4 wrong bits:

* a segment without errors leaves one of the others with at most 2, so the pair
  (this segment as it is, Golay key of the other) is shared, or
* each segment has an error, so A and B have at most 2 each and share the pair
  of their Golay keys.

So the keys miss no link; every candidate is verified by its bit distance.
Equal fingerprints are folded into one node first. Inside a group of equal keys
a breadth-first search emits a spanning forest of the links, never all pairs; a
group above ``block`` members is not held by its task but passed on as it streams
by, and dealt into pairs of blocks over many tasks.

Edge cases: null text is the empty text; all texts without words share
fingerprint zero and are linked like any other. A null ``doc_id`` takes part;
the smallest non-null id names the component (null if all are null). Repeated
rows fall in one component. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C
from packetlog.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Segments of the fingerprint: first bit, number of bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (23, 12).
GENERATOR = 0b110001110101
#: Groups up to PAIRS members are compared at once; groups above BLOCK are split.
PAIRS, BLOCK = 16, 8192


# ------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], stops[:n - 1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (stops[shingle - 1:] - 1).tolist())]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[k:k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text) and ``fp``: the 64-bit
    fingerprint as a signed long."""
    def score(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), C.text_hash().alias("text_key"), C.utf8().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, text_key long, fp long")


# --------------------------------------------------------------- Golay keys

class Golay:
    """Codeword indices within 4 bits of 23-bit words, by syndrome."""

    def __init__(self):
        rest = []  # remainder of each single bit modulo the generator
        for bit in range(23):
            r = 1 << bit
            for k in range(22, 10, -1):
                if r >> k & 1:
                    r ^= GENERATOR << (k - 11)
            rest.append(r)
        self.bytes = np.zeros((3, 256), np.int32)
        for k, v in itertools.product(range(3), range(256)):
            for b in range(8):
                if v >> b & 1 and 8 * k + b < 23:
                    self.bytes[k, v] ^= rest[8 * k + b]
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in itertools.combinations(range(23), weight):
                s = 0
                for b in bits:
                    s ^= rest[b]
                if weight < 4 or len(patterns[s]) and patterns[s][0].bit_count() == 3:
                    patterns[s].append(sum(1 << b for b in bits))
        self.patterns = np.full((2048, 6), -1, np.int32)
        for s, found in enumerate(patterns):
            self.patterns[s, :len(found)] = found

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each 23-bit word six columns of 12-bit indices, -1 where fewer."""
        w = words.astype(np.int32)
        syndrome = self.bytes[0, w & 255] ^ self.bytes[1, w >> 8 & 255] ^ self.bytes[2, w >> 16]
        errors = self.patterns[syndrome]
        return np.where(errors < 0, -1, (w[:, None] ^ errors) >> 11)


def search_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (row, key) arrays. A key holds its table's
    number, the exact segment and the Golay index, or two Golay indices."""
    u = fps.view(np.uint64)
    plain = [(u >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    coded = [golay.keys(p).astype(np.int64) for p in plain]
    rows, keys = [], []
    for t, (x, y) in enumerate(itertools.permutations(range(3), 2)):
        r, c = np.nonzero(coded[y] >= 0)
        rows.append(r)
        keys.append((t << 40) | plain[x][r] << 12 | coded[y][r, c])
    for i, j in itertools.product(range(6), range(6)):
        r = np.nonzero((coded[0][:, i] >= 0) & (coded[1][:, j] >= 0))[0]
        rows.append(r)
        keys.append((6 << 40) | coded[0][r, i] << 12 | coded[1][r, j])
    return np.concatenate(rows), np.concatenate(keys)


# -------------------------------------------------------------------- links

def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside one group, by breadth-first search:
    each member is compared once with those not reached yet."""
    left, ends = fps.view(np.uint64).copy(), ([], [])
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                new = left[near]
                ends[0].append(np.full(len(new), at))
                ends[1].append(new)
                frontier.extend(new)
                left = left[~near]
    if not ends[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(e).view(np.int64) for e in ends)


def link_sorted(batches, max_bits: int, block: int):
    """From (key, fp) in key order: links (a, b) with key null, and the members
    (key, a, null) of groups that are too large for one task."""
    def emit(a, b, keys=None):
        if keys is None and len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            a, b = pairs
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(a), pa.int64()) if keys is None else pa.array(keys), pa.array(a),
             pa.nulls(len(a), pa.int64()) if keys is not None else pa.array(b)], names=["key", "a", "b"])

    def groups(keys, fps):
        edges = ([], [])
        for d in range(1, PAIRS):  # small groups: all offsets at once
            if len(keys) <= d:
                break
            same = keys[d:] == keys[:-d]
            if not same.any():
                break
            at = np.nonzero(same)[0]
            x, y = fps[at], fps[at + d]
            ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits) & (x != y)
            edges[0].append(x[ok])
            edges[1].append(y[ok])
        if len(keys) > PAIRS:
            starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
            for k in np.nonzero(np.diff(starts) > PAIRS)[0]:
                run = np.unique(fps[starts[k]:starts[k + 1]])
                if len(run) > block:
                    yield emit(run, None, np.full(len(run), keys[starts[k]]))
                    continue
                a, b = forest(run, max_bits)
                edges[0].append(a)
                edges[1].append(b)
        if edges[0]:
            yield emit(np.concatenate(edges[0]), np.concatenate(edges[1]))

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows may go on
    large = None  # the last key, once it is too large: its rows pass by unheld
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if large is not None and len(keys):
            n = int(np.searchsorted(keys, large, side="right"))
            if n:
                yield emit(fps[:n], None, keys[:n])
            keys, fps = keys[n:], fps[n:]
        if not len(keys):
            continue
        large = None
        if keys[0] == keys[-1] and held and held[0][0][-1] == keys[0]:
            held.append((keys, fps))
        else:
            keys, fps = (np.concatenate(x) for x in zip(*held, (keys, fps)))
            stop = int(np.searchsorted(keys, keys[-1]))
            yield from groups(keys[:stop], fps[:stop])
            held = [(keys[stop:], fps[stop:])]
        if sum(len(k) for k, _ in held) > block:
            large = int(held[0][0][0])
            for k, f in held:
                yield emit(f, None, k)
            held = []
    if held:
        yield from groups(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a < b`` that connect what fingerprints within ``max_bits`` bits
    connect (a spanning part of them). ``fps``: one distinct column ``fp``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the Golay keys are proven for at most 4 differing bits")

    def key_rows(batches):
        golay = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), 4096):
                part = fps[k:k + 4096]
                rows, keys = search_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def link(batches):
        yield from link_sorted(batches, max_bits, block)

    # Each fingerprint becomes some dozens of rows, so they are spread first.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (fps.select("fp").repartition(parts, "fp").mapInArrow(key_rows, "key long, fp long")
             .repartition("key").sortWithinPartitions("key").mapInArrow(link, "key long, a long, b long"))
    found = C.cut(found)
    C.release(fps.sparkSession)
    links = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if not large.isEmpty():
        links = links.unionByName(_block_links(large, max_bits, block))
    return links.distinct()


def _block_links(members: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Links of large groups: members are dealt into blocks by a hash, and each
    pair of blocks is one small group."""
    blocks = F.ceil(F.col("n") * 2 / F.lit(block)).cast("int")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", blocks.alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.select("fp", "key", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    pairs = pairs.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")

    def link(batches):
        yield from link_sorted(batches, max_bits, 1 << 62)

    return (pairs.repartition("key").sortWithinPartitions("key")
            .mapInArrow(link, "key long, a long, b long").select("a", "b"))


# ----------------------------------------------------------------- operator

def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``fp`` (signed
    long) and ``component_id``, the smallest ``doc_id`` that links reach."""
    prints = C.cut(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = connected_components(fingerprint_links(nodes, max_bits))
    # Only linked fingerprints have a label; the others are their own component.
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest ``doc_id``
    (of several texts under it the one with the smallest hash). Components
    whose ids are all null keep one document too."""
    found = near_duplicates(docs, shingle, max_bits)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # Group by fingerprint and then by component: small groups, partial sums.
    keep = (found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own"))
            .agg(F.min(rank).alias("best")).select("best.doc_id", "best.text_key"))
    kept = keep.select(F.col("doc_id").alias("__keep_id"), F.col("text_key").alias("__keep_key")).distinct()
    rows = docs.withColumn("__text_key", C.text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__text_key") == F.col("__keep_key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
