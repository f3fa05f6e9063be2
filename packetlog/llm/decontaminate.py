"""Benchmark decontamination by size-partitioned MinHash containment search
(operator 8).

A document contains a benchmark item if it holds at least ``CONTAINMENT`` of the
item's different five-word shingles (lower-cased runs of letters and digits).

Candidates: MinHash sees Jaccard similarity, which is tiny for a short item in a
long document. So both sides are partitioned by size. Items fall into classes of
up to u = 1, 2, 4, 8 ... shingles; for each class that occurs, a document is cut
into windows of 1.5 u shingles, u/2 apart, so every run of u shingles lies in one
window. An item of the class then has a similarity of at least 0.25 with the
window that holds it, and the chance that none of ``FUNCTIONS`` minima agrees is
below 0.75^48 = 1e-6. A minimum is a key by itself: an agreement means a common
shingle hash, so false candidates are rare.

The windows' keys are tested in the task against a Bloom filter of the items'
keys (fixed size, broadcast); only documents that pass hand on their keys, and
the shingles that pass a second filter of the items' shingles. The join on keys
names the candidate pairs; the join on the shingles themselves counts exactly.
No text is shuffled to find the pairs.

Edge cases: null and empty texts, and texts or items with fewer than five words,
have no shingles and match nothing. Repeated items are separate rows with equal
results, unless equal in id and text. Rows equal in id and text are one document.
An empty benchmark matches nothing. Further columns are ignored or, in the
pipeline stage, kept.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

SHINGLE = 5
CONTAINMENT = 0.8
FUNCTIONS = 48
#: Bits of each Bloom filter (8 MB); more keys than it suits only let more pass.
BLOOM_BITS = 26
PROBES = 4
#: Class of items with a repeated shingle, whose keys are shingles themselves.
REPEATING = 64
WORD = r"[^\W_]+"
MEMO = 400_000
#: Shingles worked on at once.
BATCH = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingler(dict):
    """Words and shingle hashes of texts; word hashes are remembered."""

    def __init__(self, size: int = SHINGLE):
        super().__init__()
        self.size, self.find = size, re.compile(WORD).findall
        self.weights = odd_numbers(size)

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < MEMO and len(word) < 64:
            self[word] = h
        return h

    def words(self, text: str) -> list[str]:
        return self.find(text.lower())

    def hashes(self, words: list[str]) -> np.ndarray:
        n = len(words) - self.size + 1
        if n < 1:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return mix(sum(w[j:j + n] * self.weights[j] for j in range(self.size)))


def size_class(shingles: int) -> int:
    """c for the smallest 2^c that is at least the number of shingles."""
    return max(0, shingles - 1).bit_length()


def minima_keys(minima: np.ndarray, c: int, function: int) -> np.ndarray:
    return mix(minima ^ np.uint64((c << 8 | function) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def shingle_keys(hashes: np.ndarray) -> np.ndarray:
    return minima_keys(hashes, REPEATING, 0)


def bloom_bits(keys: np.ndarray) -> list[np.ndarray]:
    """Positions of the keys' bits, one array per probe."""
    return [(keys * p >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for p in odd_numbers(PROBES)]


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be present."""
        found = np.arange(len(keys))
        for p in odd_numbers(PROBES):
            at = (keys[found] * p >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)
            found = found[self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
        return found


def _bloom_of(keys: DataFrame) -> np.ndarray:
    """The filter of a column ``key`` of longs: a bit array of fixed size."""
    def bits(batches):
        for batch in batches:
            at = np.concatenate(bloom_bits(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["i", "v"])

    rows = keys.select("key").mapInArrow(bits, "i int, v long").groupBy("i").agg(F.bit_or("v").alias("v")).toPandas()
    words = np.zeros(1 << BLOOM_BITS - 6, np.int64)
    words[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return words.view(np.uint8)


def _items(benchmark: DataFrame, functions: int, containment: float) -> DataFrame:
    """``item_id``, ``item_key``, ``size_class``, number ``n`` and texts of the
    different ``shingles``, and MinHash or prefix ``keys`` of each item that has any."""
    multipliers = odd_numbers(functions)

    def describe(batches):
        shingler = Shingler()
        for batch in batches:
            out = []
            for item_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = shingler.words(text)
                hashes = shingler.hashes(words)
                if len(hashes):
                    shingles = sorted({" ".join(words[k:k + SHINGLE]) for k in range(len(hashes))})
                    different = np.unique(hashes)
                    if len(different) < len(hashes):
                        c = REPEATING
                        enough = max(1, math.ceil(containment * len(different) - 1e-9))
                        keys = shingle_keys(different[:len(different) - enough + 1])
                    else:
                        c = size_class(len(hashes))
                        keys = np.concatenate([minima_keys((hashes * m).min(keepdims=True), c, i) for i, m in enumerate(multipliers)])
                    out.append((item_id, key, c, shingles, keys.view(np.int64).tolist(), different.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(
                    (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["item_id", "item_key", "size_class", "shingles", "keys", "hashes"])

    rows = benchmark.select(F.col("item_id"), C.text_hash().alias("item_key"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.distinct().mapInArrow(describe, f"item_id {kind}, item_key long, size_class int, shingles array<string>, keys array<long>, hashes array<long>")


def window_hits(hashes: np.ndarray, lengths: np.ndarray, classes: list[int], multipliers: np.ndarray, bloom: Bloom):
    """(document, key) of window minima, and of shingles where an item repeats
    some, that may be an item's. ``hashes``: the
    shingle hashes of several documents, ``lengths`` of them each (none empty)."""
    sized = [c for c in classes if c != REPEATING]
    half = [max(1, (1 << c) // 2) for c in sized]
    layout = []  # per class: first shingle of each block, and the block's document
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for h in half:
        blocks = -(-lengths // h)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        layout.append((starts[doc] + inner * h, doc))
    docs, keys = [], []
    if REPEATING in classes:
        found = shingle_keys(hashes)
        hit = bloom.has(found)
        docs.append(np.repeat(np.arange(len(lengths)), lengths)[hit])
        keys.append(found[hit])
    for i, m in enumerate(multipliers):
        values = hashes * m
        for c, (at, doc) in zip(sized, layout):
            blocks = np.minimum.reduceat(values, at)
            windows = blocks.copy()
            for d in (1, 2):  # a window is three blocks of one document
                same = np.flatnonzero(doc[d:] == doc[:-d])
                windows[same] = np.minimum(windows[same], blocks[same + d])
            found = minima_keys(windows, c, i)
            hit = bloom.has(found)
            docs.append(doc[hit])
            keys.append(found[hit])
    return np.concatenate(docs), np.concatenate(keys)


def _candidates(docs: DataFrame, items: DataFrame, functions: int) -> DataFrame:
    """Documents with a hit: ``doc_id``, ``text_key``, their ``keys`` and the
    ``shingles`` that may be an item's."""
    classes = sorted(r[0] for r in items.select("size_class").distinct().collect())  # at most 65
    filters = (_bloom_of(items.select(F.explode("keys").alias("key"))), _bloom_of(items.select(F.explode("hashes").alias("key"))))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    multipliers = odd_numbers(functions)

    def search(batches):
        key_bloom, shingle_bloom = (Bloom(b) for b in shared.value)
        shingler = Shingler()

        def flush(held):
            at, keys = window_hits(np.concatenate([x[3] for x in held]), np.array([len(x[3]) for x in held]), classes, multipliers, key_bloom)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            out = []
            for d in np.unique(at):
                doc_id, text_key, words, hashes = held[d]
                own = np.unique(keys[np.searchsorted(at, d):np.searchsorted(at, d, "right")])
                shingles = {" ".join(words[k:k + SHINGLE]) for k in shingle_bloom.has(hashes).tolist()}
                out.append((doc_id, text_key, own.view(np.int64).tolist(), sorted(shingles)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((id_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))],
                                              names=["doc_id", "text_key", "keys", "shingles"])

        id_type = None
        held, size = [], 0
        if not classes:
            return  # no item has a shingle
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = shingler.words(text)
                hashes = shingler.hashes(words)
                if len(hashes):
                    held.append((doc_id, key, words, hashes))
                    size += len(hashes)
                if size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), C.text_hash().alias("text_key"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, text_key long, keys array<long>, shingles array<string>")


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, functions: int = FUNCTIONS) -> DataFrame:
    """``doc_id``, ``text_key``, ``item_id``, ``item_key``, ``n_shared``,
    ``n_shingles``, ``containment`` for each document and item it contains."""
    items = C.cut(_items(benchmark, functions, containment))
    found = C.cut(_candidates(docs, items, functions))
    doc, item = ["doc_id", "text_key"], ["item_id", "item_key"]
    # Ids may be null: pairs are joined on hashes of the identifying columns.
    d = found.dropDuplicates(doc).withColumn("d", F.xxhash64(*doc))
    b = items.withColumn("b", F.xxhash64(*item)).withColumn("n_shingles", F.size("shingles"))
    pairs = d.select("d", F.explode("keys").alias("key")).join(b.select("b", F.explode("keys").alias("key")), "key").select("d", "b").distinct()
    shared = (d.select(*doc, "d", F.explode("shingles").alias("shingle")).join(b.select(*item, "b", "n_shingles", F.explode("shingles").alias("shingle")), "shingle")
              .groupBy(*doc, *item, "d", "b", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared")))
    enough = F.col("n_shared") >= F.col("n_shingles") * F.lit(containment) - F.lit(1e-9)
    return shared.where(enough).join(pairs, ["d", "b"]).select(*doc, *item, "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    bad = contained_items(docs, benchmark, containment).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = docs.withColumn("__text_key", C.text_hash())
    same = F.col(C.DOC_ID).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    return rows.join(bad, same, "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5) x),
ib AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5) x),
n AS (SELECT item_id, count(*) AS n_shingles FROM ib GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN ib USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_shingles AS INTEGER) AS n_shingles, n_shared / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""
