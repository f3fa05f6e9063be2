"""Quality classifier over random-indexing word vectors (operator 12).

Words are runs of word characters and runs of other signs, hashed into ``BUCKETS``
buckets. Each bucket has an index vector: ``SIGNS`` of ``DIM`` places hold 1 or -1,
fixed by a seeded generator. A bucket's word vector is the sum of the index vectors
of the words left and right of its occurrences over the whole corpus, brought to
unit length: words used alike get like vectors. The sums are whole numbers added
up in tasks, then by bucket in a shuffle, so they don't depend on how the rows lie.

A document's features pool the vectors of all its words: mean and standard deviation
of each place, the number of words (logarithm) and the share of different ones. A
network of two layers (``HIDDEN`` hidden units, numpy) is trained on the features of
labelled documents outside the held-out fold, on the driver. Its logits are divided
by a temperature fitted on a fifth of them that the training does not see, so scores
are probabilities. The network and the vectors (``BUCKETS`` by ``DIM``, a fixed size)
are broadcast and every whole text is scored.

Fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each class, the
first by a hash of their ids; a class that is cut weighs as much as all of it. The
word vectors cover all documents.

Edge cases: null, empty and wordless texts have all features 0 and are scored like
any other. Of documents that share an id the one with the least features is learnt;
of labels that share an id the largest. Null ids teach nothing but are scored. If
the labels hold one class only, or none, every score is its share (0.5 for none). An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

BUCKETS, DIM, SIGNS = 1 << 14, 32, 4
SEED = 12
SAMPLE = 8000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 32, 60, 64, 0.003, 1e-4
HELD_OUT = (5, 0)
CUT = 0.3
WORD = re.compile(r"\w+|[^\w\s]+")
#: Remembered words, and words handled at once.
MEMO, CHUNK = 300_000, 1 << 17
FEATURES = 2 * DIM + 2


def held_out() -> Column:
    return C.id_remainder(HELD_OUT[0]) == F.lit(HELD_OUT[1])


# ---------------------------------------------------------------- word vectors

class Buckets(dict):
    """Bucket of each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        if len(self) < MEMO and len(word) < 64:
            self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, WORD.findall(text)))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :SIGNS]
    return places, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SIGNS))


def context_sums(texts: list[str], memo: Buckets, places: np.ndarray, signs: np.ndarray, sums: np.ndarray) -> None:
    """Adds the neighbours' index vectors of every word of ``texts`` to ``sums``."""
    for text in texts:
        words = np.array(memo.of(text), np.int64)
        for k in range(0, len(words) - 1, CHUNK):  # pairs of neighbours
            left, right = words[k:k + CHUNK], words[k + 1:k + CHUNK + 1]
            left = left[:len(right)]
            for word, other in ((left, right), (right, left)):
                np.add.at(sums, ((word * DIM)[:, None] + places[other]).ravel(), signs[other].ravel())


def _by_text(texts: list[str]):
    """Groups of texts with about ``CHUNK`` characters each."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS by DIM: unit vectors, zero for buckets without neighbours."""
    def count(batches):
        places, signs = index_vectors()
        memo, sums = Buckets(), np.zeros(BUCKETS * DIM)
        for batch in batches:
            context_sums(batch.column(0).to_pylist(), memo, places, signs, sums)
        table = sums.reshape(BUCKETS, DIM).astype(np.int64)
        used = np.flatnonzero(np.abs(table).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, k]) for k in range(DIM))],
                                         names=["bucket", *(f"s{k}" for k in range(DIM))])

    texts = docs.select(F.col(C.TEXT).cast("string").alias("text")).where("text IS NOT NULL")
    sums = texts.mapInArrow(count, "bucket int, " + ", ".join(f"s{k} long" for k in range(DIM)))
    sums = sums.groupBy("bucket").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(DIM)]).toArrow()  # at most BUCKETS rows
    vectors = np.zeros((BUCKETS, DIM))
    vectors[sums["bucket"].to_numpy()] = np.stack([sums[f"s{k}"].to_numpy() for k in range(DIM)], axis=1)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], memo: Buckets, vectors: np.ndarray) -> np.ndarray:
    """Features of each text, whatever its length, ``CHUNK`` words at a time."""
    words = [memo.of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    sums = np.zeros((len(texts), 2 * DIM))
    ids = np.fromiter((b for w in words for b in w), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    for k in range(0, len(ids), CHUNK):
        v, own = vectors[ids[k:k + CHUNK]], owner[k:k + CHUNK]
        starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        both = np.hstack([v, v * v]).astype(np.float64)
        sums[own[starts]] += np.add.reduceat(both, starts, axis=0)
    some = np.maximum(sizes, 1)[:, None]
    mean = sums[:, :DIM] / some
    spread = np.sqrt(np.maximum(sums[:, DIM:] / some - mean ** 2, 0))
    kinds = np.array([len(set(w)) for w in words]) / some[:, 0]
    return np.hstack([mean, spread, np.log1p(sizes)[:, None] / 10, kinds[:, None]]).astype(np.float32)


# -------------------------------------------------------------------- network

def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """A two-layer network and its temperature; rows are split by their order."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    tuning, rest = order[:len(x) // 5], order[len(x) // 5:]
    centre, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    z = ((x - centre) / scale).astype(np.float64)
    net = {"w1": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    for _ in range(ROUNDS):
        rng.shuffle(rest)
        for k in range(0, len(rest), BATCH):
            at, step = rest[k:k + BATCH], step + 1
            hidden = np.maximum(z[at] @ net["w1"] + net["b1"], 0)
            slope = (_share(hidden @ net["w2"] + net["b2"]) - y[at]) * weight[at] / weight[at].sum()
            back = slope[:, None] * net["w2"] * (hidden > 0)
            grads = {"w1": z[at].T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ slope, "b2": slope.sum(keepdims=True)}
            for name, g in grads.items():
                g = g + DECAY * net[name]
                first, second = moments[name]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                net[name] -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    net |= {"centre": centre, "scale": scale, "temperature": 1.0}
    logits = _logits(net, x[tuning])
    best = None
    for t in np.geomspace(0.2, 20, 200):  # the temperature of least loss
        p = np.clip(_share(logits / t), 1e-9, 1 - 1e-9)
        loss = -(weight[tuning] * np.where(y[tuning] == 1, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best:
            best, net["temperature"] = loss, float(t)
    return net


def _share(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _logits(net: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum((x - net["centre"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return (hidden @ net["w2"] + net["b2"]) / net["temperature"]


# ----------------------------------------------------------------------- jobs

def _mapped(rows: DataFrame, vectors: np.ndarray, more: dict, work, schema: str, types: list) -> DataFrame:
    """``work`` on the features of each row's last column, with the others kept."""
    shared = rows.sparkSession.sparkContext.broadcast((vectors, more))

    def run(batches):
        table, extra = shared.value
        memo = Buckets()
        for batch in batches:
            last, n = batch.num_columns - 1, 0
            for texts in _by_text(batch.column(last).to_pylist()):
                found = work(pooled(texts, memo, table), extra)
                part = batch.slice(n, len(texts))
                n += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *(pa.array(f, t) for f, t in zip(found, types))],
                                                 names=[f.split(" ")[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Word vectors and network (or a constant ``share``)."""
    vectors = word_vectors(docs)
    known = (labels.where(F.col("quality").isNotNull() & F.col(C.DOC_ID).isNotNull() & ~held_out())
             .groupBy(C.DOC_ID).agg(F.max("quality").cast("int").alias("quality")))
    known = C.cut(known.select(F.col(C.DOC_ID).alias("__id"), "quality"))
    sizes = {r["quality"]: r["count"] for r in known.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return {"vectors": vectors, "net": None, "share": float(next(iter(sizes), 0.5))}
    order = [F.xxhash64(F.col("__id").cast("string")), F.col("__id")]
    chosen = [known.where(F.col("quality") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows
    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "quality", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = _mapped(rows, vectors, {}, lambda x, _: [x.tolist()], f"doc_id {kind}, quality int, x array<float>", [pa.list_(pa.float32())])
    found = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").toArrow()
    x, y = np.array(found["x"].to_pylist(), np.float32).reshape(-1, FEATURES), found["quality"].to_numpy()
    if len(np.unique(y)) < 2:
        return {"vectors": vectors, "net": None, "share": float(y[0]) if len(y) else 0.5}
    taken = {k: min(sample, n) for k, n in sizes.items()}
    return {"vectors": vectors, "net": train(x, y, np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0])), "share": None}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score``: the probability that a text's label is 1."""
    def rate(x, more):
        net = more["net"]
        # Rounded: the last bits of a product depend on the rows beside a row.
        return [np.round(_share(_logits(net, x)), 9) if net else np.full(len(x), more["share"])]

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, model["vectors"], {"net": model["net"], "share": model["share"]}, rate, f"doc_id {kind}, score double", [pa.float64()])


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = score_quality(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
