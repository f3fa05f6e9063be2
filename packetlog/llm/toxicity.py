"""Toxic passages by maximum-scoring segments (operator 3).

Fitting, on a bounded sample of labelled documents: the different contexts (word
before and word after) of each word are counted in toxic and in clean texts, so
that copies of a text count once. A word's score is the log-odds that a context
is toxic, against the share over all words, smoothed by a Dirichlet prior of
strength ``PRIOR`` whose centre is the same figure for the word's first four
letters (itself smoothed towards the overall share), less ``DRIFT``: what is
merely more usual in toxic texts (a language, a topic) counts as clean. Clean
words cost at most ``COST`` each, so that toxic words a few words apart join into
one passage.

Scoring: Ruzzo and Tompa's linear scan finds every maximal scoring segment of a
text. By Karlin and Altschul's extreme-value law, n words of clean text hold a
segment of score S or more with an expected number E = K n exp(-lambda S);
lambda solves sum(p exp(lambda s)) = 1 over clean words (and one more with the
highest score, so that it is finite), K is the maximum
likelihood estimate from the best segments of the clean sample. A segment with
E <= ``E_VALUE`` is a toxic passage. A text's evidence is the sum of -ln E over
its passages, or of its best segment if it has none; the score is the logistic
function of the evidence, set so that E = ``E_VALUE`` alone gives ``CUT``.

The sample holds at most ``SAMPLE`` labelled documents per class (the smallest
id hashes); word counts live in two tables of 2^20 hash buckets each (of a word's
two buckets the one with fewer contexts counts), stems in a third. So the sample,
the counts on the driver and the broadcast (24 MB) are bounded whatever the
input's size.
Scoring is one pass over whole texts without a shuffle.

Edge cases: null and empty texts score 0. A document with several label rows is
toxic if one says so; null labels say nothing. Without a toxic or a clean
example every score is 0. Rows with null or repeated ids are scored like any
other; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

HELD_OUT = (3, 1)  # modulus and remainder of the fold that teaches nothing
SAMPLE = 10_000
BUCKETS = 1 << 20
PRIOR = 20.0
DRIFT = 1.5
COST = 0.25
E_VALUE = 0.01
CUT = 0.7
STEM = 4
MEMO = 400_000
WORD = r"[^\W\d_]+"


def held_out() -> Column:
    return C.id_remainder(HELD_OUT[0]) == F.lit(HELD_OUT[1])


def buckets(word: str) -> list[int]:
    """Rows of the count table: two for the word, one for its stem if it has one."""
    names = ("a" + word, "b" + word, "c" + word[:STEM])[:3 if len(word) > STEM else 2]
    return [k * BUCKETS + (zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1)) for k, x in enumerate(names)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, stop, score), in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    # Neighbours of one sign act as one item.
    starts = np.flatnonzero(np.concatenate(([True], positive[1:] != positive[:-1])))
    sums = np.add.reduceat(scores, starts)
    stops = np.append(starts[1:], len(scores))
    total, found = 0.0, []  # each: [first, stop, sum before, sum after, previous with a smaller sum before]
    for first, stop, s in zip(starts.tolist(), stops.tolist(), sums.tolist()):
        total += s
        if s <= 0:
            continue
        low, j = total - s, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, low, back = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = back
        found.append([first, stop, low, total, j])
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class WordScores(dict):
    """Score of each word, remembered up to a bound."""

    def __init__(self, counts: np.ndarray, share: float):
        super().__init__()
        self.counts, self.share, self.base = counts, share, math.log(share / (1 - share))
        self.split = re.compile(WORD).findall

    def __missing__(self, word: str) -> float:
        centre, (one, two, *stem) = self.share, self.counts[buckets(word)]
        for t, n in stem:
            centre = (t + PRIOR * centre) / (n + PRIOR)
        t, n = one if one[1] <= two[1] else two
        q = float((t + PRIOR * centre) / (n + PRIOR))
        score = max(-COST, math.log(q / (1 - q)) - self.base - DRIFT)
        if len(self) < MEMO and len(word) < 64:
            self[word] = score
        return score

    def of(self, text: str) -> np.ndarray:
        words = self.split(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def judge(scores: np.ndarray, rate: float, size: float) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Score of a text and its toxic passages (first word, words, score, E)."""
    found = segments(scores)
    if not found:
        return 0.0, []
    base = math.log(size * len(scores))
    # -ln E of each segment; only the best one counts unless it is significant.
    rated = [(a, b, s, rate * s - base) for a, b, s in found]
    passages = [x for x in rated if x[3] >= -math.log(E_VALUE)]
    evidence = sum(x[3] for x in passages) or max(x[3] for x in rated)
    middle = -math.log(E_VALUE) - math.log(CUT / (1 - CUT))
    score = 1 / (1 + math.exp(min(700.0, middle - evidence)))
    return score, [(a, b - a, s, math.exp(-x)) for a, b, s, x in passages]


# ------------------------------------------------------------------ fitting

def _sample(labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled ids per class outside the held-out fold."""
    one = (labels.where(F.col("toxic").isNotNull() & F.col(C.DOC_ID).isNotNull() & ~held_out())
           .groupBy(C.DOC_ID).agg(F.max("toxic").alias("label")))
    order = [F.xxhash64(F.col(C.DOC_ID).cast("string")), F.col(C.DOC_ID)]
    parts = [one.where(F.col("label") == k).orderBy(*order).limit(size) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col(C.DOC_ID).alias("__id"), "label")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> dict | None:
    """Counts of contexts (toxic, all) by bucket, the toxic share, and the
    extreme-value parameters ``rate`` (lambda) and ``size`` (K)."""
    spark = docs.sparkSession
    taught = docs.select(C.DOC_ID, F.col(C.TEXT).cast("string").alias("text")).where("text IS NOT NULL")
    taught = C.cut(taught.join(F.broadcast(_sample(labels, size)), F.col(C.DOC_ID) == F.col("__id")).select("text", "label"))

    def contexts(batches):
        split = re.compile(WORD).findall
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(text.lower())
                seen = set()
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    at = zlib.crc32(f"{before} {after}".encode("utf-8", "replace"))
                    seen.update((b, at) for b in buckets(word))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in seen], pa.int32()), pa.array([x[1] for x in seen], pa.int64()), pa.array([label] * len(seen), pa.int32())],
                    names=["b", "context", "label"])

    sums = (taught.select("text", F.col("label").cast("int").alias("label")).mapInArrow(contexts, "b int, context long, label int").distinct()
            .groupBy("b").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")))
    rows = sums.select("b", F.col("t").cast("int").alias("t"), F.col("n").cast("int").alias("n")).toArrow()  # at most 3 * BUCKETS rows
    counts = np.zeros((3 * BUCKETS, 2), np.float32)
    for part in rows.to_batches():
        counts[part.column(0).to_numpy()] = np.stack([part.column(1).to_numpy(), part.column(2).to_numpy()], axis=1)
    del rows
    toxic, both = counts[:BUCKETS].sum(axis=0, dtype=np.float64).tolist()
    if not 0 < toxic < both:
        return None
    model = {"counts": counts, "share": toxic / both}
    shared = spark.sparkContext.broadcast(model)

    def clean(batches):
        """Of each clean text: words, score of the best segment, and (as the
        batch's sum) how often each score, to 1/100, occurs."""
        scorer = WordScores(shared.value["counts"], shared.value["share"])
        for batch in batches:
            sizes, best, seen = [], [], {}
            for text in batch.column(0).to_pylist():
                s = scorer.of(text)
                sizes.append(len(s))
                best.append(max((x[2] for x in segments(s)), default=0.0))
                for v, n in zip(*np.unique(np.round(s, 2), return_counts=True)):
                    seen[v] = seen.get(v, 0) + int(n)
            n = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(sizes) + list(seen), pa.float64()), pa.array(sizes + list(seen.values()), pa.int64()), pa.array(best + [0.0] * n, pa.float64())],
                names=["value", "n", "best"])

    rows = taught.where("label = 0").mapInArrow(clean, "value double, n long, best double").groupBy("value", "best").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).toPandas()
    spread, texts = rows[rows["value"].notna()], rows[rows["value"].isna() & (rows["n"] > 0)]
    # One more clean word with the highest score keeps lambda finite where clean
    # texts hold no toxic word at all.
    seen = counts[:BUCKETS][counts[:BUCKETS, 1] > 0].astype(np.float64)
    q = (seen[:, 0] + PRIOR * model["share"]) / (seen[:, 1] + PRIOR)
    top = (np.log(q / (1 - q)) - math.log(model["share"] / (1 - model["share"])) - DRIFT).max()
    value, often = np.append(spread["value"].to_numpy(), top), np.append(spread["n"].to_numpy(), 1)
    share = often / often.sum()
    if not (value > 0).any() or not len(texts):
        model |= {"rate": 1.0, "size": 1.0}
        return model
    low, high = 1e-3, 1e-3
    while (share * np.exp(high * value)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * value)).sum() < 1 else (low, middle)
    # Rows are summed over texts with the same best segment: n is their words.
    size_k = texts["texts"].sum() / (texts["n"] * np.exp(-low * texts["best"])).sum()
    model |= {"rate": float(low), "size": float(size_k)}
    return model


# ------------------------------------------------------------------ scoring

PASSAGES = "array<struct<first_word:int,n_words:int,score:double,e_value:double>>"


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id``, ``score`` and ``passages``: the significant toxic passages of
    each whole text, as word positions with segment score and E value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m = shared.value
        scorer = m and (m.get("scorer") or m.setdefault("scorer", WordScores(m["counts"], m["share"])))
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            out = [judge(scorer.of(t), m["rate"], m["size"]) if m else (0.0, []) for t in batch.column(1).to_pylist()]
            passages = [[dict(zip(("first_word", "n_words", "score", "e_value"), p)) for p in x[1]] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array(passages, kind)],
                                             names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(rate, f"doc_id {kind}, score double, passages {PASSAGES}")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = score_toxicity(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
                        F.size("passages").alias("n_passages"))
