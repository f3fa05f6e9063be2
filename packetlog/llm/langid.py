"""Language identification by rank-order profiles (operator 5).

Cavnar and Trenkle's method: the most frequent character n-grams (one to three
characters of the lower-cased letters, with a blank at word edges) of each
language, in order of frequency, form its profile. A document's own most
frequent n-grams are compared with each profile by the out-of-place distance:
the sum of rank differences, with ``depth`` for an n-gram that the profile
lacks. The smallest distance wins; ties go to the alphabetically first name.

Fitting for ``op5`` uses a bounded sample: per language at most ``SAMPLE`` different documents,
those with the smallest hashes of id and text, read by whole text. Where to cut the
hashes follows from counts by their leading bits, in a few rounds, so no task sees a
language's rows together. ``MAX_LANGUAGES`` bounds the profiles (about 6 kB each),
which are the only broadcast. Prediction is one pass over whole texts without a
shuffle.

As a filter (``keep_known``) it learns from all labelled documents outside the
held-out fold, without a sample: profiles are counted over all their texts, and so
is the least score of each language. It rejects documents without a letter, and
documents whose score lies clearly (by ``MARGIN``) below all that the predicted
language's own documents reached at like length: those are in no learned language.

The score is the share of the largest possible distance that the document
saves: 1 for a document ordered like the profile, 0 for one without any n-gram
in common.

Edge cases: a text that is null or has no letter is ``und`` with score 0. Rows
without ``lang`` or without letters teach nothing; if nothing can be learned,
every document is ``und``. Null ids are hashed as the empty text; repeated rows
are predicted alike; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlog.llm import common as C

UNKNOWN = "und"
DEPTH = 300
SAMPLE = 2000
MAX_LANGUAGES = 1000
HELD_OUT = (4, 2)  # modulus and remainder of the fold that teaches nothing
BITS = 21  # of a code point; three fit one 64-bit code
#: Bits of a hash that one round of the cut counts, and the share of the sample at
#: which it stops.
ROUND, ENOUGH = 8, 0.9
#: Share of the least score of a language's documents that a document must reach.
MARGIN = 0.8
#: Codes that a task counts at once, and rows whose texts it holds at once.
CHUNK, ROWS = 1 << 20, 512


def letter_table() -> np.ndarray:
    """Which code points are letters, as packed bits (140 kB)."""
    return np.packbits(np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool))


class Grams:
    """Most frequent n-grams of a text as codes, by frequency and then code."""

    def __init__(self, letters: np.ndarray):
        self.letters = np.unpackbits(letters).astype(bool)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = self.letters[points]
        if not letter.any():
            return np.empty(0, np.int64)
        points = np.where(letter, points, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after each word
        points = np.concatenate(([32], points[keep], [32]))
        two = points[:-1] << BITS | points[1:]
        three = two[:-1] << BITS | points[2:]
        return np.concatenate((points, two[two != (32 << BITS | 32)], three))

    def top(self, text: str, depth: int) -> np.ndarray:
        codes = self.codes(text)
        if not len(codes):
            return codes
        codes.sort()
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        counts = np.diff(np.append(starts, len(codes)))
        # Stable by code: equal counts stay in code order.
        return codes[starts[np.argsort(-counts, kind="stable")[:depth]]]


class Profiles:
    """Out-of-place distances to all languages at once: every profile n-gram, in
    code order, with its rank in each language (``depth`` where it lacks it)."""

    def __init__(self, profiles: dict[str, list[int]], depth: int):
        self.names, self.depth = sorted(profiles), depth
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def best(self, grams: np.ndarray) -> tuple[str, float]:
        at = np.searchsorted(self.codes, grams)
        found = at < len(self.codes)
        found[found] = self.codes[at[found]] == grams[found]
        ranks = self.ranks[np.where(found, at, len(self.codes))]
        away = np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        k = int(away.argmin())
        return self.names[k], float(1 - away[k] / (self.depth * len(grams)))


def held_out() -> Column:
    return C.id_remainder(HELD_OUT[0]) == F.lit(HELD_OUT[1])


def _languages(rows: DataFrame) -> list[str]:
    names = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return names


def _cuts(rows: DataFrame, sample: int) -> dict[str, int]:
    """For each language the bound up to which lie at most ``sample`` different
    hashes ``h`` (and nearly as many, if there are): counts by leading bits say in
    which slice of the hashes the bound lies, the next round cuts that slice."""
    known = rows.select("lang", F.shiftrightunsigned("h", 1).alias("u")).distinct()
    names = _languages(known)
    bounds, taken, slices, width = {n: -1 for n in names}, {n: 0 for n in names}, {n: 0 for n in names}, 63
    while slices and width:
        above, width = width, max(0, width - ROUND)
        at = F.create_map(*[x for n, k in slices.items() for x in (F.lit(n), F.lit(k).cast("long"))])
        inside = known if above == 63 else known.where(F.shiftright("u", above) == F.try_element_at(at, F.col("lang")))
        counts: dict[str, Counter] = {n: Counter() for n in slices}
        for r in inside.groupBy("lang", F.shiftright("u", width).alias("k")).count().collect():  # at most 2^ROUND a language
            if r["lang"] in counts:
                counts[r["lang"]][r["k"]] = r["count"]
        left = {}
        for name, own in counts.items():
            first, steps = slices[name] << (above - width), 1 << (above - width)
            for k in range(first, first + steps):
                if taken[name] + own[k] > sample:
                    if taken[name] < ENOUGH * sample:
                        left[name] = k
                    break
                taken[name] += own[k]
                bounds[name] = ((k + 1) << width) - 1
        slices = left
    return bounds


def _labelled(docs: DataFrame) -> DataFrame:
    """All rows that may teach: ``lang``, ``text`` and the hash ``h`` of id and text."""
    hashed = F.xxhash64(F.col(C.DOC_ID).cast("string"), F.col(C.TEXT).cast("string"))
    return docs.where(F.col("lang").isNotNull() & F.col(C.TEXT).isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), hashed.alias("h"), F.col(C.TEXT).cast("string").alias("text"))


def _teachers(docs: DataFrame, sample: int) -> DataFrame | None:
    """The sample: ``lang`` and ``text``, or None if there is no language."""
    rows = _labelled(docs)
    bounds = _cuts(rows, sample)
    if not bounds:
        return None
    last = F.create_map(*[x for n, b in bounds.items() for x in (F.lit(n), F.lit(b).cast("long"))])
    chosen = rows.where(F.shiftrightunsigned("h", 1) <= F.try_element_at(last, F.col("lang")))
    return chosen.dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, depth: int = DEPTH, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles: language to the codes of its ``depth`` most frequent n-grams."""
    taught = _teachers(docs, sample)
    return _profiles(taught, depth) if taught is not None else {}


def _slices(batches):
    """The rows (lang, text) of all batches, few of them as Python strings at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _profiles(taught: DataFrame, depth: int) -> dict[str, list[int]]:
    letters = letter_table()

    def counted(held):
        for lang, parts in held.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())],
                                             names=["lang", "code", "n"])

    def count(batches):
        grams = Grams(letters)
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for lang, text in _slices(batches):
            held.setdefault(lang, []).append(codes := grams.codes(text))
            size += len(codes) + 1
            if size >= CHUNK:
                yield from counted(held)
                held, size = {}, 0
        yield from counted(held)

    sums = taught.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: r["rank"]):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``text_key``, ``lang_pred``, ``score`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((letter_table(), profiles))

    def classify(batches):
        letters, known = shared.value
        grams, model = Grams(letters), Profiles(known, depth)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                top = grams.top(text, depth) if model.names else ()
                name, score = model.best(top) if len(top) else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "text_key", "lang_pred", "score"])

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), C.text_hash().alias("text_key"),
                       F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(classify, f"doc_id {kind}, text_key long, lang_pred string, score double")


def _length(grams: np.ndarray) -> int:
    """Length class of a text by the number of its different n-grams."""
    return int(len(grams)).bit_length()


def _least(taught: DataFrame, profiles: dict[str, list[int]], depth: int) -> dict[tuple[str, int], float]:
    """The least score that each language's rows in ``taught`` reach, by length class."""
    shared = taught.sparkSession.sparkContext.broadcast((letter_table(), profiles))

    def scores(batches):
        letters, known = shared.value
        grams, model = Grams(letters), Profiles(known, depth)
        found: dict[tuple[str, int], float] = {}
        for lang, text in _slices(batches):
            top = grams.top(text, depth)
            name, score = model.best(top) if len(top) else (UNKNOWN, 0.0)
            if name == lang:
                at = (name, _length(top))
                found[at] = min(score, found.get(at, 1.0))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.float64())],
                                         names=["lang", "length", "score"])

    rows = taught.mapInArrow(scores, "lang string, length int, score double").groupBy("lang", "length").agg(F.min("score").alias("score"))
    return {(r["lang"], r["length"]): r["score"] for r in rows.collect()}  # a few classes a language


def keep_known(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the documents that language ID rejects: those without a
    letter, and those whose score is below ``margin`` times the least score that the
    predicted language's documents have in their length class. Classes that they lack
    reject nothing. Fitted on all labelled rows of ``docs`` outside the held-out fold;
    rows equal in language, id and text count once."""
    rows = _labelled(docs)
    profiles = _profiles(rows.dropDuplicates(["lang", "h"]).select("lang", "text"), DEPTH) if _languages(rows) else {}
    # Copies have the score of their first, so the least score needs no shuffle of texts.
    least = _least(rows.select("lang", "text"), profiles, DEPTH) if profiles else {}
    shared = docs.sparkSession.sparkContext.broadcast((letter_table(), profiles, least))
    plain = [f.name for f in docs.schema.fields]

    def known(batches):
        letters, own, limits = shared.value
        grams, model = Grams(letters), Profiles(own, DEPTH)

        def passes(text):
            top = grams.top(text, DEPTH) if model.names else ()
            if not len(top):
                return False
            name, score = model.best(top)
            return score >= margin * limits.get((name, _length(top)), 0.0)

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                mask = pa.array([passes(t or "") for t in part.column(at).to_pylist()], pa.bool_())
                yield part.filter(mask).select(range(len(plain)))

    # Texts are sent to the workers once; only one of another type gets a column as string.
    if dict(docs.dtypes).get(C.TEXT) == "string":
        at, sent = plain.index(C.TEXT), docs
    else:
        at, sent = len(plain), docs.withColumn("__text", F.col(C.TEXT).cast("string"))
    return sent.mapInArrow(known, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
