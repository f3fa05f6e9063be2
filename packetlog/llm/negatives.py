"""Hard-negative mining by Strassen products of integer tiles (operator 11).

Every component x of a vector becomes floor(256 x); the score of two vectors is
their inner product. An anchor's positives are its best rows of the same label; for
each positive, its negatives are the best rows of other labels whose scores lie in
a window of the positive's score (``LOW`` to ``HIGH`` per cent). Higher scores come
first, then smaller ``vec_id``.

1. Anchors and rows are numbered, and dealt by a hash of the number to a grid of
   cells of about ``CELL_ANCHORS`` by ``CELL_ROWS``: a row goes to one column and
   every line of the grid, an anchor to one line and every column. So each cell is a
   task of bounded memory, whatever ids or labels repeat, and a lost one is redone.
   Work grows with anchors times rows, as an exact search of all rows must.
2. A cell multiplies int64 tiles by Strassen's recursion: seven half-size products in
   place of eight, odd sides padded with zeros, plain products at ``LEAF``. Additions
   are exact: int64 arithmetic is a ring modulo 2^64, so intermediate sums may wrap as
   long as the scores themselves fit, which is checked.
3. First pass: a positive heap per anchor holds its best rows; heaps of tiles are
   merged in the cell, heaps of cells by rank (each task hands on at most k rows of
   an anchor). Second pass: a window heap per (anchor, positive), merged alike.

Edge cases: rows with a null id, label or vector, or with null or non-finite
components take no part; vectors of another length than the anchor's are no
candidates for it. A row is the anchor's own if it has its ``vec_id``. An anchor id
that occurs twice is searched once (least label, then least vector); candidates that
repeat each count, and a repeated positive gives its negatives once per place.
Scores of 2^62 or more raise OverflowError. Anchors without positives, and positives
without negatives, give no row; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlog.llm import common as C

POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in per cent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256.0
ANCHOR_STEP, MOVED_STEP, LABELS = 50, 7, 10
CELL_ANCHORS, CELL_ROWS = 2048, 8192
#: A tile: anchors by rows whose scores are held at once.
TILE_ANCHORS, TILE_ROWS = 512, 2048
LEAF = 16
#: No score: below all that are allowed.
NONE = -(1 << 62)


# ------------------------------------------------------------------- tiles

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices, exact wherever it fits int64."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    h, k, w = (rows + 1) // 2, (inner + 1) // 2, (columns + 1) // 2
    if (rows | inner | columns) & 1:
        a = np.pad(a, ((0, 2 * h - rows), (0, 2 * k - inner)))
        b = np.pad(b, ((0, 2 * k - inner), (0, 2 * w - columns)))
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :w], b[:k, w:], b[k:, :w], b[k:, w:]
    out = np.empty((2 * h, 2 * w), np.int64)
    c11, c12, c21, c22 = out[:h, :w], out[:h, w:], out[h:, :w], out[h:, w:]
    diagonal = strassen(a11 + a22, b11 + b22, leaf)
    lower, upper = strassen(a21 + a22, b11, leaf), strassen(a11 + a12, b22, leaf)
    right, left = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    np.add(right, upper, out=c12)
    np.add(lower, left, out=c21)
    np.add(diagonal, left, out=c11)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    c11 -= upper
    np.add(diagonal, right, out=c22)
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c22 -= lower
    return out[:rows, :columns]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each row of ``scores`` (changed; ``NONE``: no
    candidate), for ascending ``ids``: the first of equal scores has the least."""
    n = len(scores)
    values, names, lines = np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64), np.arange(n)
    for place in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        values[:, place], names[:, place] = scores[lines, at], ids[at]
        scores[lines, at] = NONE
    return values, names


class Heaps:
    """The k best (score, id) of each of n lines."""

    def __init__(self, n: int, k: int):
        self.values, self.names = np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64)

    def merge(self, lines: slice, values: np.ndarray, names: np.ndarray) -> None:
        k = self.values.shape[1]
        values, names = np.hstack([self.values[lines], values]), np.hstack([self.names[lines], names])
        order = np.lexsort((names, -values), axis=1)[:, :k]
        self.values[lines], self.names[lines] = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as int64: floor(256 x)."""
    flat = lists.combine_chunks()
    values = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(values).max(initial=0) >= 2.0 ** 62:
        raise OverflowError("a component does not fit 64 bits")
    return values.astype(np.int64).reshape(len(flat), -1)


def _tiles(anchors: pa.Table, rows: pa.Table):
    """Tiles of a cell: (anchors' numbers, scores, candidates' ids and labels),
    candidates in order of their ids."""
    rows = rows.sort_by("vec_id")
    width = np.diff(_offsets(anchors["v"])), np.diff(_offsets(rows["v"]))
    for size in np.unique(width[0]).tolist():
        mine, others = np.flatnonzero(width[0] == size), np.flatnonzero(width[1] == size)
        if not len(others):
            continue
        a, b = _matrix(anchors["v"].take(pa.array(mine))), _matrix(rows["v"].take(pa.array(others)))
        if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, size) >= 2.0 ** 62:
            raise OverflowError("a score may not fit 62 bits")
        ids, labels = rows["vec_id"].to_numpy()[others], rows["label"].to_numpy()[others]
        for i in range(0, len(a), TILE_ANCHORS):
            for j in range(0, len(b), TILE_ROWS):
                scores = strassen(a[i:i + TILE_ANCHORS], np.ascontiguousarray(b[j:j + TILE_ROWS].T))
                yield mine[i:i + TILE_ANCHORS], scores, ids[j:j + TILE_ROWS], labels[j:j + TILE_ROWS]


def _offsets(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().offsets.to_numpy()


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(anchor_id, vec_id, score): each anchor's k best of its label in a cell."""
    own, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    heaps = Heaps(len(own), k)
    for at, scores, ids, labels in _tiles(anchors, rows):
        scores[(label[at][:, None] != labels) | (own[at][:, None] == ids)] = NONE
        heaps.merge(at, *best(scores, ids, k))
    line, place = np.nonzero(heaps.values > NONE)
    return pa.table({"anchor_id": own[line], "vec_id": heaps.names[line, place], "score": heaps.values[line, place]})


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """(anchor_id, place, positive_id, positive_score, negative_id,
    negative_score): the k best of each window in a cell."""
    own, label, found = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["found"].to_pylist()
    places = max(map(len, found), default=0)
    floor, ceiling = np.zeros((len(own), places), np.int64), np.full((len(own), places), NONE, np.int64)
    for line, positives in enumerate(found):
        for p in positives:  # whole numbers of any size
            floor[line, p["place"] - 1], ceiling[line, p["place"] - 1] = -(-low * p["score"] // 100), high * p["score"] // 100
    heaps = [Heaps(len(own), k) for _ in range(places)]
    for at, scores, ids, labels in _tiles(anchors, rows):
        scores[label[at][:, None] == labels] = NONE
        for place, heap in enumerate(heaps):
            inside = (scores >= floor[at, place][:, None]) & (scores <= ceiling[at, place][:, None]) & (scores > NONE)
            heap.merge(at, *best(np.where(inside, scores, NONE), ids, k))
    out: list[tuple] = []
    for place, heap in enumerate(heaps):
        for line, n in zip(*(x.tolist() for x in np.nonzero(heap.values > NONE))):
            p = found[line][place]
            out.append((own[line], place + 1, p["vec_id"], p["score"], heap.names[line, n], heap.values[line, n]))
    names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table({n: pa.array([x[i] for x in out], pa.int32() if n == "place" else pa.int64()) for i, n in enumerate(names)})


# -------------------------------------------------------------------- jobs

def _usable(column: str) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull() & ~bad


def _cells(anchors: DataFrame, rows: DataFrame, lines: int, columns: int, work, schema: str) -> DataFrame:
    """Runs ``work`` on every cell of the grid."""
    a = anchors.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(lines)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = rows.withColumn("j", F.pmod(F.xxhash64("m"), F.lit(columns)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(work, schema)


def _first(rows: DataFrame, keys: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, column: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score`` and ``positive_rank`` for the rows of
    ``vectors`` (vec_id, label, ``column``) that ``is_anchor`` marks, against all."""
    used = vectors.where(_usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(column).alias("v"), is_anchor.alias("is_anchor"))
    rows, _ = C.stage(used.withColumn("m", F.monotonically_increasing_id()))
    anchors = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    anchors, _ = C.stage(anchors)
    rows = rows.drop("is_anchor")
    lines, columns = -(-anchors.count() // CELL_ANCHORS) or 1, -(-rows.count() // CELL_ROWS) or 1

    found = _cells(anchors, rows, lines, columns, lambda a, b: _positives(a, b, positives), "anchor_id long, vec_id long, score long")
    found = _first(found, ["anchor_id"], "score", "vec_id", positives, "place")
    # At most ``positives`` rows an anchor.
    found = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    with_found, _ = C.stage(anchors.join(found, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "found"))

    out = _cells(with_found, rows, lines, columns, lambda a, b: _negatives(a, b, negatives, low, high),
                 "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    out = _first(out, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("place").alias("positive_rank"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % ANCHOR_STEP == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.vec_id % 50 = 0 AND len(a.v) = len(c.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, positive_rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT * FROM n WHERE rank <= 3
"""
