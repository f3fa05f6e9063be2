"""Exact top-k search by distributed histogram selection (operator 1).

Scores are integer inner products. The query set is cut into blocks of at most
``QUERY_BLOCK`` queries, of at most ``BLOCK_VALUES`` components in all (16 MB, the
bound of what is broadcast); for each block:

1. Rounds of refinement. Every vector is scored against the block, and each task
   counts, per query, how many scores fall into each of ``BINS`` equal bins of
   the query's range, from the top down to the bin that holds its own k-th score
   (lower bins can't hold the global k-th). The sums over all tasks show which
   bin holds the k-th best score; it becomes the next range. The first range is
   Cauchy's bound on the inner product, so two or three rounds reach single
   scores: the k-th value itself.
2. Everything above the k-th value is kept, and of the scores equal to it as
   many as are missing, by smaller vec_id; each task hands on at most k rows of
   a query, so ties of any size are harmless. The block's k rows of each query
   are written to the shared folder, and what was broadcast for it goes.

Nothing but k rows per query and task is shuffled, and no scores are stored.
Work grows with queries times vectors, as an exact search must.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part, nor do rows without ``vec_id``; vectors of another length than a query
are no candidates for it. A row is the query's own if it has its ``vec_id``.
A query id that occurs twice is searched once, with the smaller vector;
candidates that repeat each count, as they would in a join. A score of 2^61 or more
either way raises OverflowError. Queries with no candidate give no row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlog.llm import common as C
from packetlog.session import scratch_path

K = 5
SCALE = 256.0
QUERY_STEP = 50
QUERY_BLOCK = 4096
BLOCK_VALUES = 1 << 21
BINS = 512
RESULT = "query_id long, rank int, vec_id long, score long"
#: Scores held at once in a task.
CHUNK = 1 << 21
EXACT = float(1 << 53)
#: Scores below this leave room for the ends of a range in 64 bits.
LIMIT = 1 << 61


def quantised(column: str) -> Column:
    """floor(256 x) of every component, x as double."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * F.lit(SCALE)).cast("double"))


def _usable(column: str) -> Column:
    bad = F.exists(F.col(column).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~bad


class Block:
    """A block of queries of one length, and the search state of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low=None, stop=None, step=None):
        self.ids, self.vectors = ids, vectors
        # Each query's range of scores [low, stop), cut into bins of ``step``.
        self.low, self.stop, self.step = low, stop, step

    def state(self) -> tuple:
        return self.ids, self.vectors, self.low, self.stop, self.step

    def scores(self, matrix: np.ndarray, valid=True) -> np.ndarray:
        """Exact scores, queries by rows of ``matrix`` (whole numbers), where ``valid``."""
        peak = np.abs(matrix).max(initial=0) * np.abs(self.vectors).max(initial=0) * max(1, matrix.shape[1])
        if peak < EXACT:  # every partial sum is a whole number that doubles hold
            return (self.vectors @ matrix.T).astype(np.int64)
        if peak >= LIMIT:  # Python's integers tell whether a score really gets there
            whole = np.frompyfunc(int, 1, 1)
            scores = (whole(self.vectors) @ whole(matrix).T) * valid
            if max(abs(s) for s in scores.flat) >= LIMIT:
                raise OverflowError("an inner product is 2^61 or more")
            return scores.astype(np.int64)
        return self.vectors.astype(np.int64) @ matrix.astype(np.int64).T


def _chunks(batches, block: Block):
    """(ids, scores, valid) of chunks of the candidates of the block's length."""
    width, most = block.vectors.shape[1], max(1, CHUNK // len(block.ids))
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        fits = np.flatnonzero(sizes == width)
        values = lists.values.to_numpy()
        starts = lists.offsets.to_numpy()[:-1]
        for k in range(0, len(fits), most):
            rows = fits[k:k + most]
            matrix = values[starts[rows][:, None] + np.arange(width)]
            valid = block.ids[:, None] != ids[rows][None, :]
            yield ids[rows], block.scores(matrix, valid), valid


def _count(batches, block: Block, k: int):
    """(query, bin, n): the task's counts from the top down to its k-th score."""
    n = len(block.ids)
    counts = np.zeros((n, BINS), np.int64)
    for _, scores, valid in _chunks(batches, block):
        at = (scores - block.low[:, None]) // block.step[:, None]
        inside = valid & (at >= 0) & (scores < block.stop[:, None])
        flat = (np.arange(n)[:, None] * BINS + at)[inside]
        counts += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts  # scores in higher bins
    q, b = np.nonzero((counts > 0) & (above < k))
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["query", "bin", "n"])


def _collect(batches, block: Block, k: int):
    """(query, vec_id, score) of at most k rows of each query: those above the
    k-th value and, of those equal to it, the smallest ids."""
    best: dict[int, list[tuple[int, int]]] = {}
    for ids, scores, valid in _chunks(batches, block):
        hit = valid & (scores >= block.low[:, None])
        q, c = np.nonzero(hit)
        order = np.lexsort((ids[c], -scores[q, c], q))
        q, c = q[order], c[order]
        starts = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1, [len(q)]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if a < b:
                rows = [(-int(scores[q[i], c[i]]), int(ids[c[i]])) for i in range(a, min(b, a + k))]
                best[int(q[a])] = sorted(best.get(int(q[a]), []) + rows)[:k]
    out = [(int(block.ids[q]), i, -s) for q, rows in best.items() for s, i in rows]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])


def _kth_values(vectors: DataFrame, block: Block, bound: float, k: int) -> None:
    """Refine the block's ranges until each is the single k-th best score (or
    the lowest possible score, for queries with fewer than k candidates)."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((block.vectors ** 2).sum(axis=1))
        reach = np.ceil(np.where(norms == 0, 0, norms * bound * (1 + 1e-9)))
    reach = np.minimum(np.nan_to_num(reach, nan=LIMIT, posinf=LIMIT), LIMIT).astype(np.int64) + 1
    block.low, block.stop = -reach, reach + 1
    queries, need, few = np.arange(len(block.ids)), np.full(len(block.ids), k, np.int64), np.zeros(len(block.ids), bool)
    while True:
        block.step = -(-(block.stop - block.low) // BINS)
        shared = vectors.sparkSession.sparkContext.broadcast(block.state())
        rows = (vectors.mapInArrow(lambda it: _count(it, Block(*shared.value), k), "query long, bin long, n long")
                .groupBy("query", "bin").agg(F.sum("n").alias("n")).toPandas())  # at most BINS rows a query
        shared.destroy()
        counts = np.zeros((len(block.ids), BINS), np.int64)
        counts[rows["query"], rows["bin"]] = rows["n"]
        total = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # of this bin and all above
        few |= total[:, 0] < need  # only possible in the first round
        at = np.where(few, 0, BINS - 1 - (total[:, ::-1] >= need[:, None]).argmax(axis=1))
        need = np.where(few, need, need - (total - counts)[queries, at])
        low = np.where(few, block.low, block.low + at * block.step)
        block.stop = np.where(few, low + 1, np.minimum(block.stop, low + block.step))
        block.low = low
        if (block.stop - block.low <= 1).all():
            return


def top_k(vectors: DataFrame, is_query: Column, k: int = K, column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row of
    ``vectors`` that ``is_query`` marks, the k best other rows by the inner
    product of the quantised ``column``."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(column).alias("v"), is_query.alias("is_query"))
    queries = C.cut(rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = rows.select("vec_id", "v")
    widths = queries.groupBy(F.size("v").alias("width")).count().orderBy("width").toLocalIterator()
    found = scratch_path(spark, "llm", uuid.uuid4().hex)
    for width, n in [(r["width"], r["count"]) for r in widths]:
        bound = rows.where(F.size("v") == width).agg(
            F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
        size = max(1, min(QUERY_BLOCK, BLOCK_VALUES // max(1, width)))
        blocks = -(-n // size)
        dealt = queries.where(F.size("v") == width).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        for b in range(blocks):
            # Blocks are dealt by hash; one that came out larger is cut again.
            part = dealt.where(F.col("block") == b).orderBy("vec_id").toLocalIterator()
            held: list = []
            for row in part:
                held.append(row)
                if len(held) == size:
                    _search(rows, held, bound, k, found)
                    held = []
            if held:
                _search(rows, held, bound, k, found)
    # The schema also holds for a folder without a block.
    spark.createDataFrame([], RESULT).write.mode("append").parquet(found)
    return spark.read.schema(RESULT).parquet(found)


def _search(rows: DataFrame, queries: list, bound: float, k: int, folder: str) -> None:
    """Append the result of one block of queries: the k best of every task's k best."""
    block = Block(np.array([r["vec_id"] for r in queries], np.int64), np.array([r["v"] for r in queries], np.float64).reshape(len(queries), -1))
    _kth_values(rows, block, bound, k)
    shared = rows.sparkSession.sparkContext.broadcast(block.state())
    found = rows.mapInArrow(lambda it: _collect(it, Block(*shared.value), k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
    shared.destroy()


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
