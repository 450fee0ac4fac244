"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

#: Queries that are scored at once, and the bytes of theirs that may travel to each task.
BLOCK_QUERIES, BLOCK_BYTES = 4096, 32 << 20
#: Each pass divides what is left of a query's score range by so many buckets.
BUCKETS = 4096
#: Products and sums up to here are exact in float64.
EXACT = 2**53
#: The least and the largest score; beyond them only whether a score is in the result matters, which is an error.
LEAST, MOST = -(2**63), 2**63 - 1
#: Below this an integer product can't overflow, rounding of the estimate included.
SAFE = 2**62
MATRIX_BYTES = 32 << 20


_whole = np.vectorize(int, otypes=[object])


class _Block:
    """Queries of one block by dimension, and how they are scored."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.parts = []
        for dim in sorted({len(v) for v in vectors}):
            rows = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
            self.parts.append((dim, rows, ids[rows], np.stack([vectors[i] for i in rows])))
        self.n = len(ids)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query rows, candidate ids, integer scores (queries x candidates), which of them count and which are beyond a long."""
        ids, offsets = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for dim, rows, query_ids, matrix in self.parts:
            mine = np.flatnonzero(sizes == dim)
            step = max(1, MATRIX_BYTES // (8 * max(len(rows), dim, 1)))
            for at in range(0, len(mine), step):
                take = mine[at : at + step]
                vectors = flat[offsets[take][:, None] + np.arange(dim)]
                top = (np.abs(matrix).max(initial=0) or 1) * (np.abs(vectors).max(initial=0) or 1) * max(dim, 1)
                beyond = np.zeros((len(rows), len(take)), bool)
                if top < EXACT:
                    got = (matrix @ vectors.T).astype(np.int64)
                elif top < SAFE:  # beyond float64's exact integers the slower integer product takes over
                    got = matrix.astype(np.int64) @ vectors.astype(np.int64).T
                else:
                    exact = _whole(matrix) @ _whole(vectors).T
                    beyond = ((exact < LEAST) | (exact > MOST)).astype(bool)
                    got = np.clip(exact, LEAST, MOST).astype(np.int64)
                yield rows, ids[take], got, query_ids[:, None] != ids[take][None, :], beyond


def _floor(x: Column) -> Column:
    """Floor of a double, which Spark would bound by a long's range; from 2^53 on doubles are whole."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows that take part: an id and ``floor(scale * x)`` of finite components."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: _floor(c * scale)).alias("v"))


def exact_top_k(vectors: DataFrame, *, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each query the ``k`` other rows with the highest integer inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; they are taken in blocks of ``BLOCK_QUERIES`` (and
    ``BLOCK_BYTES``), and a block, whose size is bounded, travels to the tasks that read the candidates. A block takes these
    passes, each of which scores every candidate. Passes of histograms: every task counts its scores in
    the buckets of each query's open range (those not below its own k-th score; lower ones can't matter), Spark adds the
    counts up, and the bucket in which the k-th highest score lies becomes the range for the next pass, until it is one
    score wide. Last pass: scores at or above the k-th stay, of equal ids and scores per task no more than k, and
    are ranked. No pass sends more than a few numbers per query and task.

    Rows whose id is null, or whose vector is null or holds null or non-finite components, take no part; vectors of
    another length than the query's are no candidates for it. Scores are exact up to a long's range; one beyond it that would
    be in the result is an error. Rows that repeat a query's id are that query (the smallest
    vector counts); other repeated rows are candidates each. An empty table gives no rows. Other columns are ignored.

    Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    rows = materialize(_integers(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    longest = queries.agg(F.max(F.size("v")).alias("d")).first()["d"]
    per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * (longest or 1))))
    count = queries.count()
    blocks = max(1, -(-count // per_block))
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    out = None
    for b in range(blocks):
        found = _block(rows, queries.where(F.col("block") == b), k)
        found = materialize(found, "top") if blocks > 1 else found
        out = found if out is None else out.union(found)
    return out


def _block(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    held = queries.orderBy("vec_id").collect()
    block = spark.sparkContext.broadcast(_Block(np.array([r["vec_id"] for r in held], np.int64), [np.array(r["v"]) for r in held]))
    n = len(held)
    reach = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("r")).first()["r"] or 0.0
    # No score is beyond the product of the two lengths.
    edge = [int(min(np.linalg.norm(r["v"]) * reach * (1 + 1e-9) + 1, 2.0**63)) for r in held]
    low, high = (np.array(v, np.int64).reshape(-1) for v in ([max(LEAST, -e) for e in edge], [min(MOST, e) for e in edge]))
    above = np.zeros(n, np.int64)

    while n and (high > low).any():
        width = np.array([max(1, -((int(a) - int(b) - 1) // BUCKETS)) for a, b in zip(low, high, strict=True)], np.int64)
        state = spark.sparkContext.broadcast((low, high, width, above))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, width, above = state.value
            kept = [np.zeros(0, np.int64)] * block.value.n  # the highest buckets that this task has seen, k of them
            for batch in batches:
                for at, _, got, ok, _ in block.value.scores(batch):
                    # A difference of longs may exceed one, but wraps to the right unsigned number where it isn't negative.
                    over = got.view(np.uint64) - low[at].view(np.uint64)[:, None]
                    bucket = (over // width[at].view(np.uint64)[:, None]).astype(np.int64)
                    bucket[~ok | (got < low[at][:, None]) | (got > high[at][:, None])] = -1
                    if bucket.shape[1] > k:
                        bucket = np.partition(bucket, bucket.shape[1] - k, axis=1)[:, -k:]
                    for i, q in enumerate(at):
                        new = np.concatenate([kept[q], bucket[i][bucket[i] >= 0]])
                        kept[q] = np.sort(new)[-k:]
            q = np.repeat(np.arange(block.value.n), [len(x) for x in kept])
            pairs, counts = np.unique(np.stack([q, np.concatenate([*kept, np.zeros(0, np.int64)])]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(counts)], ["q", "bucket", "n"])

        histogram = rows.mapInArrow(count, "q long, bucket long, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
        # Where counting from the top reaches k; a query with fewer candidates ends in its lowest bucket.
        w = Window.partitionBy("q").orderBy(F.desc("bucket"))
        upto = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("last", F.min("bucket").over(Window.partitionBy("q")))
        left = spark.createDataFrame([(i, k - int(a)) for i, a in enumerate(above)], "q long, need long")
        ends = upto.join(left, "q").where(((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))) | ((F.col("upto") < F.col("need")) & (F.col("bucket") == F.col("last"))))
        seen = np.zeros(n, bool)
        for r in ends.collect():
            q = r["q"]
            seen[q] = True
            if r["upto"] < k - above[q]:  # fewer than k candidates in all: each of them stays
                high[q] = low[q]
                continue
            above[q] += r["upto"] - r["n"]
            low[q] = int(low[q]) + r["bucket"] * int(width[q])
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]) - 1)
        high[~seen] = low[~seen]
        state.unpersist()

    floor = spark.sparkContext.broadcast(low)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        held = [np.zeros((0, 2), np.int64)] * block.value.n
        ids = np.zeros(block.value.n, np.int64)
        for batch in batches:
            for at, vec_ids, got, ok, beyond in block.value.scores(batch):
                ok &= got >= floor.value[at][:, None]
                if (ok & beyond).any():
                    raise OverflowError("a score among the highest is beyond the range of a long")
                for i in np.flatnonzero(ok.any(axis=1)):
                    c = np.flatnonzero(ok[i])
                    new = np.concatenate([held[at[i]], np.stack([vec_ids[c], got[i, c]], axis=1)])
                    held[at[i]] = new[np.lexsort((new[:, 0], ~new[:, 1]))[:k]]
        for _, at, query_ids, _ in block.value.parts:
            ids[at] = query_ids
        flat = np.concatenate([*held, np.zeros((0, 2), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in held])), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names)

    best = rows.mapInArrow(collect, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
