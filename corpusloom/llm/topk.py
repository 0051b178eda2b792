"""Exact top-k search by distributed histogram selection.

Every query scores every candidate. Rounds of 256-bucket histograms, summed over all tasks, narrow the
score range that holds each query's k-th value; then the scores from that range up are filtered and
ranked. Queries go through in blocks of a fixed byte size, the only thing that is broadcast, so neither
a worker nor the driver holds anything that grows with the table.

Vectors that are null, empty, or hold null or non-finite components take no part, nor does a pair of
vectors of different length. Rows that share the query's id are the query's own row and no candidates;
equal query rows count once. Equal scores go to the smaller id. Scores beyond 64 bits are clamped.
Rows with a null id can be candidates (ranked last among equals); they are never queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table, written

#: Bytes of one broadcast block of query vectors, and rows of candidates scored at once.
BLOCK_BYTES = 8 << 20
BATCH_ROWS = 2048
#: Rounds end when the range of each query's k-th value is this small.
BUCKETS, SPARE = 256, 40
NO_ID = np.iinfo(np.int64).max


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v array<double>) with v = floor(scale * x), without the vectors that take no part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fit = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    raw = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    big = F.exists(raw, lambda x: F.abs(x) >= F.lit(2.0**62))
    return df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fit).select(F.col(id_col).cast("long").alias("id"), F.when(big, raw).otherwise(v).alias("v"))


def _score(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: float64 where no sum can pass 2**53, else Python integers."""
    if c.size == 0 or q.size == 0:
        return np.zeros((len(c), len(q)), np.int64)
    if float(np.abs(c).max()) * float(np.abs(q).max()) * c.shape[1] < 2.0**53:
        return (c @ q.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(c).dot(whole(q).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], q_id: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, mask of pairs that count) of each batch; vectors of another length are left out."""
    for batch in batches:
        lists = batch.column("v")
        sizes = np.diff(lists.offsets.to_numpy())
        fit = sizes == q.shape[1]
        if not fit.any():
            continue
        flat = lists.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)[fit]
        for at in range(0, len(flat), BATCH_ROWS):
            i, v = ids[at : at + BATCH_ROWS], flat[at : at + BATCH_ROWS]
            yield i, _score(v, q), i[:, None] != q_id[None, :]


def _block_top_k(spark: SparkSession, candidates: DataFrame, q_id: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Top k of one block of queries of equal length."""
    n = len(q_id)
    shared = spark.sparkContext.broadcast((q_id, q))
    # numbers of scores above the range, and in it; the range is [low, low + width)
    low, width = np.full(n, -(2**63), object), np.full(n, 2**64, object)
    above, inside = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    first = candidates.mapInArrow(lambda b: _extremes(b, *shared.value), "q int, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    active = np.zeros(n, bool)
    for r in first.collect():  # one row a query of the block
        low[r["q"]], width[r["q"]], inside[r["q"]] = r["low"], r["high"] - r["low"] + 1, r["n"]
        active[r["q"]] = r["n"] > 0
    while (todo := [i for i in range(n) if active[i] and width[i] > 1 and inside[i] > SPARE]) and len(todo):
        shift = np.array([max(0, int(w - 1).bit_length() - 8) for w in width])
        state = spark.sparkContext.broadcast((np.array([int(x) for x in low], np.int64), shift, np.isin(np.arange(n), todo)))
        rows = candidates.mapInArrow(lambda b, s=state: _histogram(b, *shared.value, *s.value), "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
        over = Window.partitionBy("q").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        need = spark.createDataFrame([(i, int(k - above[i])) for i in todo], "q int, need long")
        got = rows.withColumn("reach", F.sum("n").over(over)).join(F.broadcast(need), "q")
        for r in got.where((F.col("reach") >= F.col("need")) & (F.col("reach") - F.col("n") < F.col("need"))).collect():  # one row a query
            i = r["q"]
            above[i] += r["reach"] - r["n"]
            low[i], width[i], inside[i] = low[i] + (r["bucket"] << int(shift[i])), min(1 << int(shift[i]), low[i] + width[i] - (low[i] + (r["bucket"] << int(shift[i])))), r["n"]
            active[i] = True
        for i in set(todo) - {r for r in todo if above[r] + inside[r] >= k}:  # fewer scores than k: all are wanted
            width[i] = 1
        state.unpersist()
    floor = spark.sparkContext.broadcast(np.array([int(x) for x in low], np.int64))
    found = candidates.mapInArrow(lambda b: _survivors(b, *shared.value, floor.value, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _extremes(batches, q_id, q):
    low, high, n = np.full(len(q), 2**63 - 1), np.full(len(q), -(2**63)), np.zeros(len(q), np.int64)
    for _, s, ok in _scored(batches, q_id, q):
        low = np.minimum(low, np.where(ok, s, 2**63 - 1).min(0))
        high = np.maximum(high, np.where(ok, s, -(2**63)).max(0))
        n += ok.sum(0)
    some = np.nonzero(n)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(low[some]), pa.array(high[some]), pa.array(n[some])], ["q", "low", "high", "n"])


def _histogram(batches, q_id, q, low, shift, todo):
    counts = np.zeros((len(q), BUCKETS), np.int64)
    pick = np.nonzero(todo)[0]
    if len(pick):
        row = (np.arange(len(pick)) * BUCKETS)[None, :]
        for _, s, ok in _scored(batches, q_id[pick], q[pick]):
            ok &= s >= low[pick][None, :]
            # the difference of two longs always fits an unsigned one
            bucket = (s.astype(np.uint64) - low[pick].astype(np.uint64)[None, :]) >> shift[pick].astype(np.uint64)[None, :]
            ok &= bucket < BUCKETS
            counts[pick] += np.bincount((bucket.astype(np.int64) + row)[ok], minlength=len(pick) * BUCKETS).reshape(len(pick), BUCKETS)
    at, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[at, bucket])], ["q", "bucket", "n"])


def _survivors(batches, q_id, q, floor, k):
    """Scores from the floor up; of those, a task's own k best a query, ties to smaller ids: the rest can't be among the k best."""
    kept = [np.zeros((3, 0), np.int64)]
    rows = 0

    def best(parts):
        w, i, s = np.concatenate(parts, axis=1)
        order = np.lexsort((i, np.invert(s), w))  # the inverse of a long turns its order round
        w, i, s = w[order], i[order], s[order]
        start = np.searchsorted(w, w, side="left")
        top = np.arange(len(w)) - start < k
        return np.stack([w[top], i[top], s[top]])

    for ids, s, ok in _scored(batches, q_id, q):
        at, which = np.nonzero(ok & (s >= floor[None, :]))
        kept.append(np.stack([which, ids[at], s[at, which]]))
        rows += len(at)
        if rows > 1_000_000:
            kept = [best(kept)]
            rows = 0
    w, i, s = best(kept)
    yield pa.RecordBatch.from_arrays([pa.array(q_id[w]), pa.array(i, mask=i == NO_ID), pa.array(s)], ["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors.

    Queries are read back from a written table in blocks of ``block_bytes`` at most; each block's result
    is a written table.
    """
    spark = vectors.sparkSession
    candidates = quantised(vectors, id_col, vector_col, scale)
    asked = written(quantised(queries, id_col, vector_col, scale).where("id IS NOT NULL").distinct().withColumn("dim", F.size("v")), "topk-queries")
    parts, out = asked.groupBy("dim").agg(F.count("*").alias("n"), F.max("id").alias("top")).orderBy("dim").collect(), None
    for part in parts:  # one row a vector length
        size = max(1, block_bytes // (8 * part["dim"]))
        one = asked.where(F.col("dim") == part["dim"])
        after = None
        for _ in range(0, part["n"], size):
            last = None if after is None else F.array(*map(F.lit, after["v"]))
            rest = one if after is None else one.where((F.col("id") > after["id"]) | ((F.col("id") == after["id"]) & (F.col("v") > last)))
            block = rest.orderBy("id", "v").limit(size).collect()  # block_bytes at most
            if not block:
                break
            after = block[-1]
            got = written(_block_top_k(spark, candidates, np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], np.float64), k), "topk-block")
            out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
