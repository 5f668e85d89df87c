"""Exact top-k search by inner product: columnar branch-and-bound.

Candidates lie in vertical layout, a row of the matrix for each dimension. Scores accumulate dimension block by dimension
block; after each block a candidate's score is at most what it has so far plus the product of the remaining masses
(norms) of query and candidate. Candidates whose bound is under the query's k-th best score so far are dropped and the
survivors compacted. Vectors with components too large for 63-bit sums are scored in Python integers, wherever a float64
estimate with its error bound can't rule them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringework.llm import common

BLOCK_DIMS = 16
BLOCK_ROWS = 4096
BLOCK_QUERIES = 64
#: Vectors whose scaled components are all smaller than this take the fast way: scores of up to 64 dimensions fit 63 bits.
MOST = 1 << 28
#: Scores beyond a long are held as this or its negative; one in a result is an error, as it is for a cast to BIGINT.
BEYOND = (1 << 63) - 1


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(queries, np.iinfo(np.int64).min)

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        q, score, id_ = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, q))
        q, score, id_ = q[order], score[order], id_[order]
        first = np.searchsorted(q, q, side="left")
        nth = np.arange(len(q)) - first
        keep = nth < self.k
        self.q, self.score, self.id = q[keep], score[keep], id_[keep]
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Search one block of rows for all queries. Whole numbers; in float64 where all sums stay exact in it."""
    dims = queries.shape[1]
    top = max(int(np.abs(queries).max(initial=0)), int(np.abs(vectors).max(initial=0)))
    kind = np.float64 if top * top * dims < 1 << 52 else np.int64
    slack = 1 if kind is np.float64 else 4096  # float64 rounds larger sums
    columns = np.ascontiguousarray(vectors.T).astype(kind)  # vertical layout
    own = queries.astype(kind)
    cuts = list(range(0, dims, BLOCK_DIMS))
    rest_c = np.zeros((len(cuts) + 1, len(ids)))
    rest_q = np.zeros((len(cuts) + 1, len(own)))
    for j in range(len(cuts) - 1, -1, -1):
        s = slice(cuts[j], cuts[j] + BLOCK_DIMS)
        rest_c[j] = rest_c[j + 1] + (columns[s].astype(np.float64) ** 2).sum(0)
        rest_q[j] = rest_q[j + 1] + (own[:, s].astype(np.float64) ** 2).sum(1)
    rest_c, rest_q = np.sqrt(rest_c), np.sqrt(rest_q)
    for at in range(0, len(own), BLOCK_QUERIES):
        part = slice(at, at + BLOCK_QUERIES)
        least = best.least[part].astype(np.float64)
        dense = np.zeros((len(own[part]), len(ids)), kind)
        qi = ci = score = None
        for j, cut in enumerate(cuts):
            s = slice(cut, cut + BLOCK_DIMS)
            if qi is None:
                dense += own[part, s] @ columns[s]
                bound = dense + rest_q[j + 1, part][:, None] * rest_c[j + 1] * (1 + 1e-9) + slack
                alive = bound >= least[:, None]
                if j == 0:
                    alive &= query_ids[part][:, None] != ids
                else:
                    alive &= kept
                kept = alive
                if 4 * np.count_nonzero(alive) <= alive.size:
                    qi, ci = np.nonzero(alive)
                    score = dense[qi, ci]
            else:
                score = score + (own[part, s][qi] * columns[s][:, ci].T).sum(1)
                alive = score + rest_q[j + 1, part][qi] * rest_c[j + 1, ci] * (1 + 1e-9) + slack >= least[qi]
                qi, ci, score = qi[alive], ci[alive], score[alive]
        if qi is None:
            qi, ci = np.nonzero(kept)
            score = dense[qi, ci]
        score = score.astype(np.int64)
        good = score >= best.least[part][qi]
        if good.any():
            best.add(qi[good] + at, score[good], ids[ci[good]])


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers ``floor(1024 * x)``; shorter vectors are filled with zeros, longer ones cut to ``dims``."""
    n = np.asarray(pa.compute.list_value_length(col), np.int64)
    flat = np.asarray(col.flatten(), np.float64)
    whole = np.floor(flat * 1024)
    if len(n) and (n == dims).all():
        return whole.reshape(len(n), dims).astype(np.int64)
    out = np.zeros((len(n), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    fits = nth < dims
    out[row[fits], nth[fits]] = whole[fits].astype(np.int64)
    return out


def _large(col: pa.Array, dims: int) -> np.ndarray:
    """Which vectors have a scaled component of ``MOST`` or more among the first ``dims``."""
    n = np.asarray(pa.compute.list_value_length(col), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    large = (np.abs(np.asarray(col.flatten(), np.float64)) >= MOST / 1024) & (nth < dims)
    return np.bincount(row[large], minlength=len(n)) > 0


def _integers(col: pa.Array, dims: int) -> np.ndarray:
    """``floor(1024 * x)`` as Python integers of any size."""
    out = np.zeros((len(col), dims), object)
    for i, v in enumerate(col.to_pylist()):
        for j, x in enumerate(v[:dims]):
            out[i, j] = math.floor(x * 1024) if abs(x) < 1 << 60 else int(x) * 1024
    return out


def search_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Search rows for all queries, both as Python integers: exact at any size."""
    if not len(ids) or not len(query_ids):
        return
    unit = float(2 ** max(0, max(int(np.abs(queries).max()), int(np.abs(vectors).max())).bit_length() - 500))  # keeps the estimate finite
    q_near, v_near = ((x / unit).astype(np.float64) for x in (queries, vectors))
    q_size, v_size = (np.sqrt((x**2).sum(1)) for x in (q_near, v_near))
    off = (queries.shape[1] + 8) * 4e-16
    for at in range(0, len(query_ids), BLOCK_QUERIES):
        for start in range(0, len(ids), 512):
            part, rows = slice(at, at + BLOCK_QUERIES), slice(start, start + 512)
            most = q_near[part] @ v_near[rows].T + off * q_size[part][:, None] * v_size[rows]
            least = best.least[part].astype(np.float64) / unit / unit
            qi, ci = np.nonzero((most >= least[:, None] - np.abs(least[:, None]) * 1e-15) & (query_ids[part][:, None] != ids[rows]))
            if len(qi):
                score = [sum(a * b for a, b in zip(queries[at + q], vectors[start + c], strict=True)) for q, c in zip(qi.tolist(), ci.tolist(), strict=True)]
                best.add(qi + at, np.array([max(-BEYOND, min(BEYOND, x)) for x in score], np.int64), ids[rows][ci])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null itself nor with a null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x)), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 10, most_queries: int = 1 << 15, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest scores of each query against every row but its own: ``query_id, rank, vec_id, score``.

    Ties go to the smaller id. Queries are taken about ``most_queries`` at a time, each block searched and
    written before the next, which bounds what the driver and a broadcast hold; every block meets all rows. Null vectors, and vectors with null, NaN or infinite components, take
    no part, nor do rows with a null id. A listed score that a long can't hold is an error. Rows that share a query's id are its own; of several rows with
    a query's id the least vector asks. Missing components of shorter vectors count as zero. Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    asking = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    total, dims = asking.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-total // most_queries))
    found = [common.materialise(_one(rows, asking.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), dims or 1, k), "found") for i in range(blocks)]
    out = spark.read.schema(found[0].schema).parquet(*(x._table for x in found))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    fits = F.when(F.abs("score") < BEYOND, F.col("score")).otherwise(F.raise_error(F.lit("a score of the top k is too large for a long")).cast("long"))
    return common.result(out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score")), "top", *found)


def _one(rows: DataFrame, asking: DataFrame, dims: int, k: int) -> DataFrame:
    got = asking.orderBy("id").toArrow()
    ids, col = np.asarray(got.column("id"), np.int64), got.column("v").combine_chunks()
    large = _large(col, dims) if len(ids) else np.zeros(0, bool)
    large_ids, large_queries = ids[large], _integers(col.filter(pa.array(large)), dims) if large.any() else np.zeros((0, dims), object)
    ids = ids[~large]
    queries = _matrix(col.filter(pa.array(~large)), dims) if len(ids) else np.zeros((0, dims), np.int64)
    seeds = Best(len(ids), k)  # the queries are rows too: a first k-th best for each
    some = slice(0, BLOCK_ROWS)
    if len(ids):
        search_block(queries, ids, queries[some], ids[some], seeds)
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries, seeds.least, large_ids, large_queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least, large_ids, large_queries = shared.value
        best, large_best = Best(len(ids), k), Best(len(large_ids), k)
        best.least = least.copy()
        if len(ids) or len(large_ids):
            for b in common.gathered(batches, BLOCK_ROWS):
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(at, BLOCK_ROWS)
                    if len(large_ids):
                        search_large(large_queries, large_ids, _integers(part.column(1), dims), np.asarray(part.column(0), np.int64), large_best)
                    large = _large(part.column(1), dims)
                    if large.any():
                        some = part.filter(pa.array(large))
                        search_large(queries.astype(object), ids, _integers(some.column(1), dims), np.asarray(some.column(0), np.int64), best)
                        part = part.filter(pa.array(~large))
                    if len(ids) and part.num_rows:
                        search_block(queries, ids, _matrix(part.column(1), dims), np.asarray(part.column(0), np.int64), best)
        for own, found in ((ids, best), (large_ids, large_best)):
            yield pa.RecordBatch.from_arrays([pa.array(own[found.q], pa.int64()), pa.array(found.id, pa.int64()), pa.array(found.score, pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
