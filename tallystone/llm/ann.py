"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one and rotated by a fixed random rotation; the signs of its
coordinates are its code, packed 8 to a byte. With ``f`` the inner product of the rotated vector
and its own code vector, the inner product of code and rotated query over ``f`` estimates the cosine,
and ``epsilon * sqrt((1 - f^2) / f^2 / (d - 1))`` bounds the error of almost all estimates. A
candidate is reranked on the original vectors only if its upper bound reaches the least of the
query's best scores so far.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, stage_path, staged


NEAREST = "query_id long, rank int, vec_id long, score double"
#: Pairs that are scored at a time, and cells of the matrix of estimates.
PAIRS, CELLS = 16_384, 2_000_000


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, signs made unique."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their lengths, and the lengths; largest coordinates are divided out first, so nothing over- or underflows."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (top * length)[:, 0]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and the correction ``f`` of each vector."""
    turned = unit(vectors)[0] @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(column: str):
    """Rows whose vector has no null or non-finite component and is not all zero."""
    v = F.col(column)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def lengths(vectors: pa.Array):
    """``(dim, places)`` for each length of the vectors of a batch."""
    dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def build_index(vectors: DataFrame, id_col: str, vector_col: str, seed: int) -> DataFrame:
    """``(vec_id, code, f, v)`` of every usable row, as a table in the shared folder. Each length has its own rotation."""

    def run(batches):
        for b in batches:
            for dim, at in lengths(b.column(1)):
                ids, v = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                code, f = encode(matrix(v, dim), rotation(dim, seed))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(f, pa.float64()), v.cast(pa.list_(pa.float64()))], ["vec_id", "code", "f", "v"])

    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return staged(rows.mapInArrow(run, "vec_id long, code binary, f double, v array<double>"), "codes")


class Searcher:
    """The best ``k`` of the rows seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, epsilon: float, turn: np.ndarray):
        self.ids, self.k, self.epsilon = ids, k, epsilon
        self.vectors, self.length = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.turned = (unit(vectors)[0] @ turn.T).astype(np.float32)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reranked = 0

    def exact(self, q: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cosine of pairs, row by row, so that equal vectors get equal scores; a bounded number of pairs at a time."""
        out = np.empty(len(q))
        for at in range(0, len(q), PAIRS):
            s = slice(at, at + PAIRS)
            x, y = self.vectors[q[s]], v[c[s]]
            out[s] = (x * y).sum(axis=1) / (self.length[q[s]] * np.sqrt((y * y).sum(axis=1)))
        return out

    def keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge scored rows into the best ``k``; ties go to the smaller id."""
        q = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        score, ids = np.concatenate([self.score.ravel(), score]), np.concatenate([self.found.ravel(), ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[q[top], place[top]] = score[top]
        self.found[q[top], place[top]] = ids[top]

    def add(self, ids: np.ndarray, codes: np.ndarray, f: np.ndarray, v: np.ndarray) -> None:
        """Rerank the rows that a query's bound can't rule out: those of best estimates first, which raises the bar for the others."""
        dim = v.shape[1]
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        estimate = (self.turned @ signs.T) / (np.sqrt(dim) * f).astype(np.float32)
        error = (self.epsilon * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1))).astype(np.float32)
        estimate[self.ids[:, None] == ids[None, :]] = -np.inf
        n = min(2 * self.k, len(ids))
        best = np.argpartition(estimate, len(ids) - n, axis=1)[:, len(ids) - n :]
        q, c = np.repeat(np.arange(len(self.ids)), n), best.ravel()
        real = np.isfinite(estimate[q, c])
        q, c = q[real], c[real]
        self.keep(q, ids[c], self.exact(q, v, c))
        estimate[q, c] = -np.inf
        estimate += error
        q, c = np.nonzero(estimate >= (self.score[:, -1:] - 1e-5).astype(np.float32)) if len(ids) > n else (q[:0], c[:0])
        real = np.isfinite(estimate[q, c])
        q, c = q[real], c[real]
        self.reranked += len(q)
        self.keep(q, ids[c], self.exact(q, v, c))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, epsilon: float = 3.0, seed: int = 7, block: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by cosine for each row whose id is divisible by ``every``.

    Ties go to the smaller id. Null ids, null, empty or zero vectors and vectors with null or
    non-finite components take no part. Vectors of different lengths have no cosine: a query meets the rows of its own
    length. Rows that share a query's id are its own; a query id that
    occurs in several rows is asked with the smallest of its vectors. Fewer than ``k`` candidates are all returned. An empty table
    gives an empty result; other columns are not read.

    Queries go out in blocks of about ``block`` by hash, one job a block: the block is broadcast (a bounded size) and released, each task keeps
    ``k`` rows a query, whatever it reads, and one window over ``k`` rows a task and query merges them into a table in the shared
    folder. So neither the driver nor a plan grows with the number of queries.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, id_col, vector_col, seed)
    spots = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-index.where(F.col("vec_id") % every == 0).count() // block))))
    queries = staged(index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", spots).sortWithinPartitions("block"), "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = stage_path(spark, "nearest")
    blocks = queries.select("block").distinct().orderBy("block").collect()
    for (b,) in blocks:
        asked: dict[int, list] = {}
        for r in queries.where(F.col("block") == b).orderBy("vec_id").collect():
            asked.setdefault(len(r[1]), []).append(r)
        sent = spark.sparkContext.broadcast({dim: (np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)) for dim, rows in asked.items()})

        def run(batches, sent=sent):
            searchers = {dim: Searcher(ids, v, k, epsilon, rotation(dim, seed)) for dim, (ids, v) in sent.value.items()}
            for whole in batches:
                for dim, at in lengths(whole.column(3)):
                    if dim in searchers:
                        s = searchers[dim]
                        step = max(64, CELLS // len(s.ids))
                        for i in range(0, len(at), step):
                            x = whole.take(pa.array(at[i : i + step]))
                            codes = np.frombuffer(b"".join(x.column(1).to_pylist()), dtype=np.uint8).reshape(x.num_rows, -1)
                            s.add(x.column(0).to_numpy(), codes, x.column(2).to_numpy(), matrix(x.column(3), dim))
            for s in searchers.values():
                q, p = np.nonzero(np.isfinite(s.score))
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[q]), pa.array(s.found[q, p]), pa.array(s.score[q, p])], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(run, "query_id long, vec_id long, score double")
        nearest = part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        stage(nearest, found)
        sent.destroy()
    if not blocks:
        stage(spark.createDataFrame([], NEAREST), found)
    return spark.read.schema(NEAREST).parquet(found)
