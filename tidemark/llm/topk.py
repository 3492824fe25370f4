"""Exact top-k inner products by norm-bucketed retrieval.

All vectors are sorted by length, longest first, so every task holds runs of vectors of similar length,
which it takes in buckets.  A query that already knows k products of at least t can be served by a
bucket only at a cosine of t / (its length x the bucket's longest length) or more.  That local threshold
decides what is done: above one, the bucket is skipped; when high, the few largest coordinates of the query
bound the same coordinates of any vector that could reach it, and the rest is discarded unseen;
otherwise the shorter vectors of the bucket are cut off by length.  What remains is verified
by its exact product.  The first t of each query comes from the longest vectors of all, and rises as better
products are found, so nothing is lost.

The query set is stated and is taken in blocks of bounded size, each sent to all tasks; the vectors
are never copied between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stage

BUCKET = 2048
SEEDS = 4096
BLOCK_ROWS = 16_384
BLOCK_BYTES = 64 << 20
COORDINATES = 3
COORDINATE_FROM = 0.9  # local cosine from which coordinates prune better than length


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, zero where a vector is shorter than the widest."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Queries:
    """A block of queries with the best products found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.least = np.full(len(ids), -np.inf)
        self.found: list[tuple] = []
        self.size = 0

    def products(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        q = self.vectors[rows]
        peak = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * q.shape[1]
        if peak < 2**53:  # doubles hold every sum exactly
            return (q.astype(float) @ vectors.T.astype(float)).astype(np.int64)
        return q @ vectors.T

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One bucket.  A scan may pack small files out of order, so the falling length is made here."""
        length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, vectors, length = ids[order], vectors[order], length[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.least <= 0, -1.0, self.least / (self.length * length[0]))
        cosine = np.nan_to_num(cosine, nan=-1.0, posinf=2.0)
        by_coordinate = (cosine >= COORDINATE_FROM) & (cosine <= 1 + 1e-9)
        if by_coordinate.any():
            unit = vectors / np.where(length == 0, 1, length)[:, None]
        for row in np.flatnonzero(by_coordinate):
            own, t = self.vectors[row] / self.length[row], min(cosine[row], 1.0)
            keep = np.ones(len(ids), bool)
            for c in np.argsort(-np.abs(own))[:COORDINATES]:
                middle, reach = own[c] * t, np.sqrt(max(0.0, (1 - own[c] ** 2) * (1 - t * t)))
                # a vector shorter than the bucket's longest needs a larger cosine still, so the bound holds
                above = middle - reach if own[c] > -t else -1.0
                below = middle + reach if own[c] < t else 1.0
                keep &= (unit[:, c] >= above - 1e-9) & (unit[:, c] <= below + 1e-9)
            if keep.any():
                at = np.flatnonzero(keep)
                self._keep(np.array([row]), at, self.products(np.array([row]), vectors[at]), ids)
        by_length = np.flatnonzero(cosine < COORDINATE_FROM)
        for i in range(0, len(by_length), 256):
            rows = by_length[i : i + 256]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.least[rows] <= 0, -1.0, self.least[rows] / self.length[rows])
            reach = int((length >= need.min() * (1 - 1e-9)).sum()) if need.min() > 0 else len(ids)
            if reach:
                self._keep(rows, np.arange(reach), self.products(rows, vectors[:reach]), ids)

    def _keep(self, rows: np.ndarray, at: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        r, c = np.nonzero(products >= self.least[rows][:, None])
        other = ids[at[c]] != self.ids[rows[r]]
        r, c = r[other], c[other]
        self.found.append((rows[r], ids[at[c]], products[r, c]))
        self.size += len(r)
        if self.size > 1_000_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep each query's k best, ties to the smaller id, and raise what its next ones must reach."""
        if not self.found:
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64)
        row, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        # one id may stand in several rows: its best product counts
        _, first = np.unique(np.stack([row, ids]), axis=1, return_index=True)
        first.sort()
        row, ids, score = row[first], ids[first], score[first]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        self.found = [(row[keep], ids[keep], score[keep])]
        self.size = int(keep.sum())
        return self.found[0]


def integers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (floor(64 x) of each component), squared length; vectors with a missing or non-finite part are left out."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return (
        vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).filter(finite)
        .select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * 64)).alias("v"))
        .withColumn("squared", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    )


def top_products(vectors: DataFrame, asked: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each vector for which ``asked`` (over the column ``id``) holds, the k largest integer products with all others.

    Returns query_id, rank (from 1), vec_id, score, by falling score and rising vec_id; fewer rows if there are fewer
    vectors.  Vectors, or ids, that are null, and vectors with null or non-finite components take no part.  Shorter
    vectors count as filled up with zeros.  Identical rows count once; an id with several vectors is served by its best
    product.  An id is never its own result.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = stage(
        integers(vectors, id_column, vector_column).repartitionByRange(parts, F.desc("squared"), "id")
        .sortWithinPartitions(F.desc("squared"), "id"),
        "by-length",
    )
    facts = ready.agg(F.max(F.size("v")).alias("width"), F.count(F.when(asked, 1)).alias("asked")).first()
    width, n = max(1, facts["width"] or 1), facts["asked"]
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    blocks = max(1, -(-n // rows))
    # bounded: the longest vectors of all
    longest = ready.orderBy(F.desc("squared"), "id").limit(min(SEEDS, rows)).select("id", "v").toArrow().combine_chunks()

    def block(b: int) -> DataFrame:
        # bounded: one block of the stated queries
        own = ready.filter(asked).filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((own, longest))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, longest = sent.value

            def read(t) -> tuple[np.ndarray, np.ndarray]:
                if not t.num_rows:
                    return np.empty(0, np.int64), np.empty((0, width), np.int64)
                v = t.column("v")
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                return t.column("id").to_numpy(), _matrix(v, width)

            queries = Queries(*read(own), k)
            if not len(queries.ids):
                return
            ids, found = read(longest)
            for i in range(0, len(ids), BUCKET):
                queries.visit(ids[i : i + BUCKET], found[i : i + BUCKET])
            queries.settle()
            queries.found, queries.size = [], 0  # they come again in their own place
            held: list = []

            def take() -> None:
                if held:
                    queries.visit(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held.clear()

            for batch in batches:
                ids = batch.column("id").to_numpy()
                held.append((ids, _matrix(batch.column("v"), width)))
                if sum(len(h[0]) for h in held) >= BUCKET:
                    take()
            take()
            row, ids, score = queries.settle()
            for i in range(0, len(row), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries.ids[row[part]]), pa.array(ids[part]), pa.array(score[part])], ["query_id", "vec_id", "score"]
                )

        return ready.select("id", "v").mapInArrow(search, "query_id long, vec_id long, score long")

    found = reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


# The same in SQL, product by product.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""
