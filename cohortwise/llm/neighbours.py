"""Nearest neighbours by inner product: an exact block matrix join on int8 codes.

Vectors are quantised to 8 bits with a scale of their own, x = s * q + e. For a query and a candidate

    |x . y - s_x s_y (q_x . q_y)|  <=  |e_x| |y| + |s_x q_x| |e_y|

so a tile of integer products bounds every inner product from both sides. Queries are dealt to
blocks and candidates to stripes; a (block, stripe) pair is a tile, to which Spark brings both sides.
A task reads the queries of its tile and then streams the candidates. Pairs whose upper bound does
not reach the query's K-th best so far, or the K-th largest lower bound in the product, are dropped;
the rest are computed in double precision from the original vectors and kept in a heap of K per
query. The heaps of a query's tiles are merged. Nothing is lost: the result is exact, not sampled.

Candidates are copied once per query block, so blocks are large; there are only as many stripes as
it takes to occupy the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import arrow_map

NEIGHBOURS = 20
QUERY_BLOCK = 8_192
TILE_QUERIES = 1_024
STRIPES_PER_SLOT = 2
MANTISSA = 1_024
"""Products of 8-bit codes of that many components are sums that 32-bit floats hold exactly."""


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without vectors that are NULL, empty, zero or hold a NULL or non-finite component.

    A vector id that several rows have stands for the smallest of their vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.filter(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite} AND exists(embedding, x -> x <> 0)")
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers from -127 to 127), scales, and norms of code part and rest, rounded up."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None])
    part = codes * scale[:, None]
    slack = 1 + 1e-9
    size = np.abs(x).max(axis=1, initial=0)  # norms of scaled vectors, so squares stay in range
    unit = np.where(size > 0, size, 1)[:, None]
    inner = np.linalg.norm(part / unit, axis=1) * unit[:, 0] * slack
    rest = np.linalg.norm((x - part) / unit, axis=1) * unit[:, 0] * slack + inner * 1e-12
    return codes.astype(np.int8), scale, inner, rest


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, by BLAS on floats that hold every partial sum."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], MANTISSA):
        out += a[:, k : k + MANTISSA].astype(np.float32) @ b[:, k : k + MANTISSA].astype(np.float32).T
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise, component after component, so equal vectors have equal products."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Heaps:
    """The K best candidates of each query: scores descending, then ids ascending; empty places have id -1."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, neighbours: int):
        self.ids, self.vectors, self.k = ids, vectors, neighbours
        self.codes, self.scale, self.inner, self.rest = quantise(vectors)
        self.scores = np.full((len(ids), neighbours), -np.inf)
        self.found = np.full((len(ids), neighbours), -1, np.int64)
        self.known = np.zeros((len(ids), neighbours), bool)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes, scale, inner, rest = quantise(vectors)
        for start in range(0, len(self.ids), TILE_QUERIES):
            own = slice(start, start + TILE_QUERIES)
            with np.errstate(over="ignore", invalid="ignore"):
                middle = code_products(self.codes[own], codes) * self.scale[own, None] * scale
                error = self.rest[own, None] * (inner + rest) + self.inner[own, None] * rest
                error = error + np.abs(middle) * 1e-12
                upper, lower = middle + error, middle - error
            other = self.ids[own, None] != ids
            lower = np.where(other & ~np.isnan(lower), lower, -np.inf)
            kth = self.scores[own, -1]
            if lower.shape[1] >= self.k:
                kth = np.maximum(kth, -np.partition(-lower, self.k - 1, axis=1)[:, self.k - 1])
            q, c = np.nonzero(other & ~(upper < kth[:, None]))  # overflowed bounds are kept
            self._merge(q + start, ids[c], self._exact(q + start, vectors, c))

    def _exact(self, q: np.ndarray, vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for k in range(0, len(q), 65_536):
            part = slice(k, k + 65_536)
            out[part] = inner_products(self.vectors[q[part]], vectors[c[part]])
        return out

    def _merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        old_q = np.repeat(touched, self.k)
        old = self.known[touched].ravel()
        q = np.r_[q, old_q[old]]
        ids = np.r_[ids, self.found[touched].ravel()[old]]
        scores = np.r_[scores, self.scores[touched].ravel()[old]]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        self.known[touched] = False
        self.scores[touched] = -np.inf
        self.scores[q[keep], rank[keep]] = scores[keep]
        self.found[q[keep], rank[keep]] = ids[keep]
        self.known[q[keep], rank[keep]] = True

    def rows(self) -> dict:
        q, rank = np.nonzero(self.known)
        return {"query_id": self.ids[q], "vec_id": self.found[q, rank], "score": self.scores[q, rank]}


def _tile_best(batches: Iterator[pa.RecordBatch], neighbours: int) -> Iterator[dict]:
    """Rows come sorted by tile, queries of a tile before its candidates."""
    tile, queries, heaps = None, [], None
    for batch in batches:
        tiles = batch.column("tile").to_numpy()
        side = batch.column("candidate").to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy()
        lists = batch.column("embedding")
        flat, width = lists.flatten().to_numpy(), batch.column("width").to_numpy()
        offsets = np.r_[0, np.cumsum(width)]
        cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(tiles)], strict=True):
            if tiles[a] != tile:
                if heaps is not None:
                    yield heaps.rows()
                tile, queries, heaps = tiles[a], [], None
            vectors = flat[offsets[a] : offsets[b]].reshape(b - a, -1)  # a tile has one width
            if not side[a]:
                queries.append((ids[a:b], vectors))
                continue
            if heaps is None and queries:
                heaps = Heaps(*(np.concatenate(x) for x in zip(*queries, strict=True)), neighbours)
            if heaps is not None:
                heaps.offer(ids[a:b], vectors)
    if heaps is not None:
        yield heaps.rows()


def nearest(vectors: DataFrame, query_filter: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The `neighbours` candidates of largest inner product of every query: (query_id, rank, vec_id, score).

    Queries are the rows of `vectors` (vec_id, embedding) that meet `query_filter`; candidates are all
    rows with another id and as many components. Nearest first, equal scores by smaller vec_id.
    Unusable vectors take no part (see `usable`); no usable query gives no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors).withColumn("width", F.size("embedding"))
    queries = good.filter(query_filter)
    blocks = 1 + vectors.filter(query_filter).count() // QUERY_BLOCK
    stripes = max(1, -(-STRIPES_PER_SLOT * spark.sparkContext.defaultParallelism // blocks))
    # a tile's number holds block, stripe and width, as products need equal widths
    block = F.expr(f"pmod(xxhash64(vec_id, 1), {blocks})")
    stripe = F.expr(f"pmod(xxhash64(vec_id, 2), {stripes})")
    left = queries.select(
        "vec_id", "embedding", "width", F.lit(False).alias("candidate"),
        block.alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("__s"),
    )
    right = good.select(
        "vec_id", "embedding", "width", F.lit(True).alias("candidate"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__b"), stripe.alias("__s"),
    )
    both = left.unionByName(right).withColumn("tile", F.expr(f"(width * {blocks}L + __b) * {stripes}L + __s"))
    dealt = both.repartition(blocks * stripes, "tile").sortWithinPartitions("tile", "candidate", "vec_id")
    best = arrow_map(
        dealt.select("tile", "candidate", "vec_id", "width", "embedding"),
        lambda batches: _tile_best(batches, neighbours),
        "query_id long, vec_id long, score double",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
