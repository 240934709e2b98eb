"""Nearest vectors by inner product: a block matrix join over int8 tiles with error bounds.

Queries and candidates are dealt into groups; each pair of groups is a tile of one task. In a tile the products of
the int8 codes give every score up to a bound known from the rounding errors. Only pairs whose upper bound reaches
the k-th best lower bound of their query are recomputed from the original vectors in double precision, so
nothing is lost. The best k per query and tile are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_GROUP = 16_384   # queries of a tile at most, on average
BASE_GROUP = 65_536    # candidates of a tile at most, on average
ROWS_AT_ONCE = 2_000_000  # scores of a tile that are in memory together

_PAIR = "query_id long, dim int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32, in which their products are exact), scales, norms, norms of code and of error."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # components too small to divide: the error bound is the vector itself
    codes = np.rint(x / scale[:, None])
    error = x - codes * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return codes.astype(np.float32), scale, norm(x), norm(codes) * scale, norm(error)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up component by component."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows without exact repetitions, and how often an id occurs among them at most."""
    if len(np.unique(ids)) == len(ids):
        return ids, x, 1
    keys = np.column_stack([ids.view(np.float64), x]).view([("", np.float64)] * (x.shape[1] + 1)).ravel()
    _, at = np.unique(keys.view(np.dtype((np.void, keys.dtype.itemsize))), return_index=True)
    return ids[at], x[at], int(np.unique(ids[at], return_counts=True)[1].max())


def best_in_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score): the ``k`` best candidates of every query, its own id left out, ties to smaller ids.

    An id with several vectors takes several places, so there are as many more of them.
    """
    q_ids, q, _ = _once(q_ids, q)
    c_ids, c, copies = _once(c_ids, c)
    k *= copies
    qc, qs, qn, qcn, qe = _coded(q)
    cc, cs, cn, ccn, ce = _coded(c)
    step = max(1, ROWS_AT_ONCE // max(1, len(c)))
    for at in range(0, len(q), step):
        to = min(len(q), at + step)
        dots = (qc[at:to] @ cc.T).astype(np.float64)
        near = dots * qs[at:to, None] * cs[None, :]
        # |x.y - x'.y'| <= |x - x'| |y'| + |x| |y - y'|; the factor covers the rounding of this line itself.
        slack = (qe[at:to, None] * ccn[None, :] + qn[at:to, None] * ce[None, :]) * (1 + 1e-6) + 1e-12 * qn[at:to, None] * cn[None, :]
        own = q_ids[at:to, None] == c_ids[None, :]
        low = np.where(own | np.isnan(slack) | np.isnan(near), -np.inf, near - slack)
        rank = min(k, low.shape[1])
        floor = np.partition(low, low.shape[1] - rank, axis=1)[:, low.shape[1] - rank]
        rows, cols = np.nonzero(~(near + slack < floor[:, None]) & ~own)
        exact = _products(q[at:to][rows], c[cols])
        order = np.lexsort((c_ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, np.arange(to - at))
        keep = np.arange(len(rows)) - first[rows] < k
        yield from zip(q_ids[at:to][rows[keep]].tolist(), c_ids[cols[keep]].tolist(), exact[keep].tolist())


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates with the largest inner product for each query row.

    ``queries`` picks the query rows; every usable row but those of the query's own id is a candidate. Ties go to
    the smaller id. Rows with an unusable vector or a null id take no part, vectors meet those of their own length
    only, and of rows that share an id the copies of one vector count once, of different vectors the best.
    A query without candidates has no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_groups = max(1, -(-asked // QUERY_GROUP))
    # Candidates are dealt finer while tiles are fewer than tasks.
    c_groups = max(1, -(-total // BASE_GROUP), min(-(-tasks // q_groups), -(-total // 256)))

    def dealt(groups: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).cast("int")

    def all_of(groups: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    left = rows.where("q").select("id", "v", "dim", dealt(q_groups, 1).alias("qg")).withColumn("cg", all_of(c_groups))
    right = rows.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.col("dim").alias("c_dim"),
                        dealt(c_groups, 2).alias("c_cg")).withColumn("c_qg", all_of(q_groups))

    def tile(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        dim = 0
        if lt.num_rows and rt.num_rows:
            dim = lt.column("dim")[0].as_py()
            found = list(best_in_tile(lt.column("id").to_numpy(), _matrix(lt.column("v"), dim),
                                      rt.column("c_id").to_numpy(), _matrix(rt.column("c_v"), dim), k))
        ids, others, scores = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "dim": pa.array([dim] * len(ids), pa.int32()),
                         "vec_id": pa.array(others, pa.int64()), "score": pa.array(scores, pa.float64())})

    tiles = right.groupBy("c_dim", "c_qg", "c_cg")
    parts = left.groupBy("dim", "qg", "cg").cogroup(tiles).applyInArrow(tile, _PAIR)

    def merge(pairs: pa.Table) -> pa.Table:
        # At most k rows of each tile of one query; a heap of the k best takes them in.
        heap: list[tuple[float, int]] = []
        seen: dict[int, float] = {}
        for v, s in zip(pairs.column("vec_id").to_pylist(), pairs.column("score").to_pylist()):
            seen[v] = max(s, seen.get(v, s))
        for v, s in seen.items():
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
        best = sorted(heap, reverse=True)
        q = pairs.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([q] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                         "vec_id": pa.array([-v for _, v in best], pa.int64()), "score": pa.array([s for s, _ in best], pa.float64())})

    return parts.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
