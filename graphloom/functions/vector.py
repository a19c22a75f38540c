"""Distances of vectors (lists of numbers of equal length), and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

#: Vectors and queries of a task, queries that it takes at a time, and pairs whose exact scores it works out at a time.
BLOCK, QUERIES, CHUNK, PAIRS = 16384, 4096, 64, 16384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def _total(terms: Callable[[int], np.ndarray], dims: int, rows: int) -> np.ndarray:
    """Terms summed from the first dimension to the last, as dot() and l2_distance() do."""
    total = np.zeros(rows)
    for k in range(dims):
        total += terms(k)
    return total


def _first(rows: np.ndarray, k: int, *group: np.ndarray) -> np.ndarray:
    """The first k of the sorted rows of each group."""
    new = np.ones(len(rows), bool)
    new[1:] = np.any([g[rows[1:]] != g[rows[:-1]] for g in group], axis=0)
    return rows[np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) < k]


def _best(query: np.ndarray, code: np.ndarray, score: np.ndarray, k: int, cosine: bool, digits: int | None) -> np.ndarray:
    """Places of each query's k best pairs, by rounded score and id; of scores that may be rounded either way k each stay too."""
    low = high = score
    if digits is not None:
        low, high = (np.floor(score * 10.0**digits + 0.5 + d) for d in (-1e-6, 1e-6))
    sure = (low == high) | np.isnan(score)
    order = np.lexsort((code, np.where(np.isnan(score), -np.inf, -low) if cosine else low, query))
    kept = _first(order[sure[order]], k, query)
    order = np.lexsort((code, score, query))
    return np.concatenate([kept, _first(order[~sure[order]], k, query, score)])


def _pairs(x: np.ndarray, y: np.ndarray, mine: np.ndarray, code: np.ndarray, k: int, cosine: bool, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, score) of what may be among the k nearest rows of y, with other codes, of each row of x.

    A matrix product finds the pairs that can be, with room for its rounding; their scores are then summed in order.
    """
    step = 1e-9 + (0 if digits is None else 1.1 * 10.0**-digits)
    with np.errstate(all="ignore"):
        xx, yy = (_total(lambda j, z=z: z[:, j] * z[:, j], z.shape[1], len(z)) for z in (x, y))
        if cosine:
            near = (x / np.sqrt(xx)[:, None]) @ (y / np.sqrt(yy)[:, None]).T
        else:
            near = 2 * x @ y.T - xx[:, None] - yy
        same, odd = mine[:, None] == code, np.isnan(near)
        near[same | odd] = -np.inf
        least = np.full(len(x), -np.inf) if len(y) <= k else np.partition(near, len(y) - k, axis=1)[:, len(y) - k]
        if cosine:
            least = least - step
        else:  # squares: the k-th distance and a step, and what the product may be off
            off = 1e-13 * (2 + x.shape[1]) * (xx + np.max(yy, initial=0.0))
            least = -((np.sqrt(np.maximum(-least + off, 0)) + step) ** 2) - off
        a, b = np.nonzero((~(near < least[:, None]) | odd) & ~same)
        score = np.zeros(len(a))
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            p, q = x[i], y[j]
            if cosine:
                score[at : at + PAIRS] = _total(lambda d: p[:, d] * q[:, d], x.shape[1], len(i)) / (np.sqrt(xx[i]) * np.sqrt(yy[j]))
            else:
                score[at : at + PAIRS] = np.sqrt(_total(lambda d: (p[:, d] - q[:, d]) ** 2, x.shape[1], len(i)))
        some = _best(a, code[b], score, k, cosine, digits)
    return a[some], b[some], score[some]


def _search(k: int, cosine: bool, digits: int | None) -> Callable[[pa.Table], pa.Table]:
    """(query, id, score): what may be among the k nearest of each query of a block, of the vectors of a block."""

    def search(table: pa.Table) -> pa.Table:
        ids, values = table.column("id").combine_chunks(), table.column("v").combine_chunks()
        asks = table.column("asks").to_numpy()
        code = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        size = pc.fill_null(pc.list_value_length(values), 0).to_numpy().astype(np.int64)
        flat, ends = values.flatten(), np.cumsum(size)
        known = pc.is_valid(values).to_numpy(zero_copy_only=False).copy()
        known[np.searchsorted(ends, np.flatnonzero(pc.is_null(flat).to_numpy(zero_copy_only=False)), side="right")] = False
        flat = pc.fill_null(flat, 0).to_numpy()

        def rows(at: np.ndarray, dims: int) -> np.ndarray:
            return flat[(ends[at] - dims)[:, None] + np.arange(dims)].astype(np.float64)

        if cosine:
            for dims in np.unique(size[known]):
                at = np.flatnonzero(known & (size == dims))
                known[at] = (rows(at, dims) ** 2).sum(axis=1) != 0
        size = np.where(known, size, -1)  # vectors without a score with any other
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        for dims in np.unique(size[asks]):
            q, v = np.flatnonzero(asks & (size == dims)), np.flatnonzero(~asks & (size == dims) & known)
            rest = np.flatnonzero(~asks & ((size != dims) | ~known))
            rest, y = rest[np.argsort(code[rest], kind="stable")], rows(v, max(dims, 0))
            for at in range(0, len(q), CHUNK):
                some = q[at : at + CHUNK]
                a, b, score = _pairs(rows(some, max(dims, 0)), y, code[some], code[v], k, cosine, digits)
                found.append((some[a], v[b], score, np.zeros(len(a), bool)))
                for i in some[np.bincount(a, minlength=len(some)) < k] if len(rest) else ():
                    last = rest[code[rest] != code[i]][:k]
                    found.append((np.full(len(last), i), last, np.zeros(len(last)), np.ones(len(last), bool)))
        a, b, score, none = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": ids.take(pa.array(a)), "id": ids.take(pa.array(b)), "score": pa.array(score, mask=none, from_pandas=False)})

    return search


def nearest(queries: DataFrame, vectors: DataFrame, id: str, vector: str, k: int, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """(query, id, score, rank): each query's k nearest other vectors; ties by id, without a score last.

    With ``digits``, scores are rounded before they are ranked.  Exact: every query meets every vector, so the work
    is the product of their numbers.  It is dealt in blocks of QUERIES queries and BLOCK vectors; a block's matrix
    product finds the k best of each query and what may be rounded to the same, and these alone leave it.
    """
    v = F.col(vector)
    if not isinstance(vectors.schema[vector].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    rows = [df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), v.alias("v")) for df in (vectors, queries)]
    blocks = [df.agg(F.greatest(F.ceil(F.count("*") / n), F.lit(1)).cast("int").alias(name)) for df, n, name in zip(rows, (BLOCK, QUERIES), "mn")]
    both = F.broadcast(blocks[0].crossJoin(blocks[1]))

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """Every row in a block of its own kind, once for each block of the other."""
        own, other, block, all_ = ("j", "i", "n", "m") if asks else ("i", "j", "m", "n")
        df = df.crossJoin(both).withColumn(own, F.pmod(F.xxhash64("id"), F.col(block)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1)))
        return df.select("i", "j", F.lit(asks).alias("asks"), "id", "v")

    kind = rows[0].schema["id"].dataType
    schema = StructType([StructField("query", kind), StructField("id", kind), StructField("score", DoubleType())])
    out = dealt(rows[0], False).unionByName(dealt(rows[1], True)).groupBy("i", "j").applyInArrow(_search(k, metric == "cosine", digits), schema)
    score = F.col("score") if digits is None else F.round("score", digits)
    best = F.desc("score") if metric == "cosine" else F.asc_nulls_last("score")
    out = out.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(best, "id"))).where(F.col("rank") <= k)
    return out.select("query", F.col("id").alias(id), "score", "rank")
