"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order.  It is posted to the inverted lists of the
first few of them alone.  Vectors that meet in a list and share enough pivots are candidates, and a cosine in double
precision decides.  Lists are cut into blocks of bounded size and every pair of blocks is one task, so a list
that holds a third of all vectors is many small tasks; a task returns counts and a spanning forest, not pairs.

A list holds PREFIX * n / p of n vectors, so with p pivots the lists pair up PREFIX^2 / p of what a comparison of all
vectors would; p grows with the square root of n, the work with its power of 1.5.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.shared import discard, stored
from graphloom.llm.simhash import _stars

#: Pivots: twice the square root of the number of vectors, within these bounds; how they are sampled.
LEAST_PIVOTS, MOST_PIVOTS = 128, 8192
OVERSAMPLE, APART = 4, 0.8
#: Nearest pivots that describe a vector, how many of them it is posted to, and how many a candidate shares.
NEAREST, PREFIX, SHARED = 12, 4, 3
#: Vectors of a block, and those of one side that a task compares at a time.
BLOCK, CHUNK = 2048, 256


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components, not all zero."""
    v = F.col(vector)
    clean = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(clean, F.lit(False)))


def _apart(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the sampled unit vectors, in their order.

    A vector near a pivot (cosine of APART or more) is passed over, so that a group of near copies has one pivot,
    however large a share of the vectors it is.  Where fewer than NEAREST lie apart, sampled vectors that were passed
    over fill up to as many: each time the one whose largest cosine to the chosen ones is smallest.
    """
    free, chosen = np.ones(len(x), bool), []
    while free.any() and len(chosen) < count:
        i = int(np.argmax(free))
        chosen.append(i)
        free &= x @ x[i] < APART
        free[i] = False
    near = (x @ x[chosen].T).max(axis=1)
    near[chosen] = np.inf
    while len(chosen) < min(NEAREST, len(x)):
        i = int(np.argmin(near))
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
        near[i] = np.inf
    return x[chosen]


def choose_pivots(reps: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """Reference points of each length of vectors, from a sample of distinct vectors that depends on their values alone.

    About OVERSAMPLE vectors for each pivot wanted, those of the smallest hashes, come to the driver; _apart() chooses.
    """
    size = F.size(vector)
    lengths = {r["d"]: r["count"] for r in reps.groupBy(size.alias("d")).count().collect()}
    if not lengths:
        return {}
    wanted = {d: max(LEAST_PIVOTS, min(MOST_PIVOTS, 2 * math.isqrt(n))) for d, n in lengths.items()}
    # a hash is as likely to be under any bound as the bound is high; some more than wanted pass
    bound = F.create_map(*(F.lit(x) for d, n in lengths.items() for x in (d, min(1.0, (1.2 * OVERSAMPLE * wanted[d] + 50) / n))))
    place = (F.xxhash64(vector) / F.lit(2.0**64)) + 0.5
    sample = reps.where(place <= F.element_at(bound, size)).select(F.col(vector).alias("v"), F.xxhash64(vector).alias("h")).toArrow()
    values, h = sample.column("v").combine_chunks(), sample.column("h").to_numpy()
    own = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    pivots = {}
    for d in sorted(lengths):
        at = np.flatnonzero(own == d)
        if len(at):
            x = _matrix(values.take(pa.array(at)))
            order = np.lexsort((*x.T[::-1], h[at]))[: OVERSAMPLE * wanted[d]]
            pivots[d] = _apart(_unit(x[order]), wanted[d])
    return pivots


def with_permutation(reps: DataFrame, pivots: dict[int, np.ndarray], vector: str, nearest: int = NEAREST, prefix: int = PREFIX) -> DataFrame:
    """Adds ``perm``, the numbers of the nearest pivots of the vector's length by cosine, nearest first (ties: the
    smaller number), and ``lists``, how many of them it is posted to.

    Where there are no more pivots than ``nearest``, that is over half of them, so that any two vectors meet.
    """
    place, names = reps.columns.index(vector), [*reps.columns, "perm", "lists"]
    first, total = {}, 0
    for d, x in pivots.items():
        first[d] = total
        total += len(x)

    def run(batches):
        for b in batches:
            size = pc.list_value_length(b.column(place)).to_numpy(zero_copy_only=False)
            perm, lists = np.full((b.num_rows, nearest), -1, np.int32), np.zeros(b.num_rows, np.int32)
            for d in np.unique(size).tolist():
                own = pivots[d]
                k = min(nearest, len(own))
                for rows in np.array_split(at := np.flatnonzero(size == d), -(-len(at) // 4096)):
                    cosine = _unit(_matrix(b.column(place).take(pa.array(rows)))) @ own.T
                    perm[rows, :k] = first[d] + np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                lists[size == d] = prefix if len(own) > nearest else k // 2 + 1
            offsets = np.concatenate(([0], np.cumsum((perm >= 0).sum(axis=1)))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(perm[perm >= 0]))
            yield pa.RecordBatch.from_arrays([*b.columns, column, pa.array(lists)], names=names)

    schema = reps.withColumns({"perm": F.lit(None).cast("array<int>"), "lists": F.lit(None).cast("int")}).schema
    return reps.mapInArrow(run, schema)


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b`` (rows: different pivot numbers), by b's inverted lists."""
    order = np.argsort(b, axis=None, kind="stable")
    pivots, rows = b.ravel()[order], order // b.shape[1]
    low, high = (np.searchsorted(pivots, a.ravel(), side) for side in ("left", "right"))
    n = high - low
    post = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    cell = np.repeat(np.arange(a.size) // a.shape[1] * len(b), n) + rows[post]
    return np.bincount(cell, minlength=len(a) * len(b)).reshape(len(a), len(b))


def _block_pair(least: float, shared: int):
    """The task of one pair of blocks of one pivot's list."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pivot, left, right = (k.as_py() for k in key)
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        rid, w = table.column("rid").to_numpy()[order], table.column("w").to_numpy()[order]
        x = _unit(_matrix(table.column("vec").combine_chunks()))[order]
        perm = _matrix(table.column("perm").combine_chunks(), np.int64)[order]
        # pivots of the places that a vector is posted to; later ones never match
        head = perm[:, : table.column("lists")[0].as_py()]
        n = int((block == left).sum())
        to = 0 if left == right else n
        links, star_a, star_b = np.zeros(len(rid)), [], []
        for at in range(0, n, CHUNK):
            rows = slice(at, min(at + CHUNK, n))
            near = shared_counts(perm[rows], perm[to:]) >= min(shared, perm.shape[1])
            if left == right:
                near = np.triu(near, at + 1)
            i, j = np.nonzero(near)
            i, j = i + at, j + to
            if len(i) * 8 > near.size:
                linked = (x[rows] @ x[to:].T)[i - at, j - to] >= least
            else:
                linked = np.zeros(len(i), bool)
                for k in range(0, len(i), 1 << 13):
                    part = slice(k, k + (1 << 13))
                    linked[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= least
            i, j = i[linked], j[linked]
            # a pair counts in the list of the smallest pivot that both are posted to
            again = np.zeros(len(i), bool)
            for p in range(head.shape[1]):
                own = head[i, p]
                again |= (own < pivot) & (head[j] == own[:, None]).any(axis=1)
            i, j = i[~again], j[~again]
            if len(i):
                links += np.bincount(i, w[j], len(rid)) + np.bincount(j, w[i], len(rid))
                far, root = _stars(i, j)
                star_a.append(far)
                star_b.append(root)
        star = np.arange(len(rid))
        if star_a:
            far, root = _stars(np.concatenate(star_a), np.concatenate(star_b))
            star[far] = root
        some = links > 0
        return pa.table({"rid": rid[some], "links": links[some].astype(np.int64), "star": rid[star[some]]})

    return run


def cosine_links(reps: DataFrame, vector: str = "vec", least: float = 0.9, nearest: int = NEAREST, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(rid, links, star) parts for distinct vectors (rid, w, vec): sums of linked weights, and a spanning forest of the links found.

    A row is sent once for every block of its lists; lists of up to BLOCK vectors are one block.
    """
    pivots = choose_pivots(reps, vector)
    if not pivots:
        return reps.sparkSession.createDataFrame([], "rid long, links long, star long")
    described = stored(with_permutation(reps.select("rid", "w", F.col(vector).alias("vec")), pivots, "vec", nearest, prefix), "perms")
    posted = described.withColumn("p", F.explode(F.slice("perm", F.lit(1), F.col("lists"))))
    # a row for every pivot, at most MOST_PIVOTS of a length
    blocks = posted.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    posted = posted.join(F.broadcast(blocks), "p").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    posted = posted.select("p", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "block", "rid", "w", "vec", "perm", "lists")
    parts = stored(posted.groupBy("p", "i", "j").applyInArrow(_block_pair(least, shared), "rid long, links long, star long"), "pairs")
    discard(described)
    return parts


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts the other rows linked directly (equal vectors are linked), component_id is the smallest id
    that links reach.  Rows without an id, and vectors that usable() leaves out, link with nothing; their
    component is their own id.  Vectors of different lengths do not link.  Rows that repeat an id each count as a
    vector.  Equal vectors are compared once.  Ties: a vector as near to two pivots takes the smaller number first,
    and a cosine of exactly ``least`` links.  An empty table gives no rows; further columns are not returned.
    """
    rows = vectors.select(F.col(id).alias(id), F.col(vector).alias("vec"))
    good = usable(rows.where(F.col(id).isNotNull()), "vec")
    reps = good.groupBy("vec").agg(F.count("*").alias("w"), F.min(id).alias("low")).withColumn("rid", F.monotonically_increasing_id())
    reps = stored(reps, "vectors")
    parts = cosine_links(reps, least=least)
    roots = connected_components(parts.select(F.col("rid").alias("a"), F.col("star").alias("b")))
    sums = parts.groupBy("rid").agg(F.sum("links").alias("links"))
    own = reps.join(sums, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rid"))
    lows = own.groupBy("root").agg(F.min("low").alias("component_id"))
    own = own.join(lows, "root").select(F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    own = stored(own, "vectors")
    for done in (reps, parts):
        discard(done)
    out = rows.join(own, (F.col("vec") == F.col("_vec")) & F.col(id).isNotNull(), "left")
    root = F.coalesce("component_id", id)
    return out.select(id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col(id) == root).alias("kept"))


def op7_pivotindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; nulls, ties, repeated rows and lengths as in near_vectors()."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
