"""Exact top-k by inner product with a pivot-distance index.

Pivots are fitted on a bounded sample. Every vector is keyed by its nearest
pivot and its distance r to it; sorted by that key, consecutive vectors of a
pivot form annuli. An annulus knows its vectors' largest norm and, for every
pivot, their range of distances. For a query q at distance d from a pivot, the
triangle inequality bounds the distance to every vector of the annulus from
below by the gap between d and that range; the largest gap over all pivots
counts. So the inner product is bounded from above in two ways (p and r: the
annulus' own pivot and distances to it):

    q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2  <=  (|q|^2 + max|v|^2 - gap^2) / 2
    q.v = q.p + q.(v - p)                  <=  q.p + |q| * max r

First each block of queries is scored against the annuli of best bound until
they hold k vectors and more; that gives each query a k-th best score so far.
Then every other annulus whose bound reaches that score is scored too. What is
left out cannot reach the result, which is therefore exact.

Vectors become floor(64 * x). Those that are null, empty or hold a null or
non-finite component take no part; a component that a shorter vector lacks
counts as 0. Products are exact while every sum stays below 2**53. Ties go to
the smaller id; rows that repeat an id are each candidates, and rows that repeat
a query's id are one query, whose list holds the best of all of them; null ids
take no part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import map_arrow, narrow
from fieldloom.runtime import materialise

#: Bound of the sample that pivots are fitted on, pivots, vectors in an annulus, queries in a block.
FIT_ROWS, PIVOTS, ANNULUS, QUERIES = 4096, 48, 1024, 256
SCALE, K, EVERY = 64, 20, 20
#: Shares that the annuli of a pivot are dealt in, so that pivots don't limit the number of tasks.
SHARDS = 16
#: Rounding allowed for in the bounds.
SLACK = 1e-6


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: the usable vectors as integers."""
    x = F.transform(F.col("x"), lambda c: F.floor(c.cast("double") * SCALE))
    ok = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    base = narrow(table, id_col, vector_col).toDF("id", "x")
    return base.where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))).select("id", x.alias("v"))


def padded(data: DataFrame) -> tuple[DataFrame, int]:
    """``data`` with all vectors as long as the longest one, and that length."""
    dim = data.agg(F.max(F.size("v"))).first()[0] or 0
    return data.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")), dim


def fit_pivots(data: DataFrame, pivots: int = PIVOTS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Pivots by farthest-first traversal of at most ``fit_rows`` vectors of one length, chosen by a hash of the id."""
    rows = data.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0)
    at = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(pivots, len(x)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
    # A few rounds of k-means move pivots from the rim into the mass.
    centres = x[at]
    for _ in range(5):
        own = nearest(x, centres)[0]
        centres = np.array([x[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of x to each pivot, summed difference by difference, so that small ones are exact."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    at = d2.argmin(axis=1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as 16-bit ones where they fit, else as doubles."""
    return (x.astype(np.int16) if not x.size or np.abs(x).max() < 1 << 15 else x).tobytes()


def unpack(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * dim * n else np.float64).reshape(n, dim).astype(np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()].to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def keyed(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, pivot and dist of every vector."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("pivot", pa.int32()), ("dist", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                at, d = nearest(x, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(r) for r in x], pa.binary()), pa.array(at.astype(np.int32)), pa.array(d)], schema=schema)

    return map_arrow(data, kernel, "id long, v binary, pivot int, dist double")


def packed(rows: DataFrame, size: int, pivots: np.ndarray) -> DataFrame:
    """Rows in the order of (pivot, dist, id) cut into blocks of one pivot and at most ``size`` vectors.

    Columns: block, pivot, n, low and high (least and largest distance to every pivot), top (largest norm), ids and data (bytes).
    """
    schema = pa.schema([("block", pa.string()), ("pivot", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("top", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())])
    dim = pivots.shape[1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            x = np.concatenate([unpack(h[1], dim, 1) for h in held])
            d = distances(x, pivots)
            row = (f"{part}-{number}", held[0][2], len(held), d.min(axis=0).tobytes(), d.max(axis=0).tobytes(), float(np.sqrt((x**2).sum(axis=1).max())), np.array([h[0] for h in held], dtype=np.int64).tobytes(), pack(x))
            return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (row[2] != held[0][2] or len(held) >= size):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    order = ["pivot", "dist", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(ranged, kernel, "block string, pivot int, n int, low binary, high binary, top double, ids binary, data binary")


def bounds(x: np.ndarray, d: np.ndarray, pivot: np.ndarray, at: int, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
    """For each query (row of x, with its distances d to all pivots), the most that its inner product with a vector of the annulus can be."""
    norm = np.sqrt((x**2).sum(axis=1))
    gap = np.maximum(0, np.maximum(low - d, d - high).max(axis=1))
    best = np.minimum((norm**2 + top**2 - gap**2) / 2, x @ pivot + norm * high[at])
    best = np.minimum(best, norm * top)
    return best + SLACK * (1 + np.abs(best))


def best_of(ids: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """For each query, its k best (score, then smaller id), itself left out."""
    for i, q in enumerate(ids):
        s, other = score[i], vec != q
        pick = np.flatnonzero(other)
        if len(pick) > k:
            least = np.partition(s[pick], len(pick) - k)[len(pick) - k]
            pick = pick[s[pick] >= least]
        for j in pick[np.lexsort((vec[pick], -s[pick]))][:k]:
            yield int(q), int(vec[j]), int(s[j])


def scored(pairs: DataFrame, queries: DataFrame, annuli: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: the k best of every query in each pair (qblock, block)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, vi, vx in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                qids, vids = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                score = unpack(qx, dim, len(qids)) @ unpack(vx, dim, len(vids)).T
                rows = list(best_of(qids, vids, np.rint(score).astype(np.int64), k))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    left = queries.select("qblock", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    right = annuli.select("block", "ids", "data")
    full = pairs.select("qblock", "block").join(left.hint("merge"), "qblock").join(right.hint("merge"), "block").select("qids", "qdata", "ids", "data")
    return map_arrow(full, kernel, "query_id long, vec_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def candidates(queries: DataFrame, annuli: DataFrame, pivots: np.ndarray) -> DataFrame:
    """qblock, block, n and, for each query of the block, its bound: every block of queries with every annulus of each pivot.

    The pivots are a list of fixed length and the annuli of each are dealt in
    SHARDS, so queries meet annuli by an equi-join on both.
    """
    schema = pa.schema([("qblock", pa.string()), ("block", pa.string()), ("n", pa.int32()), ("most", pa.float64()), ("bounds", pa.list_(pa.float64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            last, x, d = None, None, None
            for qblock, data, m, block, pivot, n, low, high, top in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if qblock != last:
                    last, x = qblock, unpack(data, dim, m)
                    d = distances(x, pivots)
                b = bounds(x, d, pivots[pivot], pivot, np.frombuffer(low), np.frombuffer(high), top)
                out.append((qblock, block, n, float(b.max()), b.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dim = pivots.shape[1]
    every = F.explode(F.sequence(F.lit(0), F.lit(len(pivots) * SHARDS - 1))).alias("deal")
    rings = annuli.select("block", "pivot", "n", "low", "high", "top", (F.col("pivot") * SHARDS + F.pmod(F.xxhash64("block"), F.lit(SHARDS))).cast("int").alias("deal"))
    dealt = rings.select("deal").distinct()
    each = queries.select("qblock", every).join(dealt.hint("broadcast"), "deal", "left_semi")
    full = each.join(rings.hint("merge"), "deal").join(queries.select("qblock", "data", F.col("n").alias("m")).hint("merge"), "qblock").select("qblock", "data", "m", "block", "pivot", "n", "low", "high", "top")
    return map_arrow(full, kernel, "qblock string, block string, n int, most double, bounds array<double>")


def search(table: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, fit_rows: int = FIT_ROWS, annulus: int = ANNULUS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, its k best among all others."""
    spark = table.sparkSession
    data, dim = padded(vectors(table, id_col, vector_col))
    centres = fit_pivots(data, pivots, fit_rows)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialise(keyed(data, centres), "keyed")
    annuli = materialise(packed(rows, annulus, centres), "annuli")
    queries = materialise(packed(rows.where(F.col("id") % every == 0), QUERIES, centres).withColumnRenamed("block", "qblock"), "queries")
    found = materialise(candidates(queries, annuli, centres), "bounds")
    # The annuli of best bound, until they hold k vectors besides the query itself.
    order = Window.partitionBy("qblock").orderBy(F.desc("most"), "block").rowsBetween(Window.unboundedPreceding, -1)
    begun = materialise(found.select("qblock", "block", "n", "most").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") <= 2 * k).select("qblock", "block"), "first")
    start = materialise(best(scored(begun, queries, annuli, k, dim), k).select("query_id", "vec_id", "score"), "scores")
    reached = start.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("got")).select("query_id", F.when(F.col("got") >= k, F.col("least")).alias("least"))
    more = materialise(still_open(found, queries, reached, begun), "more")
    rest = scored(more, queries, annuli, k, dim)
    return best(start.union(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def still_open(found: DataFrame, queries: DataFrame, reached: DataFrame, begun: DataFrame) -> DataFrame:
    """Pairs not yet scored in which some query's bound reaches its k-th best score so far."""
    ids = queries.select("qblock", "ids", "n")
    schema = pa.schema([("qblock", pa.string()), ("at", pa.int32()), ("query_id", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                each = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(each)), pa.array(np.arange(len(each), dtype=np.int32)), pa.array(each)], schema=schema)

    single = map_arrow(ids.select("qblock", "ids"), kernel, "qblock string, at int, query_id long")
    floors = single.join(reached.hint("merge"), "query_id", "left").groupBy("qblock").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least")))), lambda s: s["least"]).alias("floors"))
    open_ = F.exists(F.arrays_zip(F.col("bounds"), F.col("floors")), lambda z: z["bounds"] >= z["floors"])
    return found.join(floors.hint("merge"), "qblock").where(open_).select("qblock", "block").join(begun.hint("merge"), ["qblock", "block"], "left_anti")
