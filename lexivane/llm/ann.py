"""Nearest neighbours by largest inner product over one-bit codes.

Candidates lie in slices of bounded size, queries in groups of bounded size; a task holds one slice and one group.
It estimates all inner products from the codes, takes for each query the best lower bounds as a bar, and computes
the exact inner product in double precision of those candidates only whose upper bound reaches the bar. The
nearest of all slices are then merged by a window per query. With bounds of four deviations practically no true
neighbour is lost; the number of candidates computed exactly is not limited.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivane.llm.bit_codes import encode, estimates, matrix, turned_units, usable

SLICE_ROWS = 1 << 17
GROUP_ROWS = 1 << 15
QUERY_BLOCK = 64


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, row by row, so that equal vectors give equal numbers."""
    return (vectors * query).sum(axis=1)


def nearest_in_slice(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Exact k nearest of one slice for every query: (query id, id, score), larger scores and smaller ids first."""
    codes = encode(vectors)
    spread = codes.spread()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(queries), QUERY_BLOCK):
        block = queries[i : i + QUERY_BLOCK]
        guess = estimates(codes, turned_units(block))
        high, low = (guess + spread) * codes.length, (guess - spread) * codes.length
        for row, (query_id, query) in enumerate(zip(query_ids[i : i + QUERY_BLOCK], block)):
            other = ids != query_id
            lows = low[row][other]
            bar = np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) > k else -np.inf
            near = np.flatnonzero(other & (high[row] >= bar))
            score = exact(vectors[near], query)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), query_id), ids[near][best], score[best]))
    return (np.concatenate(x) if out else np.zeros(0) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", slice_rows: int = SLICE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k nearest rows of ``df`` for every row of ``queries``: query_id, rank, vec_id, score.

    Nearness is the inner product, ties go to the smaller vec_id. A query never finds rows with its own id. Vectors
    that are null, empty, zero or hold null or non-finite numbers take no part on either side, nor do rows without
    an id; vectors of different dimensions never meet. With fewer than k candidates all are returned. Rows that
    share an id are candidates of their own; an id repeated among the queries is asked once.
    """
    slim = lambda x: usable(x.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec")), "vec").where("vec_id is not null")
    candidates, asked = slim(df), slim(queries).dropDuplicates(["vec_id"])
    n, m = candidates.count(), asked.count()
    slices = max(math.ceil(n / slice_rows), min(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1024)), 1)
    groups = max(1, math.ceil(m / group_rows))
    row = F.monotonically_increasing_id()
    placed = candidates.select("vec_id", "vec", F.size("vec").alias("d"), F.pmod(F.xxhash64("vec_id", row), F.lit(slices)).alias("slice"))
    placed = placed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    told = asked.select("vec_id", "vec", F.size("vec").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp"))
    told = told.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def find(own: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not own.num_rows or not asks.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, vectors = own["vec_id"].to_numpy(), matrix(own["vec"].combine_chunks())
        found = nearest_in_slice(ids, vectors, asks["vec_id"].to_numpy(), matrix(asks["vec"].combine_chunks()), k)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names)

    key = ("slice", "grp", "d")
    near = placed.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def every_twentieth(df: DataFrame, k: int = 20) -> DataFrame:
    """Search with every row whose vec_id is divisible by 20, against all rows."""
    return search(df, df.where(F.col("vec_id") % 20 == 0), k)
