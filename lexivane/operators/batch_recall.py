"""Recall for batches of many queries: dense products of chunk tiles and query weights, group by group.

A posting met by every query that holds its token costs a row for each of them. Here the chunks of a base are dealt to
groups of bounded size, each meets the weights of a block of queries in one cogroup, and only the best of a group leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexivane.operators.index import BASE, CHUNK

CHUNKS_OF_A_GROUP = 20_000
QUERIES_OF_A_GROUP = 500
TILE = 256
PENDING = 20_000
#: Cosines that may be equal once they are rounded to nine digits.
NEAR = 2e-9


def _pruned(found: np.ndarray, n: int, floor: np.ndarray) -> np.ndarray:
    """Of ``found(query, cos, row)`` what can be among the best ``n`` of a query; ``floor`` becomes its n-th cosine.

    Equal cosines differ by row alone, so the first ``n`` rows of one are enough; other near ones all stay.
    """
    found = found[np.lexsort((found["row"], -found["cos"], found["query"]))]
    at = np.arange(len(found))
    fresh = np.r_[True, found["query"][1:] != found["query"][:-1]]
    rank = at - np.maximum.accumulate(np.where(fresh, at, 0))
    again = fresh | np.r_[True, found["cos"][1:] != found["cos"][:-1]]
    run = at - np.maximum.accumulate(np.where(again, at, 0))
    last = found[rank == n - 1]
    floor[last["query"]] = last["cos"]
    return found[(rank < n) | ((found["cos"] >= floor[found["query"]] - NEAR) & (run < n))]


def _best_of_group(n: int, names: list[str], keep: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(chunks: pa.Table, weights: pa.Table) -> pa.Table:
        # the later chunk first, as ties are decided
        order = pc.sort_indices(chunks.select(["doc", "piece"]), sort_keys=[("doc", "descending"), ("piece", "descending")])
        chunks = chunks.take(order)
        ids = weights["query_id"].combine_chunks().dictionary_encode()
        tokens = weights["token"].combine_chunks().dictionary_encode()
        table = np.zeros((len(tokens.dictionary), len(ids.dictionary)))
        np.add.at(table, (tokens.indices.to_numpy(), ids.indices.to_numpy()), weights["w"].to_numpy())
        lists = chunks["tokens"].combine_chunks()
        column = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens.dictionary), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        value = chunks["tfs"].combine_chunks().flatten().to_numpy()
        known = column >= 0
        column, row, value = column[known], row[known], value[known]
        norm = chunks["c_norm"].to_numpy()
        floor = np.zeros(table.shape[1])
        found = np.zeros(0, [("query", np.int64), ("cos", np.float64), ("row", np.int64)])
        for start in range(0, len(lists), TILE):
            low, high = np.searchsorted(row, (start, start + TILE))
            if low == high:
                continue
            tile = np.zeros((min(TILE, len(lists) - start), len(table)))
            np.add.at(tile, (row[low:high] - start, column[low:high]), value[low:high])
            cos = tile @ table / norm[start : start + TILE, None]
            at, query = np.nonzero((cos > 0) & (cos >= floor - NEAR))
            fresh = np.empty(len(at), found.dtype)
            fresh["query"], fresh["cos"], fresh["row"] = query, cos[at, query], at + start
            found = np.concatenate([found, fresh])
            if len(found) > PENDING:
                found = _pruned(found, n, floor)
        if len(found):
            found = _pruned(found, n, floor)
        kept = chunks.select(keep).take(pa.array(found["row"]))
        asked = ids.dictionary.take(pa.array(found["query"]))
        return pa.table([asked, *kept.columns, pa.array(found["cos"])], names=names)

    return best


def best_by_base(chunks: DataFrame, sizes: DataFrame, weights: DataFrame, n_queries: int, n: int) -> DataFrame:
    """``query_id, CHUNK, uid, cos`` with the best ``n`` chunks of every query and base among them.

    ``chunks(CHUNK, uid, hist, c_norm)``, ``sizes(BASE, n_chunks)`` and ``weights(query_id, BASE, token, w)``, of which each product of weight
    and count over the norm adds to the cosine.
    """
    parts = -(-n_queries // QUERIES_OF_A_GROUP)
    slots = F.greatest(F.ceil(F.max("n_chunks") / CHUNKS_OF_A_GROUP), F.lit(1)).cast("int")
    dealt = sizes.groupBy(*BASE).agg(slots.alias("slots"))
    numbers = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
    keys = [*BASE, "slot", "part"]
    left = chunks.join(dealt, BASE).select(
        *CHUNK, "uid", "c_norm", F.col("hist.token").alias("tokens"), F.col("hist.tf").alias("tfs"),
        F.pmod(F.xxhash64("uid"), F.col("slots")).cast("int").alias("slot"), numbers(F.lit(parts)).alias("part"),
    )
    right = weights.join(dealt, BASE).select(
        "query_id", *BASE, "token", "w", numbers(F.col("slots")).alias("slot"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    )
    keep = [*CHUNK, "uid"]
    schema = StructType([right.schema["query_id"], *[left.schema[c] for c in keep]]).add("cos", "double")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of_group(n, schema.fieldNames(), keep), schema)
