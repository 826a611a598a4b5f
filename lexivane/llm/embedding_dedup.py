"""Near-duplicate embeddings within labels over one-bit codes.

Equal vectors of a label are one vector with a count. The distinct ones are laid into blocks: inside a label by the
nearest of a set of pivots, so that a block is narrow where vectors crowd together. Two blocks meet only if the
angle between their centres, less both radii, admits the threshold. A task holds two blocks: it estimates all
cosines from the codes, and computes in double precision those pairs only whose upper bound reaches the threshold.
Of the links it returns the number by vector, and a spanning forest instead of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.bit_codes import encode, estimates, matrix, turned_units, usable
from lexivane.llm.common import stored
from lexivane.llm.components import components

COSINE = 0.93
BLOCK_ROWS = 2048
PIVOTS = 1024
ROWS_AT_ONCE = 256


def pivots(d: int) -> np.ndarray:
    """Fixed random directions that order the vectors of a label; they decide on speed only."""
    p = np.random.default_rng(3 + d).normal(size=(PIVOTS, d))
    return p / np.linalg.norm(p, axis=1)[:, None]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def similar_pairs(left: np.ndarray, right: np.ndarray | None, cosine: float):
    """Yield (rows of left, rows of right) with at least this cosine; without ``right``, pairs of left's own rows."""
    own = right is None
    codes = encode(left if own else right)
    spread, other = codes.spread(), unit(left if own else right)
    mine = unit(left)
    turned = turned_units(left)
    for i in range(0, len(left), ROWS_AT_ONCE):
        may = estimates(codes, turned[i : i + ROWS_AT_ONCE]) + spread >= cosine
        if own:
            may &= np.arange(len(left))[None, :] > np.arange(i, i + len(may))[:, None]
        a, b = np.nonzero(may)
        for j in range(0, len(a), 1 << 16):
            p, q = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
            hit = (mine[p] * other[q]).sum(axis=1) >= cosine
            yield p[hit], q[hit]


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A spanning forest of a graph, each tree as a star on its smallest node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = [x for x in up if top(x) != x]
    return nodes, [top(x) for x in nodes]


def deduplicated(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions are equal and their cosine is at least
    ``cosine``. A vector that is null, empty, zero or holds null or non-finite numbers links with nothing and is a
    component of its own, as is one without a label or an id. Repeated ids count as vectors of their own; rows of one id share
    a component.
    """
    slim = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    good = usable(slim, "vec").where("label is not null and vec_id is not null")
    same = ["label", "vec"]
    distinct = stored(good.groupBy(*same).agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")), "dedup-distinct")

    def cell(batches):
        for batch in batches:
            vectors, cells = batch.column(batch.schema.names.index("vec")), batch.column(batch.schema.names.index("cells")).to_numpy()
            at, out = batch.column(batch.schema.names.index("d")).to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
            for d, n in sorted(set(zip(at.tolist(), cells.tolist()))):
                rows = np.flatnonzero((at == d) & (cells == n))
                out[rows] = (unit(matrix(vectors.take(pa.array(rows)))) @ pivots(d)[:n].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    measured = distinct.withColumn("d", F.size("vec"))
    spaces = measured.groupBy("label", "d").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / block_rows)).cast("long").alias("cells"))
    measured = measured.join(spaces, ["label", "d"])
    placed = measured.mapInArrow(cell, T.StructType([*measured.schema.fields, T.StructField("cell", T.LongType())])).drop("cells")
    sizes = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    blocks = stored(placed.join(sizes, ["label", "d", "cell"]).withColumn("part", F.pmod(F.xxhash64("head", "vec"), "parts")).drop("parts"), "dedup-blocks")
    key = ["label", "d", "cell", "part"]

    def shape(own: pa.Table) -> pa.Table:
        vectors = unit(matrix(own["vec"].combine_chunks()))
        centre = vectors.mean(axis=0)
        centre = centre / max(1e-12, float(np.linalg.norm(centre)))
        radius = float(np.arccos(np.clip((vectors @ centre).min(), -1, 1))) + 1e-6
        first = own.slice(0, 1).select(key)
        return first.append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64()))).append_column("radius", pa.array([radius]))

    fields = [blocks.schema[k] for k in key]
    shapes = blocks.select(*key, "vec").groupBy(*key).applyInArrow(shape, T.StructType([*fields, *T._parse_datatype_string("centre array<double>, radius double").fields]))
    shapes = stored(shapes, "dedup-shapes")
    left = shapes.select("label", "d", F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("centre").alias("c_a"), F.col("radius").alias("r_a"))
    right = shapes.select("label", "d", F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("centre").alias("c_b"), F.col("radius").alias("r_b"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("c_a", "c_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))))
    order = F.struct("cell_a", "part_a") <= F.struct(F.col("cell_b").alias("cell_a"), F.col("part_b").alias("part_a"))
    meets = left.join(right, ["label", "d"]).where(order & (apart - F.col("r_a") - F.col("r_b") <= math.acos(cosine)))
    meets = stored(meets.select("label", "d", "cell_a", "part_a", "cell_b", "part_b").withColumn("task", F.xxhash64("label", "d", "cell_a", "part_a", "cell_b", "part_b")), "dedup-meets")
    ends = [
        blocks.join(meets.select("label", "d", F.col(f"cell_{s}").alias("cell"), F.col(f"part_{s}").alias("part"), "task", F.lit(s == "b").alias("second"), ((F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))).alias("own")), key)
        .where(~F.col("own") | ~F.col("second")).select("task", "second", "head", "copies", "vec")
        for s in ("a", "b")
    ]

    def compare(task: pa.Table) -> pa.Table:
        second = task["second"].to_numpy()
        parts = [task.filter(pa.array(second == s)) for s in (False, True)]
        heads, copies = ([p[c].to_numpy() for p in parts] for c in ("head", "copies"))
        vectors = [matrix(p["vec"].combine_chunks()) if p.num_rows else None for p in parts]
        own = vectors[1] is None
        other = 0 if own else 1
        links = [np.zeros(p.num_rows, dtype=np.int64) for p in parts]
        seen_a: list[int] = []
        seen_b: list[int] = []
        for a, b in similar_pairs(vectors[0], vectors[1], cosine):
            np.add.at(links[0], a, copies[other][b])
            np.add.at(links[other], b, copies[0][a])
            x, y = forest(heads[0][a].tolist() + seen_a, heads[other][b].tolist() + seen_b)
            seen_a, seen_b = x, y
        every = np.concatenate(heads) if not own else heads[0]
        number = np.concatenate(links) if not own else links[0]
        on = np.flatnonzero(number)
        return pa.table({"head": pa.array([*every[on].tolist(), *seen_a], pa.int64()), "to": pa.array([*[None] * len(on), *seen_b], pa.int64()), "links": pa.array([*number[on].tolist(), *[0] * len(seen_a)], pa.int64())})

    found = stored(ends[0].unionByName(ends[1]).groupBy("task").applyInArrow(compare, "head long, to long, links long"), "dedup-found")
    tied = good.select("vec_id", *same).join(distinct.withColumnRenamed("head", "home"), same)
    copied = tied.where("copies > 1 and vec_id <> home").select(F.col("vec_id").alias("a"), F.col("home").alias("b"))
    parts = components(found.where("to is not null").select(F.col("head").alias("a"), F.col("to").alias("b")).unionByName(copied))
    # links are counted by distinct vector: its smallest id and the vector itself
    by_head = found.groupBy("head").agg(F.sum("links").alias("links"))
    counted = tied.join(by_head, F.col("home") == F.col("head"), "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = slim.select("vec_id").join(counted, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.coalesce("vec_id", F.lit(0)) == F.coalesce(component, F.lit(0))).alias("kept"))
