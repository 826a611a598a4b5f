"""Ranks and running sums over groups of any size, without one task per group.

Spark's range partitioning splits even a single hot group over all partitions. The partition number
is written with the rows, so totals per partition and the sums inside a partition agree whatever
is re-read later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.plans.store import TableStore


def running_sums(
    store: TableStore, name: str, df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Exclusive running sums inside ``group`` along the total order ``order``.

    ``sums`` maps each result column to the column that it adds up.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(slots, *group, *order).withColumn("slot", F.spark_partition_id())
    saved = store.save(name, placed)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = saved.groupBy(*group, "slot").agg(*[F.sum(v).alias(f"total_{r}") for r, v in sums.items()])
    # one row per range partition and group in it: a short window
    by_slot = before(Window.partitionBy(*group).orderBy("slot"))
    inside = before(Window.partitionBy(*group, "slot").orderBy(*order))
    zero = F.lit(0)
    heads = totals.select(
        *group, "slot", *[F.coalesce(F.sum(f"total_{r}").over(by_slot), zero).alias(f"head_{r}") for r in sums]
    )
    inner = saved.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"inner_{r}") for r, v in sums.items()])
    joined = inner.join(heads, [*group, "slot"])
    return joined.select(*df.columns, *[(F.col(f"head_{r}") + F.col(f"inner_{r}")).alias(r) for r in sums])
