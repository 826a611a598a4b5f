"""Mining on a cadence: collections whose bases did not change are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivane.operators import mining as M
from lexivane.operators.index import Index
from lexivane.plans.store import TableStore

MIN_CADENCE_SECONDS = 10


class KnowledgeStore:
    """Knowledge records, one folder per cycle; the newest record of a collection counts.

    Records are bounded. The anatomy of a collection has a row for each base and stands beside them, in a table of its own.
    """

    def __init__(self, store: TableStore, name: str = "knowledge"):
        self.store = store
        self.name = name

    def rows(self) -> DataFrame | None:
        try:
            return self.store.spark.read.parquet(self.store.path(self.name))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def current(self) -> DataFrame | None:
        rows = self.rows()
        if rows is None:
            return None
        newest = rows.groupBy("collection").agg(F.max("cycle").alias("cycle"))
        return rows.join(newest, ["collection", "cycle"])

    def next_cycle(self) -> int:
        rows = self.rows()
        last = None if rows is None else rows.agg(F.max("cycle")).first()[0]
        return 0 if last is None else last + 1

    def anatomy(self) -> DataFrame:
        """Rows of :func:`mining.corpus_rows` that belong to the current records."""
        rows = self.store.load(f"{self.name}_anatomy")
        return rows.join(self.current().select("collection", "cycle"), ["collection", "cycle"], "left_semi")

    def write(self, records: DataFrame, anatomy: DataFrame, cycle: int) -> None:
        """Records come last: while they are missing, the next cycle mines their collections again."""
        fresh = self.store.save(f"{self.name}_fresh/cycle={cycle}", records)
        self.store.save(f"{self.name}_anatomy/cycle={cycle}", anatomy.join(fresh.select("collection"), "collection", "left_semi"))
        self.store.save(f"{self.name}/cycle={cycle}", fresh)


def run_cycle(index: Index, knowledge: KnowledgeStore, cycle: int, enabled: list[str] | None = None, force: bool = False) -> DataFrame:
    """Mine the changed collections once; a failed job leaves the current records as they are."""
    previous = knowledge.current()
    knowledge.write(M.mine(index, previous, enabled, force), M.corpus_rows(index), cycle)
    return knowledge.current()


def mining_stream(
    ticks: DataFrame, open_index: Callable[[], Index], knowledge: KnowledgeStore, checkpoint: str, enabled: list[str] | None = None, cadence: int = MIN_CADENCE_SECONDS
) -> StreamingQuery:
    """Run a cycle for every micro-batch of ``ticks``, at most once per cadence."""

    def step(batch: DataFrame, number: int) -> None:
        # numbers go on from the store: a new checkpoint starts at 0 again, and its records are newer all the same
        run_cycle(open_index(), knowledge, knowledge.next_cycle(), enabled)

    seconds = max(cadence, MIN_CADENCE_SECONDS)
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
