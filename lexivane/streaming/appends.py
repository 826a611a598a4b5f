"""Continuous append: the open chunk of a base is keyed state, and every micro-batch continues it.

The state store holds one open chunk for each base, so its size does not depend on what came before. Complete and open chunks go to a log,
where the newest row of a chunk counts.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexivane.functions.chunking import DEFAULT_CHUNK_SIZE
from lexivane.operators.append import packed_rows
from lexivane.plans.store import TableStore

KEYS = ["collection", "base"]
CHUNK_ROWS = "collection string, base string, chunk long, start long, text string"
OPEN_CHUNK = "seq long, chunk long, start long, text string"
HELD_LETTERS = 1 << 25
ROWS_OUT = 10_000


class ChunkLog:
    """Append-only log of chunk rows; the newest batch of a chunk is its current state.

    A batch writes only the chunks that it changed, under its own number, so a replayed batch
    overwrites itself and a lost one is simply run again.
    """

    def __init__(self, store: TableStore, name: str = "chunk_log"):
        self.store = store
        self.name = name

    def rows(self) -> DataFrame:
        spark = self.store.spark
        schema = f"{CHUNK_ROWS}, batch long"
        try:
            return spark.read.schema(schema).parquet(self.store.path(self.name))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        newest = F.max(F.struct("batch", "start", "text")).alias("newest")
        return self.rows().groupBy(*KEYS, "chunk").agg(newest).select(*KEYS, "chunk", "newest.start", "newest.text")

    def write(self, changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.store.path(self.name)}/batch={batch}")


def in_order(frames: Iterable[pd.DataFrame], held: int = HELD_LETTERS) -> Iterator[tuple[int, str]]:
    """``(seq, text)`` of all frames by ``seq``; more than ``held`` letters are sorted in runs that wait in the task's temporary files."""
    by_seq = itemgetter(0)
    runs: list[Iterator[tuple[int, str]]] = []
    rows: list[tuple[int, str]] = []
    letters = 0
    for frame in frames:
        for seq, text in zip(frame["seq"], frame["text"]):
            rows.append((int(seq), text))
            letters += len(text)
            if letters >= held:
                runs.append(_written(sorted(rows, key=by_seq)))
                rows, letters = [], 0
    yield from heapq.merge(*runs, iter(sorted(rows, key=by_seq)), key=by_seq)


def _written(rows: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    run = tempfile.TemporaryFile()
    for row in rows:
        pickle.dump(row, run)
    run.seek(0)

    def read() -> Iterator[tuple[int, str]]:
        with run:
            for _ in range(len(rows)):
                yield pickle.load(run)

    return read()


def continued(stream: DataFrame, size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Chunks of ``stream(collection, base, seq, text)`` that a batch completes or leaves open, by base.

    Inside a batch, rows go by ``seq``; a later batch continues where the last one ended. A null text adds nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = [state.get] if state.exists else []
        new = ((seq, None, None, text) for seq, text in in_order(frames))
        done: list[tuple] = []
        last = None
        for last in packed_rows(chain(before, new), size):
            done.append((*key, *last[1:]))
            if len(done) == ROWS_OUT:
                yield pd.DataFrame(done, columns=[*KEYS, "chunk", "start", "text"])
                done = []
        if last is not None:
            state.update(last)
        yield pd.DataFrame(done, columns=[*KEYS, "chunk", "start", "text"])

    texts = stream.select(*KEYS, F.coalesce(F.col("seq"), F.lit(0)).cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.groupBy(*KEYS).applyInPandasWithState(step, CHUNK_ROWS, OPEN_CHUNK, "update", GroupStateTimeout.NoTimeout)


def append_stream(stream: DataFrame, log: ChunkLog, checkpoint: str, size: int = DEFAULT_CHUNK_SIZE, trigger: dict | None = None) -> StreamingQuery:
    """Fold ``stream(collection, base, seq, text)`` into the log. The same ``checkpoint`` goes on after a restart."""
    writer = continued(stream, size).writeStream.outputMode("update").foreachBatch(log.write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
