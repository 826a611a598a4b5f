"""Best-fit packing with exact complements: documents into as few sequences as can be.

A document is cut only if it is longer than a sequence, into pieces of a whole sequence and a rest. What remains to be
decided depends on lengths alone, and there are no more lengths than a sequence has tokens, so the plan is made from a
histogram of ``capacity`` counts, however many documents there are:

* The longest length left opens a sequence. The gap behind it is looked up among single lengths, then among sums of
  pairs, then of triples, under the counts that are left; a combination that fills the gap exactly is taken.
* Where none does, the longest length that fits goes in (best fit), and the smaller gap is looked up again.
* A filling is used as often as the counts allow, so every step uses up a length, all but for a few copies.

Every piece has a number among the pieces of its length, found from its task and its place there, and the plan says
to which sequence and offset each range of numbers goes. No group is packed by a task of its own, and a length that a
third of all documents have is spread like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import byte_slices, give_back, stored
from lexivane.llm.word_ids import word_tokenizer

CAPACITY = 2048
END_ID = 0
SLICE_BYTES = 3 * 1024 * 1024
#: Columns of a plan: the pieces of ``length`` with numbers from ``first`` on, ``each`` of them in every sequence, go to sequences from ``sequence`` on, at ``offset``.
PLAN = ("length", "first", "each", "sequence", "offset")


class ComplementIndex:
    """Lengths with their counts, and what was found for sums of two and three of them.

    Counts only fall, so a sum without a pair or triple never gets one again. ``held`` are pieces that the filling
    under way has already taken.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def longest(self, most: int, held: Counter) -> int:
        """The longest length of at most ``most`` that is left, or 0."""
        for n in np.flatnonzero(self.left[: most + 1])[::-1]:
            if self.left[n] > held[int(n)]:
                return int(n)
        return 0

    def fits(self, combination: tuple[int, ...], held: Counter) -> bool:
        need = Counter(combination)
        return all(self.left[n] >= held[n] + k for n, k in need.items())

    def pair(self, total: int, held: Counter) -> tuple[int, int] | None:
        """Two lengths that add up to ``total``, the most even ones first."""
        known = self.pairs.get(total, ())
        if known is None or (known and self.fits(known, held)):
            return known
        small = np.arange(total // 2, 0, -1)
        found = [(int(n), total - int(n)) for n in small[(self.left[small] > 0) & (self.left[total - small] > 0)]]
        if not any(self.fits(x, Counter()) for x in found):
            self.pairs[total] = None
            return None
        for one in found:
            if self.fits(one, held):
                self.pairs[total] = one
                return one
        return None

    def triple(self, total: int, held: Counter) -> tuple[int, int, int] | None:
        """Three lengths that add up to ``total``, the shortest longest one first."""
        known = self.triples.get(total, ())
        if known is None or (known and self.fits(known, held)):
            return known
        free = True
        for n in range(-(-total // 3), total - 1):
            if self.left[n] <= held[n]:
                free &= self.left[n] == 0
                continue
            rest = self.pair(total - n, held + Counter([n]))
            if rest is not None:
                self.triples[total] = (n, *rest)
                return self.triples[total]
            free &= self.pairs.get(total - n, ()) is None
        if free:
            self.triples[total] = None
        return None

    def filling(self, capacity: int, first: int) -> Counter:
        """Lengths of one sequence that starts with ``first``."""
        held, gap = Counter([first]), capacity - first
        while gap:
            exact = (gap,) if self.left[gap] > held[gap] else self.pair(gap, held) or self.triple(gap, held)
            if exact:
                held.update(exact)
                break
            best = self.longest(gap, held)
            if not best:
                break
            held[best] += 1
            gap -= best
        return held


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows of ``PLAN`` for ``counts[n]`` pieces of n tokens, and the number of sequences."""
    index, rows, used, sequence = ComplementIndex(counts), [], Counter(), 0
    for first in range(capacity, 0, -1):
        while index.left[first]:
            held = index.filling(capacity, first)
            times = min(int(index.left[n]) // k for n, k in held.items())
            offset = 0
            for n, k in sorted(held.items(), reverse=True):
                rows.append((n, used[n], k, sequence, offset))
                used[n] += k * times
                index.left[n] -= k * times
                offset += n * k
            sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, len(PLAN)), sequence


def pieces(df: DataFrame, doc_id: str, text: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, and nth (its place among the task's pieces of its length)."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        words, task, seen = word_tokenizer(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                ids, sizes = words.ids(part.column(1), end)
                n_pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                order = np.argsort(length, kind="stable")
                found = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(np.cumsum(found) - found, found) + seen[length[order]]
                seen += found
                at = (4 * ((np.cumsum(sizes) - sizes)[doc] + start)).tolist()
                view = memoryview(ids)
                crc = [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(at, length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )
        give_back()

    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [
        slim.schema["doc_id"], T.StructField("piece", T.IntegerType()),
        *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    ]
    return slim.mapInArrow(cut, T.StructType(fields))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is a document of its own: repeated rows are packed as often as they occur, a null id stays null. A null
    or empty text is the end id alone. Texts of any length are taken whole. Other columns are not looked at, whatever
    their names. An empty table gives an empty result. Which of several pieces of one length goes where depends on the
    layout of the input; the number of sequences does not.
    """
    cut = stored(pieces(df, doc_id, text, vocabulary, end_id, capacity), "complement-pieces", SLICE_BYTES)
    by_task = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "complement-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length: at most ``capacity``
        counts[row["length"]] = row["n"]
    rows, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    heads = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    numbered = cut.join(heads, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("head") + F.col("nth")).alias("number"))

    def place(batches):
        lengths, first, each, sequence, offset = rows.T
        begins = np.searchsorted(lengths, np.arange(capacity + 2))  # rows of a length
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.searchsorted(length[order], np.arange(capacity + 2))
            for n in np.unique(length).tolist():
                own = order[cuts[n] : cuts[n + 1]]
                row[own] = begins[n] + np.searchsorted(first[begins[n] : begins[n + 1]], number[own], side="right") - 1
            copy, slot = np.divmod(number - first[row], each[row])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[row] + copy), pa.array(offset[row] + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    fields = [*numbered.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return numbered.mapInArrow(place, T.StructType(fields))
