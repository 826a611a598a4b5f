"""Cost-balanced packing of tokenized documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``: the work of a transformer on it when attention stays
inside the piece. Pieces are taken longest first, each goes to the sequence with the lowest cost so far that
still has room for it, so sequences end with about equal cost. A piece that fits nowhere is cut so that it
fills the cheapest sequence with room.

Tokens are counted once. Beside its length, a document keeps one CRC-32 for each block of 32 ids; the CRC of
any piece that starts on a block border and ends on one, or at the document's end, is composed from them, so
cutting needs no second look at the text.

Documents are dealt to groups of about ``group_sequences`` sequences at random, and each group is packed by a
task of its own: memory per task is bounded, and less than one sequence per group stays part empty.
"""

from __future__ import annotations

import heapq
import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import byte_slices, give_back, stored
from lexivane.llm.word_ids import word_tokenizer

CAPACITY = 4096
END_ID = 2
BLOCK = 32
GROUP_SEQUENCES = 1024
LINEAR = 12 * 1024.0
QUADRATIC = 2.0
SLICE_BYTES = 3 * 1024 * 1024


@lru_cache(maxsize=1)
def crc_shifts() -> np.ndarray:
    """shifts[n, k, b]: what byte b at place k of a CRC turns to after n words of zeros; n up to ``BLOCK``."""
    step = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[b] = c
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [state]
    for _ in range(BLOCK):
        for _ in range(4):
            state = step[state & 255] ^ (state >> np.uint32(8))
        out.append(state)
    return np.stack(out)


def joined_crc(crc: np.ndarray, more: np.ndarray, words: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings laid end to end, from theirs; ``words``: the second's length in 32-bit words."""
    t = crc_shifts()
    return t[words, 0, crc & 255] ^ t[words, 1, (crc >> 8) & 255] ^ t[words, 2, (crc >> 16) & 255] ^ t[words, 3, crc >> 24] ^ more


def piece_crcs(blocks: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of pieces; ``blocks[i]`` holds the block CRCs of the document of piece i, ``starts`` are on block borders."""
    if not len(blocks):
        return np.zeros(0, dtype=np.int64)
    count = -(-lengths // BLOCK)
    flat = np.concatenate([b[s // BLOCK : s // BLOCK + n] for b, s, n in zip(blocks, starts, count)])
    first = np.cumsum(count) - count
    crc = flat[first].copy()
    for k in range(1, int(count.max())):
        on = np.flatnonzero(count > k)
        words = np.minimum(BLOCK, lengths[on] - k * BLOCK)
        crc[on] = joined_crc(crc[on], flat[first[on] + k], words)
    return crc.astype(np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths: (document, start, length, sequence, offset) of every piece.

    Ties go to the earlier document and to the earlier sequence.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    queue: list[tuple[int, int, int]] = []
    sequence = 0
    for doc, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            queue.append((-(n % capacity), doc, n - n % capacity))
    heapq.heapify(queue)
    opened = max(1, math.ceil(-sum(x[0] for x in queue) / capacity))
    cost, room = np.zeros(opened), np.full(opened, capacity)
    while queue:
        negative, doc, start = heapq.heappop(queue)
        n = -negative
        fits = room >= n
        if not fits.any():
            fits = room >= BLOCK
            if not fits.any():
                cost, room = np.append(cost, 0.0), np.append(room, capacity)
                fits = room >= BLOCK
        at = int(np.where(fits, cost, np.inf).argmin())
        part = n if room[at] >= n else int(room[at]) // BLOCK * BLOCK
        if part < n:
            heapq.heappush(queue, (part - n, doc, start + part))
        pieces.append((doc, start, part, sequence + at, capacity - int(room[at])))
        cost[at] += linear * part + quadratic * part * part
        room[at] -= part
    return pieces


def tokenized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """One row per document: doc_id, row (number inside its task), doc_tokens, blocks (CRC-32 of each 32 ids)."""
    end = int(end_id).to_bytes(4, "little")

    def count(batches):
        words, row = word_tokenizer(vocabulary), 0
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                ids, sizes = words.ids(part.column(1), end)
                ends = np.cumsum(sizes) * 4
                blocks = [
                    np.array([zlib.crc32(ids[i : min(i + 4 * BLOCK, stop)]) for i in range(start, stop, 4 * BLOCK)], dtype="<u4").tobytes()
                    for start, stop in zip((ends - 4 * sizes).tolist(), ends.tolist())
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(range(row, row + len(sizes)), pa.int64()), pa.array(sizes), pa.array(blocks, pa.binary())], ["doc_id", "row", "doc_tokens", "blocks"])
                row += len(sizes)
        give_back()

    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [slim.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("blocks", T.BinaryType())]
    return slim.mapInArrow(count, T.StructType(fields))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is a document of its own: repeated rows are packed as often as they occur, a null id stays null.
    A null or empty text is the end id alone. An empty table gives an empty result.
    """
    if capacity % BLOCK:
        raise ValueError(f"capacity must be a multiple of {BLOCK}")
    counted = stored(tokenized(df, doc_id, text, vocabulary), "packing-tokens", SLICE_BYTES)
    total = counted.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / (capacity * group_sequences)))

    def place(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_tokens", "doc_id", "row", "blocks"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = own["doc_tokens"].to_numpy(np.int64)
        doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*assign(lengths, capacity)))
        blocks = [np.frombuffer(x, dtype="<u4") for x in own["blocks"]]
        return pd.DataFrame({
            "doc_id": own["doc_id"].take(doc).array, "start": start, "length": length, "ids_crc32": piece_crcs([blocks[d] for d in doc], start, length),
            "doc_tokens": lengths[doc], "sequence_id": sequence + (int(own["lot"].iloc[0]) << 32), "offset": offset,
        })

    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([counted.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in longs)])
    dealt = counted.withColumn("lot", F.pmod(F.xxhash64("row", "doc_id", "doc_tokens"), F.lit(groups)))
    return dealt.groupBy("lot").applyInPandas(place, schema)
