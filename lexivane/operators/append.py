"""Incremental append with chunk packing.

New text continues the last chunk of its base: that chunk and the new text are cut again, earlier
chunks keep their rows, and the statistics of the base are derived anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.chunking import DEFAULT_CHUNK_SIZE, text_pieces
from lexivane.operators import index as I
from lexivane.sources.vocabulary import BASE_DRIVER

PACKED = "collection string, base string, seq long, chunk long, start long, text string"


def packed_rows(rows: Iterator[tuple[int, int | None, int | None, str]], size: int) -> Iterator[tuple[int, int, int, str]]:
    """Chunks ``(seq, chunk, start, text)`` of one base from its rows ``(seq, chunk, start, text)`` in order.

    A row with a chunk number is the open tail of the base; every other row is cut together with the chunk
    that is still open. A chunk is complete as soon as another one follows it.
    """
    seq, number, start, tail = 0, 0, 0, ""
    for new_seq, chunk, at, text in rows:
        if chunk is not None:
            seq, number, start, tail = new_seq, chunk, at, text
            continue
        found = list(text_pieces(tail + text, size))
        if not found:
            continue
        for i, (offset, piece) in enumerate(found[:-1]):
            # the first piece is the open chunk itself and keeps its source only if nothing was added to it
            yield (seq if i == 0 and piece == tail else new_seq, number + i, start + offset, piece)
        offset, tail = found[-1]
        seq, number, start = new_seq, number + len(found) - 1, start + offset
    if tail:
        yield seq, number, start, tail


def _fold(size: int):
    columns = ["collection", "base", "seq", "chunk", "start", "text"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of one base stand together; an unended base is carried over as its open tail
        stream = ((key, row) for batch in batches for key, row in zip(zip(batch["collection"], batch["base"]), zip(batch["seq"], batch["chunk"], batch["start"], batch["text"])))
        none = lambda x: None if x is None or pd.isna(x) else int(x)
        done: list[tuple] = []
        for (collection, base), rows in groupby(stream, key=lambda x: x[0]):
            for packed in packed_rows(((int(seq), none(chunk), none(start), text) for _, (seq, chunk, start, text) in rows), size):
                done.append((collection, base, *packed))
                if len(done) == 10_000:
                    yield pd.DataFrame(done, columns=columns)
                    done = []
        yield pd.DataFrame(done, columns=columns)

    return fold


def packed_chunks(texts: DataFrame, last_chunks: DataFrame | None = None, size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Fold ``texts(collection, base, seq, text)`` in order of ``seq`` into packed chunks.

    ``last_chunks(collection, base, chunk, start, text)`` is the open tail of existing bases. The
    order inside a base is inherent, so the rows of a base stream through one task in sorted order;
    only its open chunk is held in memory, never the group.
    """
    columns = ["collection", "base", "seq", "chunk", "start", "text"]
    rows = texts.select("collection", "base", F.col("seq").cast("long"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    if last_chunks is not None:
        tails = last_chunks.join(texts.select("collection", "base").distinct(), ["collection", "base"], "left_semi")
        rows = rows.unionByName(tails.select("collection", "base", F.lit(-1).cast("long").alias("seq"), F.col("chunk").cast("long"), F.col("start").cast("long"), "text"))
    placed = rows.select(*columns).repartition("collection", "base").sortWithinPartitions("collection", "base", "seq")
    return placed.mapInPandas(_fold(size), PACKED)


def append_rows(existing: DataFrame, texts: DataFrame, size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Chunk rows of all bases after the append: untouched ones, then the packed tails."""
    keys = ["collection", "base"]
    ends = existing.groupBy(*keys).agg(F.max("chunk").alias("chunk"))
    tails = existing.join(ends, [*keys, "chunk"])
    packed = packed_chunks(texts, tails, size)
    touched = ends.join(texts.select(*keys).distinct(), keys, "left_semi")
    kept = existing.join(touched, [*keys, "chunk"], "left_anti")
    return kept.select(*keys, "chunk", "start", "text").unionByName(packed.select(*keys, "chunk", "start", "text"))


def append_to_index(index: I.Index, texts: DataFrame, mtime: int = 0) -> I.Index:
    """The index after ``texts(collection, base, seq, text)`` were appended; only cells of these bases are written, only the packed tails tokenized.

    The tail continues the last document of its base. Without stored texts the new text starts
    after the last chunk.
    """
    keys = I.BASE
    touched = texts.groupBy(*keys).agg(F.sum(F.octet_length("text")).cast("long").alias("added"))
    lasts = index.chunks.join(touched.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.max(F.struct("doc", "piece", "start", "len", "text", "driver", "doc_bytes")).alias("l")
    ).withColumn("bare", F.col("l.text").isNull())
    tails = lasts.select(
        *keys,
        F.when(F.col("bare"), F.col("l.piece") + 1).otherwise(F.col("l.piece")).alias("chunk"),
        F.when(F.col("bare"), F.col("l.start") + F.col("l.len")).otherwise(F.col("l.start")).alias("start"),
        F.coalesce("l.text", F.lit("")).alias("text"),
    )
    packed = packed_chunks(texts, tails, index.chunk_size)
    old = lasts.select(*keys, F.col("l.doc").alias("doc"), F.col("l.piece").alias("last"), "l.driver", "l.doc_bytes", "bare")
    rows = packed.join(old, keys, "left").join(touched, keys)
    first = F.col("chunk") == F.coalesce(F.when(F.col("bare"), F.col("last") + 1).otherwise(F.col("last")), F.lit(0))
    before = F.when(F.col("bare"), F.lit(0)).otherwise(F.coalesce("doc_bytes", F.lit(0)))
    cut = rows.select(
        *keys,
        F.coalesce("doc", F.lit(0)).alias("doc"),
        F.col("chunk").alias("piece"),
        F.coalesce("driver", F.lit(BASE_DRIVER)).alias("driver"),
        "start",
        F.length("text").alias("len"),
        F.when(first, before + F.col("added")).otherwise(F.lit(0)).cast("long").alias("doc_bytes"),
        "text",
    )
    fresh = I.token_columns(cut).join(lasts.select(*keys, "bare"), keys, "left")
    fresh = fresh.withColumn("text", F.when(~F.coalesce("bare", F.lit(False)), F.col("text"))).drop("bare")
    replaced = lasts.where("not bare").select(*keys, F.col("l.doc").alias("doc"), F.col("l.piece").alias("piece"))
    return I.changed_index(index, touched, lambda rows: rows.join(replaced, I.CHUNK, "left_anti"), fresh, mtime=mtime)
