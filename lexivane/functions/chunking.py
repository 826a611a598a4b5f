"""Cutting texts into chunks, entirely row-local."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.functions.text import strip

DEFAULT_CHUNK_SIZE = 2048
BLOCK = 64


def piece_pattern(size: int, end: str) -> str:
    """One piece: the rest if it is short enough, else up to the last inner blank, else ``size`` characters."""
    if size < 2:
        raise ValueError("chunk size must be at least 2")
    return f"(?s)(.{{1,{size}}}{end}|.{{1,{size - 1}}}(?= )|.{{{size}}})"


def raw_pieces(text: Column, size: int) -> Column:
    """Greedy windows of at most ``size`` characters, cut before the last inner blank."""
    return F.regexp_extract_all(text, F.lit(piece_pattern(size, "\\z")), F.lit(1))


def text_pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """Offsets and trimmed texts of the same pieces, for code that runs inside a task."""
    for found in re.finditer(piece_pattern(size, r"\Z"), text):
        piece = found[0].strip()
        if piece:
            yield found.start() + found[0].index(piece), piece


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def with_offsets(df, raw: str = "raw"):
    """Add ``offsets``, the exclusive prefix sums of the piece lengths.

    Sums go by blocks, each step in its own column, so that long texts stay far from quadratic.
    """
    no_ids = F.array().cast("array<int>")
    n_blocks = F.ceil(F.size("lengths") / F.lit(BLOCK)).cast("int")
    ids = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(no_ids)
    block = lambda b: F.slice("lengths", b * BLOCK + 1, F.lit(BLOCK))
    within = lambda head, b: F.transform(
        block(b), lambda _, i: head + _total(F.slice("lengths", b * BLOCK + 1, i))
    )
    return (
        df.withColumn("lengths", F.transform(raw, F.length))
        .withColumn("block_sums", F.transform(ids, lambda b: _total(block(b))))
        .withColumn(
            "heads", F.transform("block_sums", lambda _, b: _total(F.slice("block_sums", F.lit(1), b)))
        )
        .withColumn("offsets", F.flatten(F.transform("heads", within)))
        .drop("lengths", "block_sums", "heads")
    )


def pieces(text_raw: Column, offsets: Column) -> Column:
    """Trimmed, non-empty pieces as ``array<struct<start,text>>`` (character offsets)."""

    def cut(raw: Column, at: Column) -> Column:
        lead = F.length(raw) - F.length(F.regexp_replace(raw, "(?U)^\\s+", ""))
        return F.struct((at + lead).cast("long").alias("start"), strip(raw).alias("text"))

    return F.filter(F.zip_with(text_raw, offsets, cut), lambda p: p["text"] != "")


def with_chunks(docs, keys: list[str], size: int = DEFAULT_CHUNK_SIZE, max_chunks: int = 0):
    """One row per chunk: ``keys``, piece, start, text, plus the byte size of the text on piece 0.

    A text without any chunk keeps one row with a null ``piece`` so that its bytes still count.
    """
    cut = with_offsets(
        docs.select(
            *keys,
            F.octet_length("text").cast("long").alias("bytes"),
            raw_pieces(F.col("text"), size).alias("raw"),
        )
    )
    listed = cut.select(*keys, "bytes", pieces(F.col("raw"), F.col("offsets")).alias("pieces"))
    if max_chunks > 0:
        listed = listed.withColumn("pieces", F.slice("pieces", 1, max_chunks))
    rows = listed.select(*keys, "bytes", F.posexplode_outer("pieces").alias("piece", "cut"))
    return rows.select(
        *keys,
        "piece",
        F.col("cut.start").alias("start"),
        F.length("cut.text").alias("len"),
        F.when(F.coalesce("piece", F.lit(0)) == 0, F.col("bytes")).otherwise(F.lit(0).cast("long")).alias("doc_bytes"),
        F.col("cut.text").alias("text"),
    )
