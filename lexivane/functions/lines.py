"""Histograms, positions and distinct words of whole Arrow batches of lines, for code that runs inside a task.

Lines come from the expressions of ``functions.text``; here they are only split and counted.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import ArrayType, IntegerType, StructType

from lexivane.functions.text import KEY_SEPARATOR, KEY_SYLLABLES

ROWS_AT_ONCE = 1000
HISTOGRAM = ArrayType(StructType().add("token", "string").add("tf", "integer"))
POSITIONS = ArrayType(IntegerType())


def _syllables(line: str | None) -> list[str]:
    return [s for s in (line or "").replace("|", " ").split(" ") if s]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def with_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``tokens``, the number of syllables of ``line``, and ``hist``, their counts in order; null without a line."""
    for batch in _slices(batches):
        lines = batch.column("line").to_pylist()
        sizes, ends, tokens, counts = [], array("i", [0]), [], array("i")
        for line in lines:
            said = Counter(_syllables(line))
            sizes.append(None if line is None else said.total())
            ordered = sorted(said)
            tokens += ordered
            counts.extend([said[t] for t in ordered])
            ends.append(len(tokens))
        entries = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(np.array(counts, np.int32))], ["token", "tf"])
        hist = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), entries, mask=pa.array([line is None for line in lines], pa.bool_()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), hist], [*batch.schema.names, "tokens", "hist"])


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the only column, lines with a space between words, each once a batch."""
    for batch in batches:
        found = {w for line in batch.column(0).to_pylist() if line for w in line.split(" ")}
        found.discard("")
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])


def distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix keys of the words of syllable lines, each once a batch; those of ``functions.text.word_key``."""
    for batch in distinct_words(batches):
        found = {KEY_SEPARATOR.join(w.split("|", KEY_SYLLABLES)[:KEY_SYLLABLES]) for w in batch.column(0).to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])


def with_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct syllable of ``line``, with its ascending positions; the other columns are repeated."""
    for batch in _slices(batches):
        at = batch.schema.get_field_index("line")
        rows, tokens, ends, positions = array("i"), [], array("i", [0]), array("i")
        for row, line in enumerate(batch.column(at).to_pylist()):
            places = defaultdict(list)
            for place, token in enumerate(_syllables(line)):
                places[token].append(place)
            for token, own in places.items():
                tokens.append(token)
                positions.extend(own)
                ends.append(len(positions))
            rows.extend([row] * len(places))
        kept = [i for i in range(batch.num_columns) if i != at]
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(positions, np.int32)))
        columns = [batch.column(i).take(pa.array(np.array(rows, np.int32))) for i in kept] + [pa.array(tokens, pa.string()), lists]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in kept] + ["token", "positions"])
