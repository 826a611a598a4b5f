"""Shared storage, splits and small array helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one is made in the machine's temporary folder, in single-process local mode only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexivane-llm-")
    return _own_folders[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, batch_bytes: int | None = None) -> str:
    """Write ``df`` to a new folder in the shared one and return its path.

    Shuffle files of the write are kept until it has ended and go then, for nothing reads them any more. Arrow batches
    that Python workers get meanwhile hold about ``batch_bytes``, if given, in place of the session's limit; a longer row stands alone.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    settings = {FREE_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return path


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label, batch_bytes))


def id_text(column: str) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_part(column: str, parts: int, part: int) -> Column:
    """True where the CRC-32 of the id as text falls in ``part`` of ``parts``."""
    return F.crc32(F.encode(id_text(column), "UTF-8")) % F.lit(parts) == F.lit(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a Python worker has freed to the system, for it stays alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library: it keeps its memory


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts or lists in ``column`` hold about ``most`` bytes or entries; a longer one stands alone."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of texts, split at ASCII white space: their numbers in one run, words per text, the distinct words."""
    whole = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:
        real = codes != words.index(b"")
        before = np.concatenate(([0], np.cumsum(real)))
        ends = np.cumsum(sizes)
        codes, sizes = codes[real], before[ends] - before[ends - sizes]
    return codes, sizes, words


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs, laid end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
