"""Drivers that are available and those that are installed, as versions of one table.

A version is written whole and never changed: readers of an index keep the drivers that they started with, and an install or uninstall
that fails leaves the current version. Vocabularies are small (a few thousand tokens for each driver).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.plans.store import TableStore
from lexivane.sources.vocabulary import FALLBACK_FILE

META = "file string, driver string, header string, description string, extensions array<string>"
VOCAB = "driver string, dim int, token string, is_keyword boolean"


class DriverCatalog:
    """``files(file, driver, header, description, extensions, installed)`` and ``tokens(driver, dim, token, is_keyword)`` of every version."""

    def __init__(self, store: TableStore, name: str = "drivers"):
        self.store = store
        self.name = name
        self.version = 0

    def _write(self, files: DataFrame, tokens: DataFrame | None = None) -> None:
        following = f"{self.name}/version={self.version + 1}"
        self.store.save(f"{following}/files", files)
        self.store.save(f"{following}/tokens", self._tokens() if tokens is None else tokens)
        self.version += 1

    def files(self) -> DataFrame:
        if not self.version:
            return self.store.spark.createDataFrame([], f"{META}, installed boolean")
        return self.store.load(f"{self.name}/version={self.version}/files")

    def _tokens(self) -> DataFrame:
        if not self.version:
            return self.store.spark.createDataFrame([], VOCAB)
        return self.store.load(f"{self.name}/version={self.version}/tokens")

    def add(self, vocab: DataFrame, meta: DataFrame, installed: bool = False) -> None:
        """Make drivers available, as :func:`vocabulary.read_drivers` gives them; a file of the same name is replaced."""
        known = [f.split(" ")[0] for f in META.split(", ")]
        meta = meta.select(*known, F.lit(installed).alias("installed"))
        replaced = self.files().join(meta.select("file"), "file", "left_semi").select("driver")
        kept_files = self.files().join(meta.select("file"), "file", "left_anti")
        kept_tokens = self._tokens().join(replaced.union(meta.select("driver")).distinct(), "driver", "left_anti")
        tokens = kept_tokens.unionByName(vocab.select("driver", F.col("dim").cast("int").alias("dim"), "token", "is_keyword"))
        self._write(kept_files.unionByName(meta), tokens)

    def _moved(self, file: str, installed: bool) -> int:
        if not re.fullmatch(r"[^/\\]+\.drv", file) or ".." in file:
            raise ValueError(f"not the name of a driver file: {file}")
        if not installed and file == FALLBACK_FILE:
            raise ValueError(f"{file} is the fallback and stays installed")
        if self.files().where((F.col("file") == file) & (F.col("installed") != installed)).isEmpty():
            raise FileNotFoundError(f"{file} is not {'available' if installed else 'installed'}")
        state = F.when(F.col("file") == file, F.lit(installed)).otherwise(F.col("installed"))
        self._write(self.files().withColumn("installed", state))
        return self.files().where("installed").count()

    def install(self, file: str) -> int:
        """From now on files of its extensions go to this driver. Gives the number of installed drivers."""
        return self._moved(file, True)

    def uninstall(self, file: str) -> int:
        return self._moved(file, False)

    def meta(self) -> DataFrame:
        """Installed drivers, for :func:`vocabulary.interpret` and :func:`vocabulary.list_drivers`."""
        return self.files().where("installed").drop("installed")

    def vocab(self) -> DataFrame:
        """Tokens of installed drivers."""
        return self._tokens().join(self.meta().select("driver").distinct(), "driver", "left_semi")
