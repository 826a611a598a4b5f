"""Materialized tables in the shared folder of the cluster.

Cutting lineage by a written table survives the loss of executors and gives Catalyst true file
sizes for its join decisions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="lexivane-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@dataclass(frozen=True)
class Parts:
    """The current folders of a table that is stored by parts: cell -> generation that wrote it last."""

    schema: T.StructType
    current: dict[str, str] = field(default_factory=dict)

    def changed(self, written: Parts, touched: set[str] | None) -> Parts:
        """These parts after ``touched`` cells (all, if None) were written anew; cells without rows are gone."""
        kept = {} if touched is None else {c: g for c, g in self.current.items() if c not in touched}
        return Parts(written.schema, kept | written.current)


class TableStore:
    """Named parquet tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/lexivane-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None, mode="overwrite"):
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save_parts(self, name: str, df: DataFrame, generation: str, partition: str = "cell") -> Parts:
        """Write ``df`` as one generation of a table stored by parts; files of other generations stay as they are."""
        folder = f"{self.path(name)}/generation={generation}"
        df.write.mode("overwrite").partitionBy(partition).parquet(folder)
        schema = T.StructType([f for f in df.schema.fields if f.name != partition] + [df.schema[partition]])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [status.getPath().getName() for status in listed]
        return Parts(schema, {n.partition("=")[2]: generation for n in names if n.startswith(f"{partition}=")})

    def load_parts(self, name: str, parts: Parts, partition: str = "cell") -> DataFrame:
        """The current parts; cells are plain words, so their folders need no escapes."""
        if not parts.current:
            return self.spark.createDataFrame([], parts.schema)
        folders = [f"{self.path(name)}/generation={g}/{partition}={c}" for c, g in sorted(parts.current.items())]
        return self.spark.read.schema(parts.schema).option("basePath", self.path(name)).parquet(*folders).select(*parts.schema.fieldNames())
