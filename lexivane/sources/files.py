"""Raw text sources: whole files, in-memory texts, upload bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import text as T
from lexivane.sources import vocabulary as V

DEFAULT_COLLECTION = "default"


def read_texts(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION, meta: DataFrame | None = None) -> DataFrame:
    """One corpus per file, named after its path below the scanned folder, with its driver."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("text"), F.url_decode(F.col("_metadata.file_path")).alias("path")
    )
    root = path.rstrip("/").removeprefix("file:")
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/", "")
    docs = rows.select(
        F.lit(collection).alias("collection"), T.safe_name(T.derive_base_name(below)).alias("base"), F.lit(0).cast("long").alias("doc"), "text", below.alias("path")
    )
    if meta is None:
        return docs.withColumn("driver", F.lit(V.BASE_DRIVER))
    return V.interpret(docs, meta).select("collection", "base", "doc", "text", "path", F.col("language").alias("driver"))


def text_rows(spark: SparkSession, texts: dict[str, str], collection: str = DEFAULT_COLLECTION) -> DataFrame:
    """Corpora given inline: base name to text."""
    rows = [(collection, name, 0, text) for name, text in texts.items()]
    named = spark.createDataFrame(rows, "collection string, base string, doc long, text string")
    return named.withColumn("base", T.safe_name(F.col("base")))


def upload_rows(uploads: DataFrame) -> DataFrame:
    """``uploads(collection, name, content binary)``: UTF-8 texts; other bytes fail the job."""
    text = F.decode("content", "UTF-8")
    broken = F.encode(text, "UTF-8") != F.col("content")
    valid = F.when(broken, F.raise_error(F.lit("upload is not UTF-8"))).otherwise(text)
    return uploads.select("collection", T.safe_name(F.col("name")).alias("base"), F.lit(0).cast("long").alias("doc"), valid.alias("text"))
