"""Lexical profiles: what is salient in a base or in a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.operators.index import BASE, Index
from lexivane.sources.vocabulary import token_dims


def union_vocabulary(index: Index) -> DataFrame:
    """Global dimension per collection and token: bases by name, then their local dimensions.

    Bases with the same driver share a vocabulary, so the first base of each driver decides.
    """
    firsts = index.bases.groupBy("collection", F.col("language").alias("driver")).agg(F.min("base").alias("base"))
    entries = firsts.join(token_dims(index.vocab), "driver")
    first = entries.groupBy("collection", "token").agg(F.min(F.struct("base", "dim")).alias("at"))
    # at most the sum of all vocabularies per collection
    w = Window.partitionBy("collection").orderBy("at")
    return first.select("collection", "token", (F.row_number().over(w) - 1).alias("u_dim"))


def fingerprint(index: Index) -> DataFrame:
    return index.bases.groupBy("collection").agg(F.count("*").alias("n_bases"), F.sum("n_chunks").alias("total_chunks"))


def base_profile(index: Index, top: int = 20) -> DataFrame:
    """Rarest tokens of every base; ties by dimension."""
    w = Window.partitionBy(*BASE).orderBy(F.desc("idf"), F.asc("dim"))
    ranked = index.idf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(*BASE, "rank", "dim", F.col("token").alias("syllable"), "idf")


def collection_profile(index: Index, top: int = 20) -> DataFrame:
    """Rarest tokens of every collection in its global dimensions."""
    located = index.union_idf.join(union_vocabulary(index), ["collection", "token"])
    w = Window.partitionBy("collection").orderBy(F.round("uidf", 9).desc(), F.asc("u_dim"))
    ranked = located.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("collection", "rank", F.col("u_dim").alias("dim"), F.col("token").alias("syllable"), "uidf")


def base_vectors(index: Index, top: int = 20) -> DataFrame:
    """tf-idf of every base on the salient tokens of its collection, aligned with the profile."""
    salient = collection_profile(index, top)
    mass = index.postings.groupBy(*BASE, "token").agg(F.sum("tf").alias("tf"))
    bases = index.bases.select(*BASE, "corpus", "n_chunks")
    cells = bases.join(salient, "collection")
    cells = cells.join(mass.withColumnRenamed("token", "syllable"), [*BASE, "syllable"], "left")
    return cells.select(*BASE, "corpus", "n_chunks", "rank", "syllable", (F.coalesce("tf", F.lit(0)) * F.col("uidf")).alias("weight"))


def vector_arrays(cells: DataFrame) -> DataFrame:
    """Cells folded to one array per base; the length is the fixed profile size."""
    listed = cells.groupBy(*BASE, "corpus", "n_chunks").agg(F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("cells"))
    return listed.select(*BASE, "corpus", "n_chunks", F.transform("cells", lambda c: c["weight"]).alias("vec"))
