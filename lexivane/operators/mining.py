"""Level-zero mining: distilled statistics per collection, refreshed only when the bases change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators import profile as P
from lexivane.operators.catalog import base_state_hash
from lexivane.operators.index import BASE, Index

PROFILE_SIZE = 40


def source_hashes(bases: DataFrame) -> DataFrame:
    """Hash per collection over the sorted state hashes of its bases.

    Long lists are hashed per bucket first, so a collection with very many bases stays spread out.
    """
    hashed = bases.select("collection", base_state_hash().alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ","), 256)
    buckets = hashed.groupBy("collection", "bucket").agg(joined("h").alias("h"))
    return buckets.groupBy("collection").agg(joined("h").alias("source_hash"))


def root_index(index: Index, top: int = PROFILE_SIZE) -> DataFrame:
    """Lexical identity: the salient roots of a collection with its sizes."""
    sizes = P.fingerprint(index)
    vocab = P.union_vocabulary(index).groupBy("collection").agg(F.count("*").alias("unified_vocab_size"))
    roots = P.collection_profile(index, top).groupBy("collection").agg(
        F.sort_array(F.collect_list(F.struct("rank", "dim", "syllable", "uidf"))).alias("salient_roots")
    )
    return sizes.join(vocab, "collection").join(roots, "collection", "left")


def corpus_rows(index: Index, top: int = PROFILE_SIZE) -> DataFrame:
    """Anatomy: one row per base with its sizes and its vector on the salient roots."""
    vectors = P.vector_arrays(P.base_vectors(index, top)).select(*BASE, "vec")
    return index.bases.select(*BASE, "corpus", "n_chunks", "vocab_size").join(vectors, BASE, "left")


def mine(index: Index, previous: DataFrame | None = None, enabled: list[str] | None = None, force: bool = False) -> DataFrame:
    """Knowledge records of the enabled collections whose source hash changed.

    ``previous(collection, source_hash)`` holds the last cycle; without it all collections count as
    changed. A record is bounded; what the anatomy says of each base are the rows of :func:`corpus_rows`, whose
    vectors follow the order of ``salient_roots``.
    """
    hashes = source_hashes(index.bases)
    if enabled is not None:
        hashes = hashes.where(F.col("collection").isin(enabled))
    if previous is not None and not force:
        seen = previous.select("collection", "source_hash")
        hashes = hashes.join(seen, ["collection", "source_hash"], "left_anti")
    roots = root_index(index)
    return hashes.join(roots, "collection").select(
        "collection",
        F.lit(0).alias("level"),
        "source_hash",
        F.current_timestamp().alias("updated"),
        F.struct(
            F.concat(F.lit("l0-"), F.left("source_hash", F.lit(8))).alias("digestion_id"),
            F.lit("level0/no-ai").alias("via"),
            F.current_timestamp().alias("at"),
            F.struct(F.col("n_bases").alias("bases"), "total_chunks", "source_hash").alias("inputs"),
        ).alias("provenance"),
        F.array(
            F.struct(F.lit("RootIndex").alias("type"), F.lit(0).alias("level"), F.to_json(F.struct("n_bases", "total_chunks", "unified_vocab_size", "salient_roots")).alias("content")),
            F.struct(F.lit("CorpusDict").alias("type"), F.lit(0).alias("level"), F.to_json(F.struct("unified_vocab_size", "n_bases")).alias("content")),
        ).alias("knowledge"),
    )


def filter_knowledge(records: DataFrame, collection: str | None = None, kind: str | None = None, level: int | None = None) -> DataFrame:
    """Records with their knowledge items filtered by type and level."""
    rows = records.where(F.col("collection") == collection) if collection else records

    def wanted(item):
        keep = F.lit(True)
        if kind is not None:
            keep = keep & (item["type"] == kind)
        if level is not None:
            keep = keep & (item["level"] == level)
        return keep

    return rows.withColumn("knowledge", F.filter("knowledge", wanted))
