"""Discovery: bases, collections, chunks, sizes, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions import lines
from lexivane.operators.index import BASE, CHUNK, Index
from lexivane.operators.search import resolve_scope

# Bytes that one vector entry and one cached syllable are counted with.
VECTOR_ENTRY_BYTES = 16
SYLLABLE_BYTES = 24


def list_bases(index: Index, collection: str | None = None, match: str = "*") -> DataFrame:
    return resolve_scope(index, collection, match).select(
        "collection", F.col("base").alias("name"), "n_chunks", "vocab_size", "corpus", "generator", F.col("with_text").alias("has_text")
    )


def list_collections(index: Index) -> DataFrame:
    return index.bases.groupBy("collection").agg(F.count("*").alias("bases"))


def stats(index: Index) -> DataFrame:
    """Bases and chunks per collection, with the grand total as the row without a collection."""
    return index.bases.rollup("collection").agg(
        F.count("*").alias("bases"), F.sum("n_chunks").alias("chunks"), F.sum("tokens_total").alias("tokens")
    )


def memory_estimate(index: Index) -> DataFrame:
    """Estimated bytes per base of texts, vectors and cached syllables."""
    texts = index.chunks.groupBy(*BASE).agg(
        F.sum(F.octet_length("text")).alias("text_bytes"), (F.sum("tokens") * SYLLABLE_BYTES).alias("words_bytes")
    )
    vectors = index.postings.groupBy(*BASE).agg((F.count("*") * VECTOR_ENTRY_BYTES).alias("vec_bytes"))
    return texts.join(vectors, BASE, "left").select(*BASE, "text_bytes", F.coalesce("vec_bytes", F.lit(0)).alias("vec_bytes"), "words_bytes")


def chunk_rows(index: Index) -> DataFrame:
    stats_of = index.chunk_stats.select(*CHUNK, "oov", "norm")
    return index.numbered(index.chunks.select(*CHUNK, "start", "len", "tokens", "text").join(stats_of, CHUNK))


def chunk_window(index: Index, chunk_id: int, before: int = 0, after: int = 0, collection=None, base="*") -> DataFrame:
    """Chunks around a number in every base of the scope.

    Document spans are filtered first, so only the texts of a few documents are joined.
    """
    low, high = max(chunk_id - before, 0), chunk_id + after
    return _fetch(index, collection, base, (F.col("first_chunk") <= high) & (F.col("first_chunk") + F.col("n_pieces") > low)).where(
        F.col("chunk").between(low, high)
    )


def chunks_by_id(index: Index, ids: list[int], collection=None, base="*") -> DataFrame:
    """Chunks in the order of ``ids``; numbers out of range are skipped."""
    wanted = index.spark.createDataFrame(list(enumerate(ids)), "position long, chunk long")
    touched = F.exists(
        F.array(*[F.lit(i) for i in ids]), lambda i: (F.col("first_chunk") <= i) & (F.col("first_chunk") + F.col("n_pieces") > i)
    )
    return _fetch(index, collection, base, touched).join(wanted, "chunk")


def _fetch(index: Index, collection, base, touched) -> DataFrame:
    scope = resolve_scope(index, collection, base).select(*BASE)
    spans = index.doc_spans.where(touched).join(scope, BASE).select(*BASE, "doc", "first_chunk")
    stats_of = index.chunk_stats.select(*CHUNK, "oov", "norm")
    rows = index.chunks.select(*CHUNK, "start", "len", "tokens", "text").join(spans, [*BASE, "doc"]).join(stats_of, CHUNK)
    return rows.withColumn("chunk", (F.col("first_chunk") + F.col("piece")).cast("long")).drop("first_chunk")


def check_limits(index: Index, max_bases: int = 0, max_chunks_per_base: int = 0) -> None:
    """Refuse an index beyond its limits; 0 means no limit."""
    if max_bases and index.bases.count() > max_bases:
        raise ValueError(f"more than {max_bases} bases")
    if max_chunks_per_base:
        over = index.bases.where(F.col("n_chunks") > max_chunks_per_base).select(*BASE, "n_chunks").first()
        if over:
            raise ValueError(f"{over['collection']}/{over['base']} has {over['n_chunks']} chunks, limit {max_chunks_per_base}")


def check_incoming(rows: DataFrame, index: Index | None, max_bases: int = 0, max_chunks_per_base: int = 0) -> None:
    """Refuse chunk rows that would take an index beyond its limits, before anything is written."""
    if max_chunks_per_base:
        sizes = rows.where("piece is not null").groupBy(*BASE).agg(F.count("*").alias("n_chunks"))
        over = sizes.where(F.col("n_chunks") > max_chunks_per_base).first()
        if over:
            raise ValueError(f"{over['collection']}/{over['base']} has {over['n_chunks']} chunks, limit {max_chunks_per_base}")
    if max_bases:
        names = rows.select(*BASE).distinct()
        others = 0 if index is None else index.bases.join(names, BASE, "left_anti").count()
        if others + names.count() > max_bases:
            raise ValueError(f"more than {max_bases} bases")


def base_state_hash():
    return F.sha2(F.concat_ws("|", "base", F.col("n_chunks").cast("string"), F.col("vocab_size").cast("string"), "corpus"), 256)


def scope_word_keys(index: Index, collection=None, base="*") -> DataFrame:
    """Distinct word prefix keys of the scope."""
    scope = resolve_scope(index, collection, base).select(*BASE)
    keys = index.chunks.join(scope, BASE).select("line").mapInArrow(lines.distinct_keys, "key string")
    return keys.distinct()
