"""Expansion cascade: dictionaries, cache, a pluggable expander, then literal search; the first step that gives anything decides.

All queries of a call go through the steps together. What a step found is written before the next one takes the queries
that are left, so the expander is called once and for these only, and its variants go to the cache.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions import text as T
from lexivane.operators import expand as E
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.operators.index import BASE, CHUNK, Index
from lexivane.plans.store import TableStore

VARIANTS = "query_id long, variant_no int, variant string, source string"
NEEDLES_AT_ONCE = 200


class ExpansionCache:
    """Variants by normalized query. An upsert writes its rows as a new version; the newest version of a query counts."""

    def __init__(self, store: TableStore, name: str = "expansion_cache"):
        self.store = store
        self.name = name
        self.version = 0

    def upsert(self, rows: DataFrame) -> None:
        """``rows(query_key, variants)``, one for each key."""
        self.store.save(f"{self.name}/version={self.version + 1}", rows.select("query_key", "variants"))
        self.version += 1

    def current(self) -> DataFrame:
        schema = "query_key string, variants array<string>, version long"
        spark = self.store.spark
        if not self.version:
            return spark.createDataFrame([], schema).drop("version")
        written = [self.store.path(f"{self.name}/version={v}") for v in range(1, self.version + 1)]
        rows = spark.read.schema(schema).option("basePath", self.store.path(self.name)).parquet(*written)
        return rows.groupBy("query_key").agg(F.max_by("variants", "version").alias("variants"))


@dataclass
class Cascade:
    """``outcome``: query_id, query, source, expansions, absent, dropped, did_you_mean; ``hits`` as of a search, with ``source``."""

    outcome: DataFrame
    hits: DataFrame


def literal_hits(index: Index, queries: DataFrame, collection=None, base="*", k: int = 8) -> DataFrame:
    """The ``k`` best chunks of every query by the identifiers with digits that they hold.

    Substrings meet no equality join, so the identifiers of the query set go to the scan as literals, in blocks; a
    chunk row leaves the scan only if it holds one. A query is then met by its identifiers.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.alnum_needles(F.col("query")))).alias("needle"))
    wanted = index.store.save(f"literal_needles-{uuid.uuid4().hex}", wanted)
    needles = sorted(r["needle"] for r in wanted.select("needle").distinct().collect())  # of the asked queries only
    scope = S.resolve_scope(index, collection, base).select(*BASE)
    low = index.chunks.join(scope, BASE).select(*CHUNK, F.lower("text").alias("low"))
    found = None
    for at in range(0, len(needles), NEEDLES_AT_ONCE):
        some = F.array(*[F.lit(n) for n in needles[at : at + NEEDLES_AT_ONCE]])
        held = low.select(*CHUNK, F.explode(F.filter(some, lambda n: F.contains(F.col("low"), n))).alias("needle"))
        found = held if found is None else found.unionByName(held)
    if found is None:
        found = low.select(*CHUNK, F.lit("").alias("needle")).where("false")
    asked = wanted.groupBy("query_id").agg(F.count("*").alias("n_needles"))
    scored = found.join(wanted, "needle").groupBy("query_id", *CHUNK).agg(F.count("*").alias("span")).join(asked, "query_id")
    order = [F.desc("span"), F.asc("collection"), F.asc("base"), F.asc("doc"), F.asc("piece")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    share = F.col("span") / F.col("n_needles")
    return index.numbered(ranked).select("query_id", "rank", *BASE, "chunk", share.alias("coverage"), F.col("span").cast("int").alias("span"), F.lit("literal_fallback").alias("via"))


def cascade(
    index: Index,
    queries,
    synonyms: DataFrame | None = None,
    cache: ExpansionCache | None = None,
    expander: Callable[[DataFrame], DataFrame] | None = None,
    collection: str | None = None,
    base: str = "*",
    k: int = 8,
    phonetic: bool = False,
) -> Cascade:
    """Expand, search and explain all queries.

    ``source`` is dict, cache, custom, literal_fallback, or none where no step gave anything. Expanded queries of which neither the
    original nor a variant can match the scope are ``absent`` and come with suggestions. An expander gets ``query_id, query`` of the queries that
    dictionaries and cache left, and returns ``query_id, variant_no, variant``.
    """
    call = uuid.uuid4().hex
    save = lambda name, df: index.store.save(f"cascade_{name}-{call}", df)
    asked = save("asked", Q.query_frame(index.spark, queries))
    steps = []
    if synonyms is not None:
        steps.append(("dict", lambda left: E.dictionary_expansions(left, synonyms)))
    if cache is not None and cache.version:
        steps.append(("cache", lambda left: E.cached_expansions(left, cache.current())))
    if expander is not None:
        steps.append(("custom", expander))
    variants = index.spark.createDataFrame([], VARIANTS)
    left = asked
    for source, step in steps:
        found = step(left).select(F.col("query_id").cast("long"), F.col("variant_no").cast("int"), "variant", F.lit(source).alias("source"))
        found = save(source, found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
        variants = variants.unionByName(found)
        if source == "custom" and cache is not None:
            listed = F.transform(F.sort_array(F.collect_list(F.struct("variant_no", "variant"))), lambda v: v["variant"])
            fresh = found.groupBy("query_id").agg(listed.alias("variants")).join(asked, "query_id")
            cache.upsert(fresh.groupBy(T.normalize_query(F.col("query")).alias("query_key")).agg(F.min_by("variants", "query_id").alias("variants")))
    variants, left = save("variants", variants), save("left", left)
    expanded = asked.join(left.select("query_id"), "query_id", "left_anti")
    split = save("split", E.split_by_scope(index, expanded, variants, collection, base))

    literal = save("literal", literal_hits(index, left, collection, base, k))
    found = E.search_kept(index, expanded, split.where("kept").drop("kept"), collection, base, k, phonetic)
    sources = variants.select("query_id", "source").distinct()
    columns = ["query_id", "rank", *BASE, "chunk", "coverage", "span", "via"]
    hits = found.join(sources, "query_id").select(*columns, "source").unionByName(literal.select(*columns, F.lit("literal_fallback").alias("source")))

    listed = variants.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("variant_no", "variant"))), lambda v: v["variant"]).alias("expansions"))
    explained = E.explained_absence(index, split, collection, base)
    literal_ones = literal.select("query_id", F.lit("literal_fallback").alias("by_literal")).distinct()
    none = F.array().cast("array<string>")
    outcome = asked.join(sources, "query_id", "left").join(literal_ones, "query_id", "left").join(listed, "query_id", "left").join(explained, "query_id", "left").select(
        "query_id", "query", F.coalesce("source", "by_literal", F.lit("none")).alias("source"), F.coalesce("expansions", none).alias("expansions"),
        F.coalesce("absent", F.lit(False)).alias("absent"), F.coalesce("dropped", none).alias("dropped"), F.coalesce("did_you_mean", none).alias("did_you_mean"),
    )
    return Cascade(outcome, hits)
