"""Query expansion, absence report, did-you-mean and literal fallback."""

from __future__ import annotations

from collections.abc import Callable

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions import lines
from lexivane.functions import text as T
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.operators.catalog import scope_word_keys
from lexivane.operators.index import BASE, CHUNK, Index

MAX_EXPANSIONS = 12
ORIGINAL_BONUS = 0.001
SUGGESTIONS = 6
CONTEXT = 100


def content_words(query):
    """White-space words with two or more syllables, or all words when none has."""
    listed = F.filter(F.split(T.normalize_query(query), " "), lambda w: w != "")
    letters = lambda w: T.syllable_line(F.regexp_replace(w, f"[^{T.WORD_CHARS}]", ""))
    longer = F.filter(listed, lambda w: letters(w).contains("|"))
    return F.when(F.size(longer) > 0, longer).otherwise(listed)


def dictionary_expansions(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``query_id, variant_no, variant``: the first twelve distinct synonyms of the content words.

    ``synonyms(w, s)`` holds the active dictionaries, one row per word.
    """
    words = queries.select("query_id", F.posexplode(content_words(F.col("query"))).alias("word_no", "w"))
    listed = synonyms.join(words, "w").select("query_id", "word_no", "w", F.posexplode("s").alias("syn_no", "syn"))
    cleaned = listed.withColumn("syn", T.strip(F.col("syn"))).withColumn("low", F.lower("syn"))
    cleaned = cleaned.where((F.col("syn") != "") & (F.col("low") != F.col("w")))
    first = cleaned.groupBy("query_id", "low").agg(F.min(F.struct("word_no", "syn_no", "syn")).alias("at"))
    # query words and their dictionary entries only
    w = Window.partitionBy("query_id").orderBy("at")
    ranked = first.withColumn("variant_no", F.row_number().over(w)).where(F.col("variant_no") <= MAX_EXPANSIONS)
    return ranked.select("query_id", "variant_no", F.col("at.syn").alias("variant"))


def cached_expansions(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Variants kept for a normalized query: ``cache(query_key, variants)``."""
    keyed = queries.withColumn("query_key", T.normalize_query(F.col("query")))
    rows = cache.join(keyed, "query_key").select("query_id", F.posexplode("variants").alias("n", "variant"))
    return rows.select("query_id", (F.col("n") + 1).alias("variant_no"), "variant")


def expansions(
    queries: DataFrame,
    synonyms: DataFrame | None = None,
    cache: DataFrame | None = None,
    expander: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """First non-empty step per query: dictionaries, cache, then a pluggable ``expander``."""
    empty = queries.select("query_id", F.lit(0).alias("variant_no"), F.lit("").alias("variant"), F.lit("").alias("source")).where("false")
    steps = []
    if synonyms is not None:
        steps.append(("dict", lambda left: dictionary_expansions(left, synonyms)))
    if cache is not None:
        steps.append(("cache", lambda left: cached_expansions(left, cache)))
    if expander is not None:
        steps.append(("custom", expander))
    found = empty
    for source, step in steps:
        left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
        found = found.unionByName(step(left).withColumn("source", F.lit(source)))
    return found


def _anchored(index: Index, texts: DataFrame, id_columns: list[str], text: str, collection, base) -> DataFrame:
    """Ids of texts with at least one word whose prefix key occurs in the scope."""
    keys = texts.select(*id_columns, F.explode(F.transform(T.line_words(T.syllable_line(F.col(text))), T.word_key)).alias("key"))
    return keys.join(scope_word_keys(index, collection, base), "key").select(*id_columns).distinct()


def split_by_scope(index: Index, queries: DataFrame, variants: DataFrame, collection=None, base="*") -> DataFrame:
    """Original queries (variant 0) and variants with ``kept``: whether they can match the scope."""
    originals = queries.select("query_id", F.lit(0).alias("variant_no"), F.col("query").alias("variant"), F.lit("original").alias("source"))
    every = originals.unionByName(variants.select("query_id", "variant_no", "variant", "source"))
    ids = ["query_id", "variant_no"]
    hit = _anchored(index, every, ids, "variant", collection, base).withColumn("kept", F.lit(True))
    return every.join(hit, ids, "left").fillna(False, ["kept"])


def suggest_terms(index: Index, missing: DataFrame, collection=None, base="*", limit: int = SUGGESTIONS) -> DataFrame:
    """Words of the scope closest to absent terms ``missing(query_id, term)``.

    Order: same sound, shared syllables, edit distance, length, then the word itself.
    """
    terms = missing.groupBy("query_id").agg(
        F.collect_set(T.soundex(F.col("term"))).alias("sounds"),
        F.array_distinct(F.flatten(F.collect_list(T.syllable_seq(F.col("term"))))).alias("syllables"),
        F.collect_set(T.normalize(F.col("term"))).alias("plain"),
    )
    scope = S.resolve_scope(index, collection, base).select(*BASE)
    distinct = (
        index.chunks.join(scope, BASE)
        .select(T.word_line(F.col("text")))
        .mapInArrow(lines.distinct_words, "word string")
        .where(F.length("word") >= 3)
        .distinct()
    )
    # a row per word and reason to be close; both sides meet in one join on sound or syllable
    sound = lambda sx: F.struct(F.lit("sound").alias("kind"), sx.alias("value"))
    syllable = lambda s: F.struct(F.lit("syllable").alias("kind"), s.alias("value"))
    syls = T.syllable_seq(F.col("word"))
    own = F.concat(F.array(sound(T.soundex(F.col("word")))), F.transform(syls, syllable))
    words = distinct.select("word", F.explode(own).alias("key"))
    asked = terms.select("query_id", F.explode(F.concat(F.transform("sounds", sound), F.transform("syllables", syllable))).alias("key"))
    met = words.join(asked.where("key.value <> ''"), "key").groupBy("query_id", "word").agg(
        F.max(F.when(F.col("key.kind") == "sound", 1).otherwise(0)).alias("same_sound"),
        F.sum(F.when(F.col("key.kind") == "syllable", 1).otherwise(0)).cast("int").alias("shared"),
    )
    # distances decide only among words that reach the sound and syllables of the last one that can be shown
    close = Window.partitionBy("query_id").orderBy(F.desc("same_sound"), F.desc("shared"))
    left = met.withColumn("place", F.rank().over(close)).where(F.col("place") <= limit).drop("place")
    scored = left.join(terms.select("query_id", "plain"), "query_id").select(
        "query_id", "word", "same_sound", "shared",
        F.array_min(F.transform("plain", lambda p: F.levenshtein(T.normalize(F.col("word")), p))).alias("distance"),
    )
    order = [F.desc("same_sound"), F.desc("shared"), F.asc("distance"), F.length("word").asc(), F.asc("word")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def explained_absence(index: Index, split: DataFrame, collection=None, base="*") -> DataFrame:
    """``query_id, absent, dropped, did_you_mean`` of the queries in ``split``, which tells what can match the scope."""
    state = split.groupBy("query_id").agg(
        (~F.bool_or("kept")).alias("absent"),
        F.sort_array(F.collect_list(F.when((F.col("variant_no") > 0) & ~F.col("kept"), F.col("variant")))).alias("dropped"),
    )
    missing = split.join(state.where("absent").select("query_id"), "query_id", "left_semi").select("query_id", F.col("variant").alias("term"))
    near = suggest_terms(index, missing, collection, base).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("near")
    )
    return state.join(near, "query_id", "left").select(
        "query_id", "absent", "dropped", F.coalesce(F.transform("near", lambda n: n["word"]), F.array().cast("array<string>")).alias("did_you_mean")
    )


def absence_report(index: Index, queries: DataFrame, variants: DataFrame, collection=None, base="*") -> DataFrame:
    """Queries that nothing anchors in the scope, with their dropped variants and suggestions."""
    split = split_by_scope(index, queries, variants, collection, base)
    explained = explained_absence(index, split, collection, base)
    return queries.join(explained, "query_id").select("query_id", "query", "absent", "dropped", "did_you_mean")


def search_expand(
    index: Index,
    queries,
    synonyms: DataFrame | None = None,
    cache: DataFrame | None = None,
    expander: Callable[[DataFrame], DataFrame] | None = None,
    collection: str | None = None,
    base: str = "*",
    k: int = 8,
    phonetic: bool = False,
) -> DataFrame:
    """Search originals and kept variants in one batch, then rank by the original query.

    ``var_cov`` is the best coverage a chunk got from any variant, with a small bonus for the
    original; the shown coverage and span are always those of the original query.
    """
    queries = Q.query_frame(index.spark, queries)
    variants = expansions(queries, synonyms, cache, expander)
    kept = split_by_scope(index, queries, variants, collection, base).where("kept")
    return search_kept(index, queries, kept, collection, base, k, phonetic)


def search_kept(index: Index, queries: DataFrame, kept: DataFrame, collection: str | None = None, base: str = "*", k: int = 8, phonetic: bool = False) -> DataFrame:
    """The search of :func:`search_expand` for originals and variants ``kept(query_id, variant_no, variant)``."""
    numbered = kept.select("query_id", "variant_no", F.col("variant").alias("query")).withColumn("batch_id", F.monotonically_increasing_id())
    batch = index.store.save(f"expanded_queries-{uuid.uuid4().hex}", numbered)  # earlier calls keep theirs
    asked = batch.select(F.col("batch_id").alias("query_id"), "query")
    found = S.search(index, asked, collection, base, k=k, phonetic=phonetic, snippets=False, with_keys=True)
    found = found.withColumnRenamed("query_id", "batch_id").join(batch.select("batch_id", "query_id", "variant_no"), "batch_id")
    weighted = F.coalesce("coverage", "matchpoint") + F.when(F.col("variant_no") == 0, ORIGINAL_BONUS).otherwise(0.0)
    best = found.withColumn("var_cov", weighted)
    w = Window.partitionBy("query_id", *CHUNK).orderBy(F.round("var_cov", 9).desc(), F.asc("variant_no"))
    best = best.withColumn("n", F.row_number().over(w)).where("n = 1")
    candidates = S.chosen(index, best.select("query_id", *CHUNK, "uid", "cos", "var_cov", "variant_no", "chunk", "corpus", "path"))
    scope = S.open_scope(index, collection, base)
    carry = ("cos", "var_cov", "variant_no", "chunk", "corpus", "path")
    rescored = S.scored_candidates(index, scope, queries, candidates, phonetic, carry)
    order = [F.round("coverage", 9).desc(), F.round("var_cov", 9).desc(), F.asc("span"), (F.col("variant_no") == 0).desc(), F.asc("collection"), F.asc("base"), F.asc("chunk")]
    top = rescored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    # named from the written batch: ``kept`` would look through the scope again
    names = batch.select("query_id", "variant_no", F.when(F.col("variant_no") == 0, "original").otherwise(F.col("query")).alias("via"))
    return top.join(names, ["query_id", "variant_no"]).select(
        "query_id", "rank", *BASE, "corpus", "path", "chunk", F.col("coverage").alias("matchpoint"), "coverage", "span", "cos", "var_cov", "via", "start"
    )


def literal_fallback(index: Index, query: str, collection=None, base="*", k: int = 8) -> DataFrame:
    """Substring search for the identifiers with digits in ``query``."""
    needles = T.alnum_needles(F.lit(query))
    scope = S.resolve_scope(index, collection, base).select(*BASE)
    low = F.lower("text")
    rows = index.chunks.select(*CHUNK, "start", "text", low.alias("low")).withColumn(
        "needles", F.filter(needles, lambda n: F.contains(F.col("low"), n))
    )
    found = rows.where(F.size("needles") > 0).join(scope, BASE)
    at = F.instr("low", F.get("needles", 0)) - 1
    begin = F.greatest(at - CONTEXT, F.lit(0))
    end = F.least(at + F.length(F.get("needles", 0)) + CONTEXT, F.length("text"))
    scored = found.withColumn("score", F.size("needles") / F.size(needles)).withColumn(
        "snippet", F.concat(F.lit("…"), F.substring("text", begin + 1, end - begin), F.lit("…"))
    )
    order = [F.desc("score"), F.size("needles").desc(), F.asc("collection"), F.asc("base"), F.asc("doc"), F.asc("piece")]
    # a global top k: every task keeps only k rows before the merge
    top = scored.orderBy(*order).limit(k)
    w = Window.orderBy(*order)
    ranked = top.withColumn("rank", F.row_number().over(w))
    return index.numbered(ranked).select(
        "rank", *BASE, F.col("score").alias("matchpoint"), F.col("score").alias("coverage"), F.size("needles").alias("span"),
        F.lit(0.0).alias("cos"), "chunk", "start", "snippet", F.col("needles").alias("needles_matched"), F.lit("literal_fallback").alias("via"),
    )
