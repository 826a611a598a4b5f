"""Query side of a search: a small frame of queries, their tokens and their key terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import text as T

PHONETIC_MAX_SYLLABLES = 3


def query_frame(spark: SparkSession, queries) -> DataFrame:
    """``query_id, query`` from a text, a list of texts, or a frame that already has both."""
    if isinstance(queries, DataFrame):
        return queries.select(F.col("query_id").cast("long"), "query")
    listed = [queries] if isinstance(queries, str) else list(queries)
    return spark.createDataFrame(list(enumerate(listed)), "query_id long, query string")


def query_tokens(queries: DataFrame) -> DataFrame:
    """Token counts per query."""
    return (
        queries.select("query_id", F.explode(T.syllable_seq(F.col("query"))).alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count("*").alias("q_tf"))
    )


def key_words(text: Column) -> Column:
    """Words of two or more syllables, or all words when every one has a single syllable."""
    listed = T.line_words(T.syllable_line(text))
    longer = F.filter(listed, lambda w: w.contains("|"))
    return F.when(F.size(longer) > 0, longer).otherwise(listed)


def term_struct(word: Column) -> Column:
    """Everything the rerank needs about a term: prefix marks, size and phonetic code."""
    size = F.size(F.split(word, "\\|"))
    prefixes = F.transform(
        F.sequence(F.lit(1), size), lambda n: F.concat(F.array_join(F.slice(F.split(word, "\\|"), F.lit(1), n), "|"), F.lit("|"))
    )
    code = F.when(size <= PHONETIC_MAX_SYLLABLES, F.soundex(F.translate(word, "|", ""))).otherwise(F.lit(""))
    return F.struct(word.alias("term"), size.alias("k"), prefixes.alias("prefixes"), code.alias("sx"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, query, terms, first, sounds``: key terms in order, duplicates kept."""
    terms = queries.select("query_id", "query", key_words(F.col("query")).alias("key_words")).select(
        "query_id", "query", F.transform("key_words", term_struct).alias("terms")
    )
    return terms.select(
        "*",
        F.array_distinct(F.flatten(F.transform("terms", lambda t: F.slice(t["prefixes"], 1, 1)))).alias("first"),
        F.filter(F.transform("terms", lambda t: t["sx"]), lambda s: s != "").alias("sounds"),
    )


def term_tokens(terms: DataFrame) -> DataFrame:
    """``query_id, term_no, token`` with one row per syllable, duplicates kept."""
    listed = terms.select("query_id", F.posexplode("terms").alias("term_no", "t"))
    return listed.select("query_id", "term_no", F.explode(F.split("t.term", "\\|")).alias("token"))
