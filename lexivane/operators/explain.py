"""Why a hit matched: query dimensions, chunk vector and sliding matches of the best chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text as T
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.operators.index import BASE, CHUNK, Index
from lexivane.operators.rerank import sliding_matches


def best_chunks(index: Index, queries: DataFrame, **options) -> DataFrame:
    """Chunk key of the first hit of every query."""
    hits = S.search(index, queries, k=1, snippets=False, with_keys=True, **options)
    return hits.select("query_id", *CHUNK, "chunk", "coverage", "cos")


def query_dims(index: Index, queries: DataFrame, best: DataFrame) -> DataFrame:
    """Known query tokens with their counts and whether the best chunk has them."""
    languages = index.bases.select(*BASE, "language")
    tokens = Q.query_tokens(queries).join(best.select("query_id", *CHUNK), "query_id").join(languages, BASE)
    dims = index.vocab.groupBy(F.col("driver").alias("language"), "token").agg(F.max("dim").alias("dim"))
    known = tokens.join(dims, ["language", "token"])
    held = index.postings.select(*CHUNK, "token", "tf")
    return held.join(known, [*CHUNK, "token"], "right").select(
        "query_id", "token", "dim", F.col("q_tf").alias("count"), F.col("tf").isNotNull().alias("hit"), F.coalesce("tf", F.lit(0)).alias("chunk_count")
    )


def matched_filter(index: Index, queries: DataFrame, best: DataFrame) -> DataFrame:
    """Per query word the offsets of the best chunk that match at least one syllable."""
    words = queries.select("query_id", F.posexplode(T.line_words(T.syllable_line(F.col("query")))).alias("word_no", "w"))
    asked = best.select("query_id", *CHUNK).join(words, "query_id")
    lines = index.chunks.select(*CHUNK, "line").join(asked, CHUNK)
    chain = F.split("w", "\\|")
    slid = lines.select("query_id", "word_no", F.replace("w", F.lit("|"), F.lit("-")).alias("term"), F.size(chain).alias("k"), F.posexplode(sliding_matches(T.line_syllables(F.col("line")), chain)).alias("pos", "matched"))
    return slid.where("matched > 0").select("query_id", "word_no", "term", "k", "pos", (F.col("matched") / F.col("k")).alias("fraction"))


def peaks(points: DataFrame) -> DataFrame:
    """First highest point per word."""
    best = F.max(F.struct("fraction", (-F.col("pos")).alias("early"))).alias("best")
    return points.groupBy("query_id", "word_no", "term", "k").agg(best, F.count("*").alias("points")).select(
        "query_id", "word_no", "term", "k", F.col("best.fraction").alias("peak"), (-F.col("best.early")).alias("peak_pos"), "points"
    )
