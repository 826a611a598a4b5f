"""Order-aware matching of words as syllable chains.

The words to look for are parameters, so their chains fold to constants and every chunk is scanned
once without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivane.functions import text as T
from lexivane.operators.index import BASE, CHUNK, DOC, Index
from lexivane.operators.rerank import sliding_matches


def _framed(text: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), text, F.lit(mark))


def wanted_chains(words: list[str]) -> Column:
    """Constant array of ``struct<query_id, chain>``."""
    return F.array(*[F.struct(F.lit(i).alias("query_id"), T.syllable_seq(F.lit(w)).alias("chain")) for i, w in enumerate(words)])


def every_base(index: Index, words: list[str]) -> DataFrame:
    """One row per base and wanted word."""
    return index.bases.select(*BASE, F.explode(wanted_chains(words)).alias("q")).select(*BASE, "q.query_id", "q.chain")


def bag_scores(index: Index, words: list[str]) -> DataFrame:
    """Per base and word: summed counts of its syllables, the share of them that occurs, and the
    cosine of plain counts, with a verdict."""
    totals = index.postings.groupBy(*BASE, "token").agg(F.sum("tf").alias("n"))
    norms = totals.groupBy(*BASE).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("doc_norm"))
    asked = every_base(index, words)
    known = index.vocab.select("token").distinct().withColumn("known", F.lit(1))
    tokens = asked.select("query_id", *BASE, F.explode("chain").alias("token")).groupBy("query_id", *BASE, "token").agg(
        F.count("*").alias("q_tf")
    )
    counted = tokens.join(known, "token", "left").join(totals, [*BASE, "token"], "left")
    scored = counted.groupBy("query_id", *BASE).agg(
        F.sum(F.col("q_tf") * F.coalesce("n", F.lit(0))).alias("score"),
        (F.sum(F.when(F.col("n") > 0, F.col("q_tf")).otherwise(0)) / F.sum("q_tf")).alias("coverage"),
        F.sqrt(F.sum(F.when(F.col("known") == 1, F.col("q_tf") * F.col("q_tf")).otherwise(0))).alias("q_norm"),
    )
    scale = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(1.0))
    return scored.join(norms, BASE, "left").select(
        "query_id",
        *BASE,
        "score",
        "coverage",
        (F.col("score") / (scale("q_norm") * scale("doc_norm"))).alias("cosine"),
        F.when((F.col("coverage") == 1) & (F.col("score") > 0), "present")
        .when(F.col("score") > 0, "partial")
        .otherwise("absent")
        .alias("verdict"),
    )


def word_chain_hits(index: Index, words: list[str]) -> DataFrame:
    """Per base and word: bigrams of the word that occur and contiguous hits of its whole chain,
    both inside single words of the text."""
    distinct = index.chunks.select(*BASE, F.explode(T.line_words(F.col("line"))).alias("w")).groupBy(*BASE, "w").agg(
        F.count("*").alias("n")
    )
    text = _framed(F.col("w"), "|")
    near = F.filter(
        wanted_chains(words), lambda q: F.exists(q["chain"], lambda s: F.contains(_framed(F.col("w"), "|"), _framed(s, "|")))
    )
    met = distinct.select(*BASE, "w", "n", F.explode(near).alias("q")).select(*BASE, "w", "n", "q.query_id", "q.chain")
    pairs = F.transform(
        F.slice("chain", F.lit(2), F.greatest(F.size("chain") - 1, F.lit(0))),
        lambda right, i: F.concat_ws("|", F.get("chain", i), right),
    )
    whole = F.contains(text, _framed(F.array_join("chain", "|"), "|"))
    aligned = F.size(F.filter(sliding_matches(F.split("w", "\\|"), F.col("chain")), lambda m: m == F.size("chain")))
    rows = met.select(
        "query_id",
        *BASE,
        F.when(whole, aligned * F.col("n")).otherwise(F.lit(0)).alias("hits"),
        F.filter(F.array_distinct(pairs), lambda p: F.contains(text, _framed(p, "|"))).alias("seen"),
    )
    # the seen bigrams of one word are at most its own length
    found = rows.groupBy("query_id", *BASE).agg(
        F.sum("hits").alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_set("seen")))).alias("bigrams")
    )
    filled = every_base(index, words).drop("chain").join(found, ["query_id", *BASE], "left").fillna(0, ["hits", "bigrams"])
    return filled.withColumn(
        "verdict", F.when(F.col("hits") > 0, "exists").when(F.col("bigrams") > 0, "similar").otherwise("absent")
    )


def phrase_positions(index: Index, words: list[str]) -> DataFrame:
    """Start positions of a syllable chain in the sequence of a chunk, word borders ignored."""
    near = F.filter(
        wanted_chains(words),
        lambda q: (F.size(q["chain"]) > 1) & F.contains(_framed(F.translate("line", "|", " "), " "), _framed(F.array_join(q["chain"], " "), " ")),
    )
    # native substring search selects the chunks, the alignment runs only on those
    met = index.chunks.select(*CHUNK, "line", F.explode(near).alias("q")).select(*CHUNK, "line", "q.query_id", "q.chain")
    matches = sliding_matches(T.line_syllables(F.col("line")), F.col("chain"))
    starts = F.filter(
        F.transform(matches, lambda m, p: F.when(m == F.size("chain"), p)), lambda p: p.isNotNull()
    )
    return met.select("query_id", *CHUNK, F.explode(starts).alias("pos"))


def document_phrases(index: Index, phrases: list[str]) -> DataFrame:
    """Start positions of syllable chains in the sequence of a whole document: query_id, collection, base, doc, pos.

    Borders of words and chunks are ignored. Hits inside a piece are found there. For those across a cut, a piece sees
    the last syllables of the pieces before it and its own first ones, as many as the longest chain can reach; only these ends
    are grouped by document, never the lines. A phrase of one syllable or none has no hits.
    """
    reach = max([len(p) for p in phrases], default=1)  # a syllable has a letter at least
    spoken = index.chunks.where("tokens > 0").withColumn("said", T.line_syllables(F.col("line")))
    ends = spoken.select(
        *DOC, "piece", "uid", "tokens",
        F.slice("said", F.lit(1), F.lit(reach)).alias("head"),
        F.slice("said", -F.least(F.size("said"), F.lit(reach)), F.lit(reach)).alias("tail"),
    )
    order = Window.partitionBy(*DOC).orderBy("piece")
    # every piece here has a syllable, so as many pieces as syllables are enough
    laid = ends.withColumn("offset", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.withColumn("before", F.flatten(F.collect_list("tail").over(order.rowsBetween(-reach, -1))))
    laid = laid.withColumn("before", F.slice("before", -F.greatest(F.least(F.size("before"), F.lit(reach)), F.lit(1)), F.lit(reach)))

    def met(df: DataFrame, seq: Column) -> DataFrame:
        held = lambda q: (F.size(q["chain"]) > 1) & F.contains(_framed(F.array_join(seq, " "), " "), _framed(F.array_join(q["chain"], " "), " "))
        found = df.withColumn("q", F.explode(F.filter(wanted_chains(phrases), held)))
        at = F.filter(F.transform(sliding_matches(seq, F.col("q.chain")), lambda m, p: F.when(m == F.size("q.chain"), p)), lambda p: p.isNotNull())
        return found.withColumn("at", F.explode(at))

    across = met(laid.withColumn("seam", F.concat("before", "head")), F.col("seam"))
    across = across.where((F.col("at") < F.size("before")) & (F.col("at") + F.size("q.chain") > F.size("before")))
    across = across.select("q.query_id", *DOC, (F.col("offset") - F.size("before") + F.col("at")).alias("pos"))
    inside = met(spoken.select("uid", "said"), F.col("said")).select("uid", "q.query_id", "at")
    inside = inside.join(laid.select("uid", *DOC, "offset"), "uid").select("query_id", *DOC, (F.col("offset") + F.col("at")).alias("pos"))
    return inside.unionByName(across)


def correlation_curve(index: Index, hits: DataFrame, word: str) -> DataFrame:
    """Share of matching syllables of ``word`` at every offset of the given chunks."""
    chain = T.syllable_seq(F.lit(word))
    lines = index.chunks.select(*CHUNK, "line").join(hits.select(*CHUNK), CHUNK, "left_semi")
    curve = lines.select(*CHUNK, F.posexplode(sliding_matches(T.line_syllables(F.col("line")), chain)).alias("pos", "matched"))
    return curve.select(*CHUNK, "pos", (F.col("matched") / F.size(chain)).alias("fraction"))
