"""Stage two of a search: scoring of candidate chunks by coverage, proximity and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text as T
from lexivane.operators.index import BASE, CHUNK

MIN_ROOT = 3
FAR = 1 << 30
PROXIMITY_SCALE = 8.0


def min_span(lists: Column, used: Column) -> Column:
    """Smallest range that holds one position of every used list; 0 with fewer than two lists.

    One pass over the positions in order, remembering the latest position of each list.
    """
    n_used = F.size(F.filter(used, lambda u: u))
    events = F.flatten(
        F.transform(
            F.arrays_zip(lists.alias("positions"), used.alias("used")),
            lambda x, t: F.when(
                x["used"], F.transform(x["positions"], lambda p: F.struct(p.cast("int").alias("p"), t.alias("t")))
            ).otherwise(F.array().cast("array<struct<p:int,t:int>>")),
        )
    )

    def step(state: Column, event: Column) -> Column:
        last = F.transform(state["last"], lambda v, t: F.when(t == event["t"], event["p"]).otherwise(v))
        seen = F.filter(last, lambda v: v >= 0)
        reach = F.when(F.size(seen) == n_used, event["p"] - F.array_min(seen)).otherwise(F.lit(FAR))
        return F.struct(last.alias("last"), F.least(state["best"], reach).alias("best"))

    start = F.struct(
        F.transform(lists, lambda _: F.lit(-1)).alias("last"), F.lit(FAR).alias("best")
    )
    folded = F.aggregate(F.array_sort(events), start, step)
    return F.when(n_used > 1, folded["best"]).otherwise(F.lit(0))


def term_rows(terms: DataFrame) -> DataFrame:
    """One row per query term, plus an empty one per query that meets the empty word below."""
    empty = F.struct(
        F.lit("").alias("term"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("prefixes"), F.lit("").alias("sx")
    )
    listed = terms.select("query_id", F.posexplode(F.concat(F.array(empty), F.col("terms"))).alias("n", "t"))
    return listed.select(
        "query_id",
        (F.col("n") - 1).alias("term_no"),
        F.substring_index("t.term", "|", 1).alias("first"),
        F.col("t.k").alias("k"),
        F.col("t.prefixes").alias("prefixes"),
        F.coalesce(F.get("t.prefixes", F.least("t.k", F.lit(MIN_ROOT)) - 1), F.lit("")).alias("root"),
        F.col("t.sx").alias("sx"),
    )


def with_coverage(
    candidates: DataFrame, terms: DataFrame, weights: DataFrame, phonetic: bool = False, carry: tuple[str, ...] = ("cos",)
) -> DataFrame:
    """``coverage`` and ``span`` of candidate rows ``query_id, CHUNK, line, *carry``.

    A term matches the start of a word; it is present when all of its syllables match or at least
    three do. Coverage is the share of the term weights that is present. Words meet terms by
    equality on the first syllable and go on only when they hold the root that presence needs; the
    empty word and the empty term keep candidates without any match.
    """
    keys = ["query_id", *CHUNK]
    words = F.concat(T.line_words(F.col("line")), F.array(F.lit("")))
    spread = candidates.select(*keys, *carry, F.posexplode(words).alias("pos", "w"))
    lookup = term_rows(terms)
    depth = F.size(F.filter("prefixes", lambda p: F.startswith(F.concat("w", F.lit("|")), p)))
    columns = [*keys, *carry, "pos", "term_no", "k"]
    met = spread.withColumn("first", F.substring_index("w", "|", 1)).join(lookup, ["query_id", "first"])
    met = met.where(F.startswith(F.concat("w", F.lit("|")), F.col("root"))).select(*columns, depth.alias("m"))
    if phonetic:
        alike = spread.withColumn("sx", F.soundex(F.translate("w", "|", ""))).join(lookup.where("sx <> ''"), ["query_id", "sx"])
        met = met.unionByName(alike.select(*columns, F.col("k").alias("m")))
    carried = [F.first(c).alias(c) for c in carry]
    # one shuffle serves both groupings; the lists are bounded by the words of one chunk
    per_term = (
        met.repartition(*keys)
        .groupBy(*keys, "term_no")
        .agg(F.max("m").alias("best"), F.collect_list(F.struct("m", "pos")).alias("hits"), *carried)
    )
    # every row that got here matches the root or the sound of its term
    present = F.col("term_no") >= 0
    deepest = F.transform(F.filter("hits", lambda h: h["m"] == F.col("best")), lambda h: h["pos"])
    listed = per_term.select(*keys, *carry, F.when(present, F.struct("term_no", deepest.alias("positions"))).alias("found"))
    per_chunk = listed.groupBy(*keys).agg(F.collect_list("found").alias("found"), *carried)
    sizes = terms.select("query_id", F.size("terms").alias("n_terms"))
    weighed = per_chunk.join(sizes, "query_id").join(weights, ["query_id", *BASE], "left")
    total = F.coalesce(F.aggregate(F.map_values("weight_of"), F.lit(0.0), lambda a, w: a + w), F.lit(0.0))
    held = F.aggregate(
        "found", F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at("weight_of", f["term_no"]), F.lit(0.0))
    )
    share = (
        F.when(F.col("n_terms") == 0, F.lit(0.0))
        .when(F.col("total") > 0, held / F.col("total"))
        .otherwise(F.size("found") / F.col("n_terms"))
    )
    lists = F.transform("found", lambda f: f["positions"])
    return weighed.withColumn("total", total).select(
        *keys, *carry, share.alias("coverage"), min_span(lists, F.transform("found", lambda _: F.lit(True))).alias("span")
    )


def sliding_matches(sequence: Column, term: Column) -> Column:
    """Matching syllables of ``term`` at every full alignment of ``sequence``."""
    none = F.array().cast("array<int>")

    def slide(both: Column) -> Column:
        seq, chain = both["seq"], both["chain"]
        k, last = F.size(chain), F.size(seq) - F.size(chain)
        one = lambda p: F.aggregate(
            chain,
            F.struct(p.cast("int").alias("at"), F.lit(0).alias("n")),
            lambda s, c: F.struct((s["at"] + 1).alias("at"), (s["n"] + F.when(F.get(seq, s["at"]) == c, 1).otherwise(0)).alias("n")),
        )["n"]
        return F.when((k > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), last), one)).otherwise(none)

    return T.let(F.struct(sequence.alias("seq"), term.alias("chain")), slide)


def with_matched_filter(candidates: DataFrame) -> DataFrame:
    """Add ``mf``, ``span`` and ``rr``: mean best sliding match of all query words, and proximity.

    Rows need ``line`` and ``q_words`` (``array<array<string>>``).
    """
    return (
        candidates.withColumn("seq", T.line_syllables(F.col("line")))
        .withColumn(
            "slides", F.zip_with("q_words", F.array_repeat("seq", F.size("q_words")), lambda w, seq: sliding_matches(seq, w))
        )
        .withColumn("best", F.transform("slides", lambda s: F.coalesce(F.array_max(s), F.lit(0))))
        .withColumn(
            "positions",
            F.zip_with(
                "slides",
                "best",
                lambda s, b: F.when(
                    F.size(s) > 0,
                    F.transform(
                        F.filter(F.transform(s, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), lambda x: x["m"] == b),
                        lambda x: x["p"],
                    ),
                ).otherwise(F.array(F.lit(0))),
            ),
        )
        .withColumn("fracs", F.zip_with("best", "q_words", lambda b, w: b / F.size(w)))
        .withColumn("n_words", F.size("q_words"))
        .withColumn(
            "mf",
            F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(
                F.aggregate("fracs", F.lit(0.0), lambda a, f: a + f) / F.col("n_words")
            ),
        )
        .withColumn("span", min_span(F.col("positions"), F.transform("q_words", lambda _: F.lit(True))))
        .withColumn("rr", F.col("mf") / (1 + F.col("span") / PROXIMITY_SCALE))
        .drop("line", "seq", "slides", "best", "positions", "fracs", "n_words")
    )
