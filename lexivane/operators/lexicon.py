"""Corpus statistics over words and syllables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexivane.functions import lines
from lexivane.functions import text as T
from lexivane.operators.index import BASE, CHUNK, Index
from lexivane.operators.ordering import running_sums
from lexivane.plans.sizing import spread
from lexivane.plans.store import TableStore
from lexivane.sources.vocabulary import token_dims


def word_counts(docs: DataFrame) -> DataFrame:
    return spread(docs.select("text")).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def syllable_counts(docs: DataFrame, accents: bool = True) -> DataFrame:
    line = T.accented_line(F.col("text")) if accents else T.syllable_line(F.col("text"))
    listed = spread(docs.select("text")).select(F.explode(T.line_syllables(line)).alias("syllable"))
    return listed.groupBy("syllable").agg(F.count("*").alias("n"))


def lexicon(words: DataFrame) -> DataFrame:
    """Scalar functions over distinct words."""
    line = T.syllable_line(F.col("word"))
    return words.select(
        "word",
        T.normalize(F.col("word")).alias("normalized"),
        F.array_join(T.syllabify(F.col("word")), "-").alias("syllables"),
        F.size(T.line_syllables(line)).alias("n_syllables"),
        T.soundex(F.col("word")).alias("phonetic"),
        F.translate(T.word_key(line), T.KEY_SEPARATOR, "+").alias("prefix_key"),
    )


def zipf_table(store: TableStore, counts: DataFrame) -> DataFrame:
    """Rank, frequency and cumulative share per syllable; ties rank by syllable."""
    # names of their own: frames of earlier calls stay readable
    run = uuid.uuid4().hex
    saved = store.save(f"syllable_counts-{run}", counts.withColumn("one", F.lit(1)))
    order = [F.desc("n"), F.asc("syllable")]
    ranked = running_sums(store, f"zipf-{run}", saved, [], order, {"above": "one", "mass_above": "n"})
    total = saved.agg(F.sum("n")).scalar()
    return ranked.select(
        "syllable",
        "n",
        (F.col("above") + 1).alias("rank"),
        (F.col("n") / total).alias("freq"),
        ((F.col("mass_above") + F.col("n")) / total).alias("cumulative"),
    )


def zipf_exponent(table: DataFrame) -> DataFrame:
    """Exponent of the log-log fit of counts against ranks."""
    return table.agg((-F.regr_slope(F.log("n"), F.log("rank"))).alias("exponent"), F.count("*").alias("n_syllables"))


def zipf_coverage(table: DataFrame, tops=(50, 100, 200)) -> DataFrame:
    """Share of all occurrences that the most frequent syllables cover."""
    covered = [F.struct(F.lit(t).alias("top_n"), F.sum(F.when(F.col("rank") <= t, F.col("freq"))).alias("covered")) for t in tops]
    return table.agg(F.array(*covered).alias("rows")).select(F.explode("rows").alias("r")).select("r.top_n", "r.covered")


def active_dims(index: Index) -> DataFrame:
    """Active dimensions and sparsity per base."""
    used = index.idf.groupBy(*BASE).agg(F.count("*").alias("active_dims"))
    sizes = index.bases.select(*BASE, "vocab_size")
    active = F.coalesce("active_dims", F.lit(0))
    return sizes.join(used, BASE, "left").select(
        *BASE, active.alias("active_dims"), "vocab_size", (1 - active / F.col("vocab_size")).alias("sparsity")
    )


def out_of_vocabulary(index: Index) -> DataFrame:
    """Counts of the tokens that no dimension covers."""
    entries = index.chunks.select("driver", F.explode("hist").alias("e")).select("driver", "e.token", "e.tf")
    known = token_dims(index.vocab).select("driver", "token")
    missing = entries.join(known, ["driver", "token"], "left_anti")
    return missing.groupBy("token").agg(F.sum("tf").alias("n"))


def bigram_counts(index: Index) -> DataFrame:
    """Adjacent syllables inside a word."""
    words = index.chunks.select(F.explode(T.line_words(F.col("line"))).alias("w")).where(F.col("w").contains("|"))
    parts = words.select(F.split("w", "\\|").alias("s"))
    pairs = F.transform(F.slice("s", F.lit(2), F.size("s")), lambda right, i: F.struct(F.get("s", i).alias("first"), right.alias("second")))
    return parts.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def tfidf_weights(index: Index, classic: bool = False) -> DataFrame:
    """Non-zero tf-idf weights of every chunk."""
    from lexivane.operators.index import classic_idf

    value = classic_idf(F.col("n_chunks"), F.col("df")) if classic else F.col("idf_exact")
    idf = index.idf.select(*BASE, "token", value.alias("idf"))
    weighed = index.postings.join(idf, BASE + ["token"]).withColumn("weight", F.col("tf") * F.col("idf"))
    return weighed.where("weight <> 0").select(*CHUNK, "token", "dim", "weight")


def positions(index: Index) -> DataFrame:
    """Positional index: one row per token occurrence, positions counted inside the chunk."""
    return index.chunks.select(*CHUNK, F.posexplode(T.line_syllables(F.col("line"))).alias("pos", "token"))


def position_lists(index: Index, numbered: bool = False) -> DataFrame:
    """Ascending positions per chunk and token, formed inside the row of the chunk.

    ``numbered`` adds ``chunk``, which a chunk row gets before it is spread to a row per token.
    """
    rows = index.chunks.select(*CHUNK, "line")
    rows = index.numbered(rows) if numbered else rows
    kept = [f for f in rows.schema.fields if f.name != "line"]
    return rows.mapInArrow(lines.with_positions, StructType(kept).add("token", "string").add("positions", lines.POSITIONS))


def position_gaps(index: Index, numbered: bool = False) -> DataFrame:
    """Distances between neighbouring positions of a token in a chunk; the first counts from 0."""
    gap = lambda p, i: p - F.when(i > 0, F.get("positions", i - 1)).otherwise(0)
    return position_lists(index, numbered).withColumn("gaps", F.transform("positions", gap))


def seek_positions(lists: DataFrame, target: int) -> DataFrame:
    """First position at or after ``target`` in each list, with its index; size of the list if none."""
    at = F.size(F.filter("positions", lambda p: p < target))
    return lists.withColumn("seek_index", at).withColumn("seek_position", F.get("positions", at))


def dense_base_vectors(index: Index) -> DataFrame:
    """Whole vector of every base in dimension order, zeros included."""
    counts = index.postings.groupBy(*BASE, "dim").agg(F.sum("tf").alias("n"))
    dims = index.vocab.select(F.col("driver").alias("language"), "dim", "token")
    every = index.bases.select(*BASE, "language").join(dims, "language")
    return every.join(counts, [*BASE, "dim"], "left").select(*BASE, "dim", "token", F.coalesce("n", F.lit(0)).alias("n"))
