"""Keyword-in-context snippets with ``«»`` marks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text as T

WIDTH = 140
LEAD = 35


def _marks(plain: Column, word: Column) -> Column:
    """Start and end of the non-overlapping occurrences of ``word`` in ``plain``."""
    parts = F.split(plain, F.concat(F.lit("\\Q"), word, F.lit("\\E")))
    size = F.length(word)

    def step(state: Column, part: Column) -> Column:
        at = state["at"] + F.length(part)
        return F.struct(
            (at + size).alias("at"),
            F.concat(state["found"], F.array(F.struct(at.alias("a"), (at + size).alias("b")))).alias("found"),
        )

    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    heads = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(heads, start, step)["found"]


def with_snippet(hits: DataFrame, text: str = "text", query: str = "query", fixed_window: bool = False) -> DataFrame:
    """Add ``snippet``. ``fixed_window`` ends the window at ``position - lead + width`` always, as
    the proof-of-concept variant does near the start of a text."""
    flat = F.regexp_replace(T.strip(F.coalesce(F.col(text), F.lit(""))), "(?U)\\s+", " ")
    repeated = lambda column: F.array_repeat(column, F.size("s_words"))
    found = F.filter(F.zip_with("s_words", repeated("s_plain"), lambda w, plain: F.instr(plain, w)), lambda p: p > 0)
    start = F.greatest(F.col("s_at") - 1 - LEAD, F.lit(0))
    end_from = F.col("s_at") - 1 - LEAD if fixed_window else start
    end = F.least(end_from + WIDTH, F.col("s_size"))
    ellipsis = lambda on: F.when(on, F.lit("…")).otherwise(F.lit(""))
    plain_cut = F.concat(F.left("s_flat", F.lit(WIDTH)), ellipsis(F.col("s_size") > WIDTH))
    centred = F.concat(
        ellipsis(start > 0),
        T.strip(F.substring("s_flat", start + 1, end - start)),
        ellipsis(end < F.col("s_size")),
    )
    mark = lambda out, m: F.concat(
        F.left(out, m["a"]), F.lit("«"), F.substring(out, m["a"] + 1, m["b"] - m["a"]), F.lit("»"),
        F.substring(out, m["b"] + 1, F.length(out)),
    )
    return (
        hits.withColumn("s_words", F.transform(T.words(F.col(query)), T.normalize))
        .withColumn("s_flat", flat)
        .withColumn("s_size", F.length("s_flat"))
        .withColumn("s_plain", T.normalize(F.col("s_flat")))
        .withColumn("s_at", F.get(found, 0))
        .withColumn("s_cut", F.when(F.col("s_at").isNull(), plain_cut).otherwise(centred))
        .withColumn("s_cut_plain", T.normalize(F.col("s_cut")))
        .withColumn(
            "s_marks",
            F.reverse(F.array_sort(F.array_distinct(F.flatten(F.zip_with("s_words", repeated("s_cut_plain"), lambda w, plain: _marks(plain, w)))))),
        )
        .withColumn("snippet", F.aggregate("s_marks", F.col("s_cut"), mark))
        .drop("s_words", "s_flat", "s_size", "s_plain", "s_at", "s_cut", "s_cut_plain", "s_marks")
    )
