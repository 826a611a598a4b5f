"""The text functions by name, for queries written in SQL.

Scalar functions are SQL functions whose bodies come from the column expressions of ``functions.text``, so Catalyst
inlines them and there is one definition of each. ``chunks`` is a table function and runs in Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import chunking
from lexivane.functions import text as T

SCALARS: dict[str, Callable[[Column], Column]] = {
    "normalized": T.normalize,
    "text_words": T.words,
    "syllable_line": T.syllable_line,
    "syllables": T.syllable_seq,
    "phonetic_code": T.soundex,
    "query_key": T.normalize_query,
}


class Chunks:
    """``chunks(text, size)``: number, start and trimmed text of the pieces of a text; none for a null text."""

    def eval(self, text: str | None, size: int) -> Iterator[tuple[int, int, str]]:
        if text is not None:
            for piece, (start, part) in enumerate(chunking.text_pieces(text, size)):
                yield piece, start, part


def body(spark: SparkSession, function: Callable[[Column], Column]) -> tuple[str, str]:
    """Type and SQL text of a function of ``value``."""
    applied = spark.createDataFrame([], "value string").select(function(F.col("value")).alias("result"))
    expression = applied._jdf.queryExecution().analyzed().expressions().head().child()
    return applied.schema["result"].dataType.simpleString(), expression.sql()


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; those of an earlier call are replaced."""
    for name, function in SCALARS.items():
        returned, expression = body(spark, function)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS {returned} RETURN {expression}")
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="piece int, start bigint, text string"))
