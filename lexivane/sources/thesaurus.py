"""Synonym dictionaries: source parsers, cleaning, composition, JSON-lines sink and reader.

Every parser yields rows ``w, s, at`` with one synonym per row and its place in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.functions import text as T

# a hint in brackets with the blanks around it
HINT = "[ \\t]*[(][^()]*[)][ \\t]*"


def _terms(line, separator: str):
    cleaned = F.transform(F.split(line, separator), T.clean_term)
    return F.filter(cleaned, lambda t: t != "")


def parse_comma_lines(lines: DataFrame) -> DataFrame:
    """``root,related,related,...`` lines: the root maps to the rest."""
    rows = lines.select(_terms(F.col("value"), ",").alias("t")).where(F.size("t") > 1)
    return rows.select(F.get("t", 0).alias("w"), F.posexplode(F.slice("t", F.lit(2), F.size("t"))).alias("at", "s"))


def parse_synsets(lines: DataFrame) -> DataFrame:
    """``a;b;c`` lines: every term maps to the others of its own line. Hints in brackets are dropped.

    Work stays inside one line, so no pairs across lines are ever formed.
    """
    bare = lines.where(~F.col("value").startswith("#")).select(F.regexp_replace("value", HINT, "").alias("value"))
    rows = bare.select(_terms(F.col("value"), ";").alias("t")).where(F.size("t") > 1)
    heads = rows.select("t", F.posexplode("t").alias("i", "w"))
    others = heads.select("w", F.filter(F.transform("t", lambda x, j: F.when(j != F.col("i"), x)), lambda x: x.isNotNull()).alias("others"))
    return others.select("w", F.posexplode("others").alias("at", "s"))


def parse_entries(files: DataFrame) -> DataFrame:
    """Dictionary files whose entries are ``word|N`` followed by N sense lines ``(pos)|syn|syn``.

    ``files`` has whole texts, one per row; equal files stay apart. The first line is the encoding name. A line
    whose last field is a number opens an entry, unless its first field is empty or nothing but a hint in brackets.
    """
    fields = F.split(F.col("line"), "\\|")
    listed = files.withColumn("file", F.monotonically_increasing_id()).select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("n", "line")).where("n > 0")
    split = listed.select("file", "n", fields.alias("f"))
    word = T.clean_term(F.get("f", 0))
    opens = (F.size("f") == 2) & F.get("f", 1).rlike("^[ \\t]*[0-9]+[ \\t]*$") & (word != "") & ~F.get("f", 0).rlike("^" + HINT + "$")
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    owned = split.withColumn("opens", opens).withColumn("w", F.last(F.when(F.col("opens"), word), True).over(before))
    senses = owned.where(~F.col("opens") & F.col("w").isNotNull())
    each = senses.select("w", "n", F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("k", "s"))
    cleaned = each.select("w", F.struct(F.col("n").cast("long").alias("first"), F.col("k").cast("long").alias("second")).alias("at"), T.clean_term(F.regexp_replace("s", HINT, "")).alias("s"))
    return cleaned.where("s <> ''").select("w", "at", "s")


def _between(text, opening: str, closing: str):
    """What stands between the first ``opening`` and the next ``closing``, without tags; null if it isn't there."""
    inner = F.substring_index(F.get(F.split(text, opening, 2), 1), closing, 1)
    return T.clean_term(F.regexp_replace(inner, "<[^<>]*>", ""))


def parse_bridge(files: DataFrame) -> DataFrame:
    """Bilingual XML dictionaries: per entry the word in ``orth`` and the translations in ``quote``."""
    closed = F.split("value", "</entry>")
    bodies = files.select(F.explode(F.slice(closed, 1, F.size(closed) - 1)).alias("e")).where(F.contains("e", F.lit("<entry>")))
    entries = bodies.select(F.substring_index("e", "<entry>", -1).alias("e"))
    groups = F.split("e", '<cit type="trans">')
    quotes = F.transform(F.slice(groups, F.lit(2), F.size(groups)), lambda g: _between(g, "<quote>", "</quote>"))
    rows = entries.select(_between(F.col("e"), "<orth>", "</orth>").alias("w"), quotes.alias("t"))
    return rows.where("w <> ''").select("w", F.posexplode("t").alias("at", "s")).where("s <> ''")


def finalize(rows: DataFrame) -> DataFrame:
    """``w, s array``: cleaned, distinct in first-seen order, without self references."""
    cleaned = rows.select(T.clean_term(F.col("w")).alias("w"), T.clean_term(F.col("s")).alias("s"), "at")
    kept = cleaned.where("w <> '' and s <> '' and s <> w").groupBy("w", "s").agg(F.min("at").alias("at"))
    # distinct synonyms of one word
    return kept.groupBy("w").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("s"))


def compose(bridge: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Cross-language dictionary: translations of a word and of its synonyms."""
    place = lambda first, second: F.struct(F.lit(first).cast("long").alias("first") if isinstance(first, int) else first.cast("long").alias("first"), F.col(second).cast("long").alias("second"))
    direct = bridge.select("w", "s", place(0, "at").alias("at"))
    via = synonyms.select("w", F.posexplode("s").alias("i", "syn")).join(bridge.select("w").distinct(), "w", "left_semi")
    hop = bridge.select(F.col("w").alias("syn"), F.col("s"), F.col("at").alias("j"))
    indirect = via.join(hop, "syn").select("w", "s", place(F.col("i") + 1, "j").alias("at"))
    return finalize(direct.unionByName(indirect))


def write_dictionary(data: DataFrame, folder: str, meta: dict) -> None:
    """Sorted JSON lines ``{"w","s"}`` plus a one-line ``meta`` file in the same layout."""
    spark = data.sparkSession
    data.select("w", "s").orderBy("w").write.mode("overwrite").json(f"{folder}/entries")
    facts = [F.lit(v).alias(k) for k, v in meta.items()] + [F.lit(data.count()).alias("entries")]
    spark.range(1, numPartitions=1).select(F.struct(*facts).alias("meta")).write.mode("overwrite").json(f"{folder}/meta")


def read_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ``synonyms.jsonl`` files; the ``meta`` line has no word and falls out."""
    rows = spark.read.schema("w string, s array<string>").json(path)
    return rows.where(F.col("w").isNotNull() & (F.col("w") != "") & (F.size("s") > 0)).select(F.lower("w").alias("w"), "s")


def active_synonyms(entries: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Union of the active dictionaries: ``entries(code, w, s)``, ``dictionaries(code, active)``."""
    on = dictionaries.where("active").select("code")
    rows = entries.join(on, "code", "left_semi")
    listed = rows.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("code", "s"))).alias("all"))
    return listed.select("w", F.flatten(F.transform("all", lambda x: x["s"])).alias("s"))


def toggle(dictionaries: DataFrame, code: str, active: bool) -> DataFrame:
    """Switch a dictionary on or off."""
    return dictionaries.withColumn("active", F.when(F.col("code") == code, F.lit(active)).otherwise(F.col("active")))
