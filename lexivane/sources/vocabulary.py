"""Vocabularies: the ordered token lists whose positions are the vector dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.functions import text as T

# Phonotactic inventory of the base syllabary, in dimension order.
SIMPLE_ONSETS = "b c d f g j l m n p r s t v x z".split()
DIGRAPH_VOWELS = {"qu": "aeio", "gu": "ei", "ch": "aeiou", "lh": "aeiou", "nh": "aeiou"}
CLUSTER_ONSETS = "br cr dr fr gr pr tr vr bl cl fl gl pl".split()
VOWELS = "aeiou"
CODAS = "rlsmnzx"
DIPHTHONGS = "ai ei oi ui au eu iu ou ia ie io ua ue uo ao ae oe".split()

BASE_DRIVER = "PTBR"
FALLBACK_FILE = "tokens_PTBR.drv"


def _literal(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _combine(heads: Column, tails: Column) -> Column:
    """Every head followed by every tail, heads outermost."""
    return F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: F.concat(h, t))))


def base_syllabary(spark: SparkSession) -> DataFrame:
    """Generate the base vocabulary as one array: open syllables, closed ones, then diphthongs.

    ``array_distinct`` keeps the first position of a token, which is its dimension.
    """
    onset_vowels = [(c, VOWELS) for c in SIMPLE_ONSETS]
    onset_vowels += list(DIGRAPH_VOWELS.items())
    onset_vowels += [(c, VOWELS) for c in CLUSTER_ONSETS]
    onsets = _literal([o for o, _ in onset_vowels])
    opened = F.concat(*[_combine(_literal([o]), _literal(v)) for o, v in onset_vowels])
    glides = _literal(DIPHTHONGS)
    row = spark.range(1, numPartitions=1).select(opened.alias("opened"))
    tokens = F.concat(
        "opened",
        _combine(_literal(VOWELS), _literal(CODAS)),
        _combine(F.col("opened"), _literal(CODAS)),
        _combine(onsets, glides),
        glides,
    )
    return row.select(F.posexplode(F.array_distinct(tokens)).alias("dim", "token")).select(
        F.lit(BASE_DRIVER).alias("driver"), "dim", "token", F.lit(False).alias("is_keyword")
    )


def read_drivers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read every ``*.drv`` of a folder into ``(vocab, meta)``."""
    files = spark.read.option("pathGlobFilter", "*.drv").text(folder, wholetext=True)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    raw = files.select("value", F.col("_metadata.file_path").alias("path")).select(
        F.url_decode(name).alias("file"), "value"
    )
    lines = raw.select(
        "file",
        T.driver_language(F.col("file")).alias("driver"),
        F.filter(F.transform(F.split("value", "\\R"), T.strip), lambda s: s != "").alias("lines"),
    )
    entries = F.filter("lines", lambda s: ~s.startswith("#") & (s != "="))
    vocab = lines.select("driver", F.posexplode(entries).alias("dim", "line")).select(
        "driver", "dim", F.regexp_replace("line", "^=", "").alias("token"), F.col("line").startswith("=").alias("is_keyword")
    )
    comments = F.transform(
        F.filter("lines", lambda s: s.startswith("#")), lambda s: T.strip(F.regexp_replace(s, "^#", ""))
    )
    tagged = lambda tag: F.filter("comments", lambda s: F.lower(s).startswith(tag))
    after = lambda tag: T.strip(F.coalesce(F.regexp_replace(F.get(tagged(tag), 0), f"(?i)^{tag}", ""), F.lit("")))
    plain = F.filter(
        "comments",
        lambda s: ~F.lower(s).startswith("descricao:") & ~F.lower(s).startswith("extensoes:"),
    )
    meta = lines.withColumn("comments", comments).select(
        "file",
        "driver",
        F.coalesce(F.get(plain, 0), F.lit("")).alias("header"),
        after("descricao:").alias("description"),
        F.filter(F.split(F.lower(after("extensoes:")), "\\s+"), lambda e: e.startswith(".")).alias("extensions"),
    )
    return vocab, meta


def list_drivers(vocab: DataFrame, meta: DataFrame, match: str = "*") -> DataFrame:
    """Counts per driver with its header fields; ``match`` takes a name, ``prefix*`` or ``*``."""
    counts = vocab.groupBy("driver").agg(
        F.count_if(~F.col("is_keyword")).alias("syllables"),
        F.countDistinct(F.when(F.col("is_keyword"), F.col("token"))).alias("keywords"),
        F.count("*").alias("vocab_size"),
    )
    listed = meta.join(counts, "driver", "left").fillna(0, ["syllables", "keywords", "vocab_size"])
    if match.endswith("*"):
        return listed.where(F.col("driver").startswith(match[:-1]))
    return listed.where(F.col("driver") == match)


def token_dims(vocab: DataFrame) -> DataFrame:
    """Lookup side of a vocabulary: of duplicate tokens the last dimension wins."""
    return vocab.groupBy("driver", "token").agg(F.max("dim").alias("dim"))


def extension_map(meta: DataFrame) -> DataFrame:
    """Extension to driver; of several drivers the last file name wins."""
    return (
        meta.select(F.explode("extensions").alias("extension"), "file", "driver")
        .groupBy("extension")
        .agg(F.max(F.struct("file", "driver")).alias("pick"))
        .select("extension", F.col("pick.file").alias("driver_file"), F.col("pick.driver").alias("language"))
    )


def interpret(files: DataFrame, meta: DataFrame, path: str = "path") -> DataFrame:
    """Route files to drivers by extension, with the base driver as fallback."""
    routed = files.withColumn("extension", T.file_extension(F.col(path))).join(
        extension_map(meta), "extension", "left"
    )
    return routed.select(
        *files.columns,
        "extension",
        F.col("driver_file").isNotNull().alias("matched"),
        F.coalesce("driver_file", F.lit(FALLBACK_FILE)).alias("driver"),
        F.coalesce("language", F.lit(BASE_DRIVER)).alias("language"),
    )


def derive_driver(base_vocab: DataFrame, name: str, keywords: list[str]) -> DataFrame:
    """Syllables of a base driver followed by the distinct lower-case keywords."""
    kept = list(dict.fromkeys(k.strip().lower() for k in keywords if k.strip()))
    spark = base_vocab.sparkSession
    syllables = base_vocab.where(~F.col("is_keyword")).select(F.lit(0).alias("part"), "dim", "token", "is_keyword")
    extra = spark.createDataFrame(
        [(1, i, k, True) for i, k in enumerate(kept)], "part int, dim int, token string, is_keyword boolean"
    )
    # a vocabulary has a few thousand entries, so one window partition is enough
    order = Window.orderBy("part", "dim")
    return syllables.unionByName(extra).select(
        F.lit(name).alias("driver"), (F.row_number().over(order) - 1).cast("int").alias("dim"), "token", "is_keyword"
    )


def driver_lines(vocab: DataFrame, header: str, description: str, extensions: list[str]) -> DataFrame:
    """Lines of a ``.drv`` file in order, ready for a text sink."""
    spark = vocab.sparkSession
    head = [header, f"descricao: {description}", f"extensoes: {' '.join(extensions)}"]
    top = spark.createDataFrame([(i - len(head), f"# {h}") for i, h in enumerate(head)], "dim int, value string")
    body = vocab.select("dim", F.when(F.col("is_keyword"), F.concat(F.lit("="), "token")).otherwise(F.col("token")).alias("value"))
    return top.unionByName(body).orderBy("dim").select("value")
