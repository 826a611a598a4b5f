"""JSON contract of a tokenized base: ``{meta, idf, chunks}`` as one document per base, or line by line.

The lines of a base are one with its meta fields, those with its tokens and its idf values, ``DIMS_PER_LINE`` dimensions
each, and one for every chunk. No line, and no group, grows with the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.operators import index as I
from lexivane.operators.catalog import check_limits
from lexivane.operators.index import BASE, CHUNK, Index
from lexivane.functions import text as T
from lexivane.plans.store import TableStore

BASE_SCHEMA = """
meta STRUCT<corpus:STRING, source_file:STRING, bytes:BIGINT, chunk_size:INT, n_chunks:INT, vocab_size:INT, vocab_used:INT,
            tokens_total:BIGINT, oov_total:BIGINT, coverage:DOUBLE, with_text:BOOLEAN, generator:STRING, tokens_file:STRING,
            language:STRING, matched_by_ext:BOOLEAN, built_at:STRING, vocab:ARRAY<STRING>>,
idf MAP<STRING,DOUBLE>,
chunks ARRAY<STRUCT<id:INT, start:INT, len:INT, tokens:INT, oov:INT, vec:MAP<STRING,INT>, norm:DOUBLE, text:STRING>>
"""
LINE_SCHEMA = """
meta STRUCT<corpus:STRING, source_file:STRING, bytes:BIGINT, chunk_size:INT, n_chunks:BIGINT, vocab_size:BIGINT, vocab_used:BIGINT,
            tokens_total:BIGINT, oov_total:BIGINT, coverage:DOUBLE, with_text:BOOLEAN, generator:STRING, tokens_file:STRING,
            language:STRING, matched_by_ext:BOOLEAN, built_at:STRING>,
vocab MAP<STRING,STRING>, idf MAP<STRING,DOUBLE>,
chunk STRUCT<id:BIGINT, start:BIGINT, len:INT, tokens:INT, oov:INT, vec:MAP<STRING,INT>, norm:DOUBLE, text:STRING>
"""
SUFFIX = "-tokenized.json"
DIMS_PER_LINE = 1024


def read_bases(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Rows ``collection, base, mtime, meta, idf, chunks`` of every ``*-tokenized.json`` below a folder.

    A sub-folder names the collection; files in the folder itself go to ``default``. Files that ``write_bases``
    wrote name collection and base in their folders.
    """
    rows = (
        spark.read.schema(BASE_SCHEMA)
        .option("pathGlobFilter", f"{{*{SUFFIX},part-*.txt}}")
        .json(path, multiLine=True, recursiveFileLookup=True)
        .select("meta", "idf", "chunks", F.url_decode(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    )
    root = path.rstrip("/").removeprefix("file:")
    below = F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), f"^{root}/?", "")
    folder = F.regexp_extract(below, "^([^/]+)/", 1)
    named = F.lit(collection) if collection else F.when(folder == "", F.lit("default")).otherwise(folder)
    name = F.regexp_replace(F.regexp_extract("file", "([^/]+)$", 1), f"{SUFFIX}$", "")
    written = lambda field: F.url_decode(F.regexp_replace(F.regexp_extract("file", f"/{field}=([^/]*)/", 1), "[+]", "%2B"))
    by_folder = F.col("file").rlike("/collection=[^/]*/base=[^/]*/")
    named = F.lit(collection) if collection else F.when(by_folder, written("collection")).otherwise(named)
    name = F.when(by_folder, written("base")).otherwise(name)
    checked = rows.withColumn("meta", F.when(F.col("meta.vocab").isNull() | F.col("idf").isNull() | F.col("chunks").isNull(), F.raise_error(F.lit("incomplete base"))).otherwise(F.col("meta")))
    return checked.select(named.alias("collection"), name.alias("base"), F.unix_seconds("changed").alias("mtime"), "meta", "idf", "chunks")


def parse_bases(rows: DataFrame) -> DataFrame:
    """``rows(collection, base, json)``: the same from JSON texts."""
    parsed = rows.withColumn("j", F.from_json("json", BASE_SCHEMA))
    return parsed.select(*BASE, F.lit(0).cast("long").alias("mtime"), "j.meta", "j.idf", "j.chunks")


def import_bases(bases: DataFrame, store: TableStore, max_bases: int = 0, max_chunks_per_base: int = 0) -> Index:
    """Index tables straight from stored vectors, idf values and norms; nothing is recomputed.

    The position in the array is the chunk number; the stored id is ignored.
    """
    saved = store.save("imported", bases)
    each = saved.select(*BASE, F.col("meta.vocab").alias("names"), F.posexplode("chunks").alias("piece", "c"))
    # what a chunk without text knows of its tokens
    given = F.transform(F.map_entries("c.vec"), lambda e: F.struct(F.get("names", e["key"].try_cast("int")).alias("token"), e["value"].alias("tf")))
    numbered = each.withColumn("given", given).drop("names").withColumn("uid", F.monotonically_increasing_id())
    listed = store.save("imported_chunks", numbered)
    doc = F.lit(0).cast("long").alias("doc")
    driver = F.concat_ws("/", *BASE)
    vocab = saved.select(driver.alias("driver"), F.posexplode("meta.vocab").alias("dim", "token"))
    index = Index(store)
    index.put("vocab", vocab.withColumn("is_keyword", F.lit(False)))
    line = T.syllable_line(F.coalesce(F.col("c.text"), F.lit("")))
    chunk_rows = listed.select(
        *BASE, doc, "piece", "uid", driver.alias("driver"), F.coalesce("c.start", F.lit(0)).alias("start"), F.coalesce("c.len", F.lit(0)).alias("len"),
        F.coalesce("c.tokens", F.lit(0)).alias("tokens"), F.lit(0).cast("long").alias("doc_bytes"), F.when(F.col("c.text").isNotNull(), T.histogram(T.line_syllables(line))).otherwise(F.col("given")).alias("hist"), line.alias("line"), F.col("c.text").alias("text"),
    )
    index.put_parts("chunks", chunk_rows)
    index.put_parts("doc_spans", saved.select(*BASE, doc, F.size("chunks").cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("first_chunk")))
    tokens = vocab.select("driver", "dim", "token")
    entries = listed.select(*BASE, doc, "piece", "uid", driver.alias("driver"), F.explode("c.vec").alias("d", "tf"))
    entries = entries.withColumn("dim", F.expr("try_cast(d as int)")).join(tokens, ["driver", "dim"])
    index.put_parts("postings", entries.select(*CHUNK, "uid", "token", "dim", "tf").sortWithinPartitions("token"))
    counts = saved.select(*BASE, F.size("chunks").cast("long").alias("n_chunks"))
    df = index.postings.groupBy(*BASE, "dim").agg(F.count("*").alias("df"))
    given = saved.select(*BASE, driver.alias("driver"), F.explode("idf").alias("d", "idf")).withColumn("dim", F.expr("try_cast(d as int)"))
    idf = given.join(tokens, ["driver", "dim"]).join(df, [*BASE, "dim"], "left").fillna(0, ["df"]).join(counts, BASE)
    index.put_parts("idf", idf.select(*BASE, "dim", "token", "df", "n_chunks", F.col("idf").alias("idf_exact"), "idf"))
    per_collection = counts.groupBy("collection").agg(F.sum("n_chunks").alias("n_chunks"))
    index.put("union_idf", I.collection_idf(index.idf.where("df > 0"), per_collection))
    weighed = index.postings.join(index.union_idf.select("collection", "token", "uidf"), ["collection", "token"])
    union = weighed.groupBy("uid").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("uidf"), 2))).alias("u"))
    stored = listed.select(*BASE, doc, "piece", "uid", F.coalesce("c.tokens", F.lit(0)).alias("tokens"), F.coalesce("c.oov", F.lit(0)).alias("oov"), F.coalesce("c.norm", F.lit(1.0)).alias("norm"))
    index.put_parts("chunk_stats", stored.join(union, "uid", "left").select(*CHUNK, "uid", "tokens", "oov", "norm", F.when(F.col("u") > 0, F.col("u")).otherwise(1.0).alias("union_norm")))
    used = index.idf.where("idf > 0").groupBy(*BASE).agg(F.count("*").alias("vocab_used"))
    m = lambda field, other: F.coalesce(F.col(f"meta.{field}"), other).alias(field)
    meta = saved.select(
        *BASE, m("corpus", F.lit("?")), m("source_file", F.lit("?")), m("bytes", F.lit(0)), m("chunk_size", F.lit(I.chunking.DEFAULT_CHUNK_SIZE)),
        F.size("chunks").cast("long").alias("n_chunks"), F.size("meta.vocab").cast("long").alias("vocab_size"), m("tokens_total", F.lit(0)), m("oov_total", F.lit(0)),
        m("coverage", F.lit(0.0)), m("with_text", F.lit(False)), m("generator", F.lit("?")), m("tokens_file", F.lit("?")), driver.alias("language"), m("matched_by_ext", F.lit(False)),
        m("built_at", F.lit("")), "mtime",
    )
    index.put("bases", meta.join(used, BASE, "left").fillna(0, ["vocab_used"]))
    check_limits(index, max_bases, max_chunks_per_base)
    return index


def _text_map(c: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string"), e["value"])))


def _items(index: Index) -> DataFrame:
    """``collection, base, chunk, item`` with the contract's fields of every chunk."""
    vec = index.postings.groupBy(*CHUNK).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", "tf")))).alias("vec"))
    rows = index.chunks.select(*CHUNK, "start", "len", "tokens", "text").join(index.chunk_stats.select(*CHUNK, "oov", "norm"), CHUNK).join(vec, CHUNK, "left")
    item = F.struct(F.col("chunk").alias("id"), "start", "len", "tokens", "oov", _text_map(F.coalesce("vec", F.create_map().cast("map<int,int>"))).alias("vec"), "norm", "text")
    return index.numbered(rows).select(*BASE, "chunk", item.alias("item"))


def _meta_fields(index: Index) -> list[str]:
    return [c for c in index.bases.columns if c not in ("collection", "base", "mtime")]


def export_lines(index: Index) -> DataFrame:
    """``collection, base, kind, json``: the lines of every base, in no order; chunks carry their number.

    ``kind`` is the name of the only field of the line.
    """

    def by_dims(df: DataFrame, value: str, *keys: str) -> DataFrame:
        lines = df.groupBy(*keys, F.expr(f"dim div {DIMS_PER_LINE}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("dim", value))).alias("e"))
        return lines.select(*keys, _text_map(F.map_from_entries("e")).alias("e"))

    line = lambda name, c: [F.lit(name).alias("kind"), F.to_json(F.struct(c.alias(name))).alias("json")]
    meta = index.bases.select(*BASE, *line("meta", F.struct(*_meta_fields(index))))
    vocab = by_dims(index.vocab.withColumnRenamed("driver", "language"), "token", "language")
    vocab = index.bases.select(*BASE, "language").join(vocab, "language").select(*BASE, *line("vocab", F.col("e")))
    idf = by_dims(index.idf, "idf", *BASE).select(*BASE, *line("idf", F.col("e")))
    return meta.unionByName(vocab).unionByName(idf).unionByName(_items(index).select(*BASE, *line("chunk", F.col("item"))))


def parse_lines(rows: DataFrame) -> DataFrame:
    """``rows(collection, base, json)`` of ``export_lines``, in any order: ``meta, vocab, idf, chunk``, one of them set."""
    return rows.withColumn("j", F.from_json("json", LINE_SCHEMA)).select(*BASE, "j.meta", "j.vocab", "j.idf", "j.chunk")


def write_lines(index: Index, folder: str) -> None:
    """The lines of ``export_lines`` by collection and base; a base has a file of every task that holds some of it."""
    export_lines(index).drop("kind").write.mode("overwrite").partitionBy(*BASE).text(folder)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``collection, base, json`` from the folder of ``write_lines``."""
    return spark.read.schema("value STRING, collection STRING, base STRING").text(folder).select(*BASE, F.col("value").alias("json"))


def export_bases(index: Index, max_chunks_per_base: int) -> DataFrame:
    """``collection, base, json`` in the contract layout.

    A base becomes one document, so the limit on its chunks is mandatory; larger ones are refused. ``export_lines`` has none.
    """
    check_limits(index, 0, max_chunks_per_base)
    chunks = _items(index).groupBy(*BASE).agg(
        F.array_sort(F.collect_list(F.struct("chunk", F.to_json("item").alias("json")))).alias("chunks")
    )
    idf = index.idf.groupBy(*BASE).agg(F.sort_array(F.collect_list(F.struct("dim", "idf"))).alias("idf"))
    vocab = index.vocab.groupBy(F.col("driver").alias("language")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "token"))), lambda x: x["token"]).alias("vocab"))
    meta = index.bases.join(vocab, "language").select(*BASE, F.to_json(F.struct(*_meta_fields(index), "vocab")).alias("meta"))
    idf_json = F.to_json(_text_map(F.map_from_entries("idf")))
    body = F.concat(
        F.lit('{"meta":'), "meta", F.lit(',"idf":'), idf_json, F.lit(',"chunks":['), F.array_join(F.transform("chunks", lambda c: c["json"]), ","), F.lit("]}")
    )
    return meta.join(idf, BASE).join(chunks, BASE).select(*BASE, body.alias("json"))


def write_bases(index: Index, folder: str, max_chunks_per_base: int) -> None:
    """One JSON text per base, partitioned by collection and base."""
    export_bases(index, max_chunks_per_base).write.mode("overwrite").partitionBy(*BASE).text(folder)
