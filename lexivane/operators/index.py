"""Building the searchable index of named corpora.

Tables (all parquet, all keyed by natural keys so that no text is shuffled for numbering):

``chunks``      collection, base, doc, piece, uid, driver, start, len, tokens, doc_bytes, hist, line, text
``doc_spans``   collection, base, doc, n_pieces, first_chunk
``postings``    collection, base, doc, piece, uid, token, dim, tf      (sorted by token inside each file)
``idf``         collection, base, dim, token, df, n_chunks, idf
``chunk_stats`` collection, base, doc, piece, uid, tokens, oov, norm, union_norm
``union_idf``   collection, token, df, n_chunks, uidf
``bases``       one row of statistics per base

All but the last two are stored by ``cell``, a folder for each collection and hash bucket of base names, so a scope
reads only the cells that it names, and inside them the row groups of its bases and tokens. Documents are dealt by range
of cell, base and document before they are cut, so a task writes few cells, a base that holds most rows is spread over
many tasks, and surrogates of a base stand together. A change writes the touched cells as a new generation; files
of other cells keep their names, and readers of the former generation keep theirs.

A chunk is identified by ``(collection, base, doc, piece)``; its dense number inside the base is
``first_chunk + piece``. ``uid`` is a surrogate written with the chunk row: one long makes a far cheaper
grouping key than the four natural columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexivane.functions import chunking, lines
from lexivane.functions import text as T
from lexivane.operators.ordering import running_sums
from lexivane.plans.sizing import small
from lexivane.plans.store import Parts, TableStore
from lexivane.sources import vocabulary as V

BASE = ["collection", "base"]
DOC = BASE + ["doc"]
CHUNK = DOC + ["piece"]
BUCKETS = 4
#: Surrogates of a generation start at its number times this; an index that has changed more often is built anew.
UIDS = 1 << 54
MOST_GENERATIONS = 511


def cell_prefix(collection: Column) -> Column:
    return F.concat(F.lit("c"), F.lower(F.hex(F.xxhash64(F.coalesce(collection, F.lit(""))))), F.lit("b"))


def cell_suffix(base: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(base, F.lit(""))), F.lit(BUCKETS)).cast("string")


def cell_of(collection: Column, base: Column) -> Column:
    """Where the rows of a base are stored."""
    return F.concat(cell_prefix(collection), cell_suffix(base))


@dataclass
class Index:
    """Handle on one generation of the stored tables of an index."""

    store: TableStore
    chunk_size: int = chunking.DEFAULT_CHUNK_SIZE
    generation: int = 0
    label: str = "0"
    parts: dict[str, Parts] = field(default_factory=dict)
    whole: dict[str, str] = field(default_factory=dict)
    _frames: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def put_parts(self, name: str, df: DataFrame, touched: set[str] | None = None) -> DataFrame:
        """Write the ``touched`` cells of a table (all, if None) as part of this generation."""
        celled = df.withColumn("cell", cell_of(F.col("collection"), F.col("base")))
        before = self.parts.get(name, Parts(celled.schema))
        self.parts[name] = before.changed(self.store.save_parts(name, celled, self.label), touched)
        self._frames.pop(name, None)
        return self.frame(name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a small table whole."""
        self.whole[name] = f"{name}/generation={self.label}"
        self.store.save(self.whole[name], df)
        self._frames.pop(name, None)
        return self.frame(name)

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            part = self.parts.get(name)
            self._frames[name] = self.store.load(self.whole[name]) if part is None else self.store.load_parts(name, part)
        return self._frames[name]

    def following(self) -> Index:
        """The next generation, to be changed."""
        if self.generation >= MOST_GENERATIONS:
            raise ValueError("build the index anew: it has changed too often")
        number = self.generation + 1
        return Index(self.store, self.chunk_size, number, f"{number}-{uuid.uuid4().hex}", dict(self.parts), dict(self.whole))

    @property
    def raw_chunks(self) -> DataFrame:
        return self.frame("chunks")

    @property
    def chunks(self) -> DataFrame:
        return self.raw_chunks.where("piece is not null")

    @property
    def source_rows(self) -> DataFrame:
        """Chunk rows as they enter an index."""
        return self.raw_chunks.drop("uid", "cell")

    @property
    def doc_spans(self) -> DataFrame:
        return self.frame("doc_spans")

    @property
    def postings(self) -> DataFrame:
        return self.frame("postings")

    @property
    def idf(self) -> DataFrame:
        return self.frame("idf")

    @property
    def union_idf(self) -> DataFrame:
        return self.frame("union_idf")

    @property
    def chunk_stats(self) -> DataFrame:
        return self.frame("chunk_stats")

    @property
    def bases(self) -> DataFrame:
        return self.frame("bases")

    @property
    def vocab(self) -> DataFrame:
        return self.frame("vocab")

    def numbered(self, df: DataFrame) -> DataFrame:
        """Add ``chunk``, the dense chunk number inside the base."""
        spans = self.doc_spans.select(*DOC, "first_chunk")
        return df.join(spans, DOC).withColumn("chunk", (F.col("first_chunk") + F.col("piece")).cast("long")).drop("first_chunk")


def token_columns(cut: DataFrame) -> DataFrame:
    """Token count, histogram and syllable line of chunk rows; narrow transformations only."""
    kept = cut.select(*CHUNK, "driver", "start", "len", "doc_bytes", "text")
    schema = StructType(kept.schema.fields).add("line", "string").add("tokens", "integer").add("hist", lines.HISTOGRAM)
    rows = kept.withColumn("line", T.syllable_line(F.col("text"))).mapInArrow(lines.with_histograms, schema)
    said = F.when(F.col("piece").isNotNull(), F.col("tokens")).alias("tokens")
    return rows.select(*CHUNK, "driver", "start", "len", said, "doc_bytes", "hist", "line", "text")


def tokenized(docs: DataFrame, chunk_size: int, max_chunks: int = 0, with_text: bool = True) -> DataFrame:
    """Chunk rows of documents."""
    if "driver" not in docs.columns:
        docs = docs.withColumn("driver", F.lit(V.BASE_DRIVER))
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = cell_of(F.col("collection"), F.col("base"))
    docs = docs.select(*DOC, "driver", "text").repartitionByRange(slots, cell, "base", "doc")
    rows = token_columns(chunking.with_chunks(docs, DOC + ["driver"], chunk_size, max_chunks))
    return rows if with_text else rows.withColumn("text", F.lit(None).cast("string"))


def first_chunks(rows: DataFrame, store: TableStore, max_chunks: int) -> DataFrame:
    """Chunk rows of the first ``max_chunks`` chunks of every base, 0 for all; a document wholly beyond keeps a row without a piece for its bytes."""
    if max_chunks <= 0:
        return rows
    counts = rows.where("piece is not null").groupBy(*DOC).agg(F.count("*").alias("n_pieces"))
    heads = running_sums(store, f"capped-{uuid.uuid4().hex}", counts, BASE, [F.col("doc")], {"first_chunk": "n_pieces"})
    placed = rows.join(heads.select(*DOC, "first_chunk"), DOC, "left")
    inside = F.col("piece").isNull() | (F.coalesce("first_chunk", F.lit(0)) + F.col("piece") < max_chunks)
    kept = placed.where(inside | (F.col("piece") == 0)).withColumn("inside", inside)
    always = [*DOC, "driver", "doc_bytes"]
    return kept.select(*[F.col(c) if c in always else F.when(F.col("inside"), F.col(c)).alias(c) for c in rows.columns])


def posting_rows(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Histogram entries that have a dimension in the vocabulary of their base."""
    lookup = V.token_dims(vocab)
    entries = chunks.select(*CHUNK, "uid", "driver", F.explode("hist").alias("entry"))
    return (
        entries.select(*CHUNK, "uid", "driver", "entry.token", "entry.tf")
        .join(lookup, ["driver", "token"])
        .select(*CHUNK, "uid", "token", "dim", "tf")
    )


def smoothed_idf(n, df):
    return F.log((n + 1) / df)


def classic_idf(n, df):
    return F.log(n / df)


def chunk_counts(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum("n_pieces").alias("n_chunks"))


def base_idf(postings: DataFrame, counts: DataFrame) -> DataFrame:
    df = postings.groupBy(*BASE, "dim", "token").agg(F.count("*").alias("df"))
    return df.join(counts, BASE).withColumn("idf_exact", smoothed_idf(F.col("n_chunks"), F.col("df"))).withColumn(
        "idf", F.round("idf_exact", 6)
    )


def collection_idf(idf: DataFrame, counts: DataFrame) -> DataFrame:
    """Document frequencies add up over the bases, so the postings are not read again."""
    df = idf.groupBy("collection", "token").agg(F.sum("df").alias("df"))
    return df.join(counts, "collection").withColumn("uidf", smoothed_idf(F.col("n_chunks"), F.col("df")))


def _norm(weight):
    total = F.sqrt(F.sum(weight * weight))
    return F.when(total > 0, total).otherwise(F.lit(1.0))


def stats_per_chunk(chunks: DataFrame, postings: DataFrame, idf: DataFrame, union: DataFrame, store: TableStore) -> DataFrame:
    """Token counts and tf-idf norms. Entries of a chunk sit in one task, so the partial sums
    leave about one row per chunk to shuffle."""
    # both weights of a token are put together among the frequencies, so the postings are joined once; a written table
    # has a known size, so that postings are not shuffled and sorted for weights that fit every task
    weights = idf.join(union.select("collection", "token", "uidf"), ["collection", "token"]).select(*BASE, "token", "idf_exact", "uidf")
    weights = store.save(f"token_weights-{uuid.uuid4().hex}", weights)
    weighed = postings.join(small(weights), BASE + ["token"])
    norms = weighed.groupBy("uid").agg(
        F.sum("tf").alias("known"),
        F.round(_norm(F.col("tf") * F.col("idf_exact")), 6).alias("norm"),
        _norm(F.col("tf") * F.col("uidf")).alias("union_norm"),
    )
    return chunks.select(*CHUNK, "uid", "tokens").join(norms, "uid", "left").select(
        *CHUNK,
        "uid",
        "tokens",
        (F.col("tokens") - F.coalesce("known", F.lit(0))).cast("int").alias("oov"),
        F.coalesce("norm", F.lit(1.0)).alias("norm"),
        F.coalesce("union_norm", F.lit(1.0)).alias("union_norm"),
    )


def coverage(tokens, oov):
    return F.when(tokens > 0, F.round(1 - oov / tokens, 4)).otherwise(F.lit(0.0))


def base_meta(index: Index, mtime: int = 0, changed: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Statistics of the bases that ``changed`` leaves of every table."""
    sizes = changed(index.raw_chunks).groupBy(*BASE, "driver").agg(F.sum("doc_bytes").alias("bytes"), F.max(F.when(F.col("piece").isNotNull(), F.col("text").isNotNull())).alias("has_text"))
    counts = changed(index.chunk_stats).groupBy(*BASE).agg(
        F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens_total"), F.sum("oov").alias("oov_total")
    )
    used = changed(index.idf).groupBy(*BASE).agg(F.count("*").alias("vocab_used"))
    vocab_size = index.vocab.groupBy("driver").agg(F.count("*").alias("vocab_size"))
    joined = sizes.join(counts, BASE, "left").join(used, BASE, "left").join(vocab_size, "driver", "left")
    return joined.fillna(0, ["n_chunks", "tokens_total", "oov_total", "vocab_used", "vocab_size"]).select(
        *BASE,
        F.col("base").alias("corpus"),
        F.col("base").alias("source_file"),
        "bytes",
        F.lit(index.chunk_size).alias("chunk_size"),
        "n_chunks",
        "vocab_size",
        "vocab_used",
        "tokens_total",
        "oov_total",
        coverage(F.col("tokens_total"), F.col("oov_total")).alias("coverage"),
        F.coalesce("has_text", F.lit(True)).alias("with_text"),
        F.lit("lexivane").alias("generator"),
        F.concat(F.lit("tokens_"), "driver", F.lit(".drv")).alias("tokens_file"),
        F.col("driver").alias("language"),
        F.lit(False).alias("matched_by_ext"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("built_at"),
        F.lit(mtime).cast("long").alias("mtime"),
    )


def build_index(
    docs: DataFrame,
    store: TableStore,
    chunk_size: int = chunking.DEFAULT_CHUNK_SIZE,
    max_chunks: int = 0,
    with_text: bool = True,
    vocab: DataFrame | None = None,
    mtime: int = 0,
) -> Index:
    """Index ``docs(collection, base, doc, text[, driver])``; ``doc`` orders the texts of a base.

    ``max_chunks`` keeps the first chunks of every base; 0 keeps all.
    """
    rows = first_chunks(tokenized(docs, chunk_size, max_chunks, with_text), store, max_chunks)
    return index_rows(rows, store, chunk_size, vocab, mtime)


def with_uids(rows: DataFrame, generation: int) -> DataFrame:
    """Surrogates that rise inside a task, apart from those of other generations."""
    return rows.withColumn("uid", F.monotonically_increasing_id() + F.lit(generation * UIDS))


def index_rows(
    rows: DataFrame, store: TableStore, chunk_size: int, vocab: DataFrame | None = None, mtime: int = 0
) -> Index:
    """Index chunk rows that are already tokenized."""
    index = Index(store, chunk_size)
    index.put("vocab", vocab if vocab is not None else V.base_syllabary(store.spark))
    index.put_parts("chunks", with_uids(rows, 0))
    refresh_statistics(index, mtime)
    return index


def refresh_statistics(index: Index, mtime: int = 0, cells: set[str] | None = None, collections: set | None = None) -> None:
    """Derive the other tables from ``chunks``: those of ``cells`` and, for what the bases of a collection share, of ``collections``; all, if None."""
    store = index.store
    in_cells = (lambda df: df) if cells is None else lambda df: df.where(F.col("cell").isin(*cells))
    chunks = in_cells(index.chunks)
    per_doc = chunks.groupBy(*DOC).agg(F.count("*").alias("n_pieces"))
    spans = running_sums(store, f"doc_order-{index.label}", per_doc, BASE, [F.col("doc")], {"first_chunk": "n_pieces"})
    index.put_parts("doc_spans", spans, cells)
    clustered = posting_rows(chunks, index.vocab).withColumn("cell", cell_of(F.col("collection"), F.col("base")))
    index.put_parts("postings", clustered.sortWithinPartitions("cell", "token").drop("cell"), cells)
    index.put_parts("idf", base_idf(in_cells(index.postings), chunk_counts(in_cells(index.doc_spans), BASE)), cells)

    if collections is None:
        in_collections, whole_cells = lambda df: df, None
    else:
        # a change of one base moves the collection's frequencies, and with them the union norms of all its bases
        held = F.col("collection").isin(*[c for c in collections if c is not None])
        held = held | F.col("collection").isNull() if None in collections else held
        in_collections = lambda df: df.where(F.coalesce(held, F.lit(False)))
        whole_cells = {prefix + str(b) for prefix in {c[: c.rindex("b")] + "b" for c in cells} for b in range(BUCKETS)}
    union = collection_idf(in_collections(index.idf), chunk_counts(in_collections(index.doc_spans), ["collection"]))
    if collections is not None:
        union = index.union_idf.where(~F.coalesce(held, F.lit(False))).unionByName(union)
    index.put("union_idf", union)
    of_whole = (lambda df: df) if whole_cells is None else lambda df: in_collections(df.where(F.col("cell").isin(*whole_cells)))
    index.put_parts("chunk_stats", stats_per_chunk(of_whole(index.chunks), of_whole(index.postings), of_whole(index.idf), in_collections(index.union_idf), store), whole_cells)
    meta = base_meta(index, mtime, in_cells)
    if cells is not None:
        meta = index.bases.where(~cell_of(F.col("collection"), F.col("base")).isin(*cells)).unionByName(meta)
    index.put("bases", meta)


def changed_index(
    index: Index, touched: DataFrame, keep: Callable[[DataFrame], DataFrame], fresh: DataFrame | None = None, vocab: DataFrame | None = None, mtime: int = 0
) -> Index:
    """The next generation of an index: ``keep`` says what stays of the rows beside the ``touched(collection, base)``, then ``fresh`` chunk rows come in.

    Only cells of the touched bases are read and written, beside the slim statistics of their collections.
    """
    found = touched.select("collection", cell_of(F.col("collection"), F.col("base")).alias("cell")).distinct().collect()  # buckets of the touched collections
    cells, collections = {r["cell"] for r in found}, {r["collection"] for r in found}
    if not cells:
        return index
    after = index.following()
    if vocab is not None:
        after.put("vocab", vocab)
    rows = keep(index.raw_chunks.where(F.col("cell").isin(*cells))).drop("cell")
    after.put_parts("chunks", rows if fresh is None else rows.unionByName(with_uids(fresh, after.generation)), cells)
    refresh_statistics(after, mtime, cells, collections)
    return after
