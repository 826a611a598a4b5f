"""One handle over an index: ingest, discover, search, expand, fetch, mine, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.chunking import DEFAULT_CHUNK_SIZE
from lexivane.operators import append as A
from lexivane.operators import cascade as CA
from lexivane.operators import catalog as C
from lexivane.operators import expand as E
from lexivane.operators import explain as X
from lexivane.operators import index as I
from lexivane.operators import mining as M
from lexivane.operators import profile as P
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.operators.index import BASE, Index
from lexivane.plans.store import TableStore
from lexivane.sources import base_json as J
from lexivane.sources import files
from lexivane.sources import thesaurus as TH
from lexivane.sources import vocabulary as V
from lexivane.sources.driver_catalog import DriverCatalog


class LexicalEngine:
    """Corpora by collection and base, stored as tables below one shared folder.

    Every change writes the cells of the bases that it touches as a new generation, so running readers keep a
    consistent view and a failed job leaves the current generation untouched.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        chunk_size: int = DEFAULT_CHUNK_SIZE,
        max_bases: int = 0,
        max_chunks_per_base: int = 0,
        drivers_folder: str | None = None,
    ):
        self.spark = spark
        self.store = TableStore(spark, root)
        self.chunk_size = chunk_size
        self.max_bases = max_bases
        self.max_chunks_per_base = max_chunks_per_base
        self.vocab, self.driver_meta = V.read_drivers(spark, drivers_folder) if drivers_folder else (V.base_syllabary(spark), None)
        self.driver_folder = drivers_folder
        self.driver_catalog = DriverCatalog(self.store)
        self._vocab_to_write: DataFrame | None = None
        self.synonyms: DataFrame | None = None
        self.expansion_cache: DataFrame | None = None
        self.learned_expansions = CA.ExpansionCache(self.store)
        self.index: Index | None = None
        self.generation = 0

    # ------------------------------------------------------------ ingest

    def _next_store(self) -> TableStore:
        self.generation += 1
        return TableStore(self.spark, self.store.path(f"generation={self.generation}"))

    def _publish(self, built: Index) -> Index:
        C.check_limits(built, self.max_bases, self.max_chunks_per_base)
        self.index = built
        return built

    def _without(self, bases: DataFrame, fresh: DataFrame | None = None, vocab: DataFrame | None = None) -> Index:
        """Replace ``bases(collection, base)`` by ``fresh`` rows."""
        named = bases.select(*BASE).distinct()
        return self._publish(I.changed_index(self.index, named, lambda rows: rows.join(named, BASE, "left_anti"), fresh, vocab))

    def ingest(self, docs: DataFrame, max_chunks: int = 0, with_text: bool = True) -> Index:
        """Add corpora ``collection, base, doc, text[, driver]``; a base of the same name is replaced.

        Only the new texts are tokenized.
        """
        rows = I.first_chunks(I.tokenized(docs, self.chunk_size, max_chunks, with_text), self.store, max_chunks)
        C.check_incoming(rows, self.index, self.max_bases, self.max_chunks_per_base)
        if self.index is not None:
            vocab, self._vocab_to_write = self._vocab_to_write, None
            return self._without(docs, rows, vocab)
        return self._publish(I.index_rows(rows, self._next_store(), self.chunk_size, self.vocab))

    def ingest_files(self, path: str, collection: str = files.DEFAULT_COLLECTION, **options) -> Index:
        return self.ingest(files.read_texts(self.spark, path, collection, self.driver_meta), **options)

    def ingest_text(self, name: str, text: str, collection: str = files.DEFAULT_COLLECTION, **options) -> Index:
        return self.ingest(files.text_rows(self.spark, {name: text}, collection), **options)

    def ingest_uploads(self, uploads: DataFrame, **options) -> Index:
        return self.ingest(files.upload_rows(uploads), **options)

    def append(self, texts: DataFrame) -> Index:
        """Continue bases with ``collection, base, seq, text``, packing their last chunks."""
        return self._publish(A.append_to_index(self.index, texts))

    def import_json(self, path: str, collection: str | None = None) -> Index:
        """Add tokenized bases; a base of the same name is replaced.

        The first import is opened with its stored idf values and norms. Beside other bases, and after later
        changes, statistics are derived from the stored vectors. Every imported base keeps its own vocabulary.
        """
        opened = J.import_bases(J.read_bases(self.spark, path, collection), self._next_store(), self.max_bases, self.max_chunks_per_base)
        known = self.vocab.join(opened.vocab.select("driver").distinct(), "driver", "left_anti")
        self.vocab = known.unionByName(opened.vocab.select(*known.columns))
        if self.index is None:
            self.index = opened
            return opened
        return self._without(opened.bases, opened.source_rows.select(*self.index.source_rows.columns), self.vocab)

    def export_json(self, folder: str, max_chunks_per_base: int) -> None:
        J.write_bases(self.index, folder, max_chunks_per_base)

    def drop_base(self, base: str, collection: str = files.DEFAULT_COLLECTION) -> Index:
        return self._without(self.index.bases.where((F.col("collection") == collection) & (F.col("base") == base)))

    def drop_collection(self, collection: str) -> Index:
        return self._without(self.index.bases.where(F.col("collection") == collection))

    # ------------------------------------------------------------ discovery

    def health(self) -> dict:
        row = self.index.bases.agg(F.count("*").alias("bases"), F.sum("n_chunks").alias("chunks")).first() if self.index else None
        return {"ok": True, "bases": row["bases"] if row else 0, "chunks": (row["chunks"] or 0) if row else 0}

    def bases(self, collection: str | None = None, match: str = "*") -> DataFrame:
        return C.list_bases(self.index, collection, match)

    def base(self, name: str, collection: str = files.DEFAULT_COLLECTION) -> DataFrame:
        return S.resolve_scope(self.index, collection, name)

    def collections(self) -> DataFrame:
        return C.list_collections(self.index)

    def stats(self) -> DataFrame:
        return C.stats(self.index)

    def memory(self) -> DataFrame:
        return C.memory_estimate(self.index)

    def keep_in_memory(self, on: bool = True) -> None:
        """Storage mode: cache the search tables on the executors, or read them from files."""
        for name in ("postings", "chunk_stats", "idf", "union_idf"):
            frame = getattr(self.index, name)
            frame.persist() if on else frame.unpersist()

    def profile(self, collection: str, base: str | None = None, top: int = 20) -> DataFrame:
        if base is not None:
            return P.base_profile(self.index, top).where((F.col("collection") == collection) & (F.col("base") == base))
        return P.collection_profile(self.index, top).where(F.col("collection") == collection)

    def profile_vectors(self, collection: str, top: int = 20) -> DataFrame:
        return P.vector_arrays(P.base_vectors(self.index, top)).where(F.col("collection") == collection)

    def drivers(self, match: str = "*") -> DataFrame:
        return V.list_drivers(self.vocab, self.driver_meta, match)

    def _catalog(self) -> DriverCatalog:
        if not self.driver_catalog.version and self.driver_meta is not None:
            self.driver_catalog.add(self.vocab, self.driver_meta, installed=True)
        return self.driver_catalog

    def add_drivers(self, folder: str) -> DataFrame:
        """Make the drivers of a folder available, not yet installed; all known files."""
        self._catalog().add(*V.read_drivers(self.spark, folder))
        return self.driver_catalog.files()

    def install_driver(self, file: str) -> int:
        """Texts that come in later go to this driver by their extensions. Gives the number of installed drivers."""
        installed = self._catalog().install(file)
        fresh = self.driver_catalog.vocab()
        kept = self.vocab.join(fresh.select("driver").distinct(), "driver", "left_anti")
        self.vocab = kept.unionByName(fresh.select(*kept.columns))
        self.driver_meta = self.driver_catalog.meta()
        self._vocab_to_write = self.vocab
        return installed

    def uninstall_driver(self, file: str) -> int:
        """Later texts no longer go to this driver; bases that have it keep its tokens."""
        installed = self._catalog().uninstall(file)
        self.driver_meta = self.driver_catalog.meta()
        return installed

    def interpret(self, paths: list[str]) -> DataFrame:
        return V.interpret(self.spark.createDataFrame([(p,) for p in paths], "path string"), self.driver_meta)

    # ------------------------------------------------------------ search

    def search(self, queries, base: str = "*", collection: str | None = None, **options) -> DataFrame:
        """One text, a list, or a frame ``query_id, query``; options as in :func:`search.search`."""
        return S.search(self.index, queries, collection, base, **options).orderBy("query_id", "rank")

    def search_report(self, queries, base: str = "*", collection: str | None = None, **options) -> DataFrame:
        return S.search_report(self.index, queries, collection, base, **options)

    def search_sequence(self, queries, base: str = "*", collection: str | None = None, **options) -> DataFrame:
        return S.search_sequence(self.index, queries, collection, base, **options)

    def use_dictionaries(self, entries: DataFrame, dictionaries: DataFrame) -> None:
        self.synonyms = TH.active_synonyms(entries, dictionaries)

    def search_expand(self, queries, base: str = "*", collection: str | None = None, k: int = 8, phonetic: bool = False, expander=None) -> DataFrame:
        return E.search_expand(self.index, queries, self.synonyms, self.expansion_cache, expander, collection, base, k, phonetic).orderBy("query_id", "rank")

    def search_cascade(self, queries, base: str = "*", collection: str | None = None, k: int = 8, phonetic: bool = False, expander=None) -> CA.Cascade:
        """Dictionaries, learned expansions, ``expander`` (whose variants are learned), literal search: outcome and hits of every query."""
        return CA.cascade(self.index, queries, self.synonyms, self.learned_expansions, expander, collection, base, k, phonetic)

    def absence(self, queries, base: str = "*", collection: str | None = None) -> DataFrame:
        asked = Q.query_frame(self.spark, queries)
        return E.absence_report(self.index, asked, E.expansions(asked, self.synonyms, self.expansion_cache), collection, base)

    def literal(self, query: str, base: str = "*", collection: str | None = None, k: int = 8) -> DataFrame:
        return E.literal_fallback(self.index, query, collection, base, k)

    def histogram(self, queries, **options) -> tuple[DataFrame, DataFrame]:
        """Query dimensions and matched-filter points of the best chunk of every query."""
        asked = Q.query_frame(self.spark, queries)
        best = X.best_chunks(self.index, asked, **options)
        return X.query_dims(self.index, asked, best), X.matched_filter(self.index, asked, best)

    def chunks(self, base: str, collection: str = files.DEFAULT_COLLECTION, chunk_id: int | None = None, before: int = 0, after: int = 0, ids: list[int] | None = None) -> DataFrame:
        if ids is not None:
            return C.chunks_by_id(self.index, ids, collection, base).orderBy("position")
        if chunk_id is None:
            raise ValueError("give chunk_id or ids")
        return C.chunk_window(self.index, chunk_id, before, after, collection, base).orderBy("chunk")

    # ------------------------------------------------------------ mining

    def mine(self, previous: DataFrame | None = None, collections: list[str] | None = None, force: bool = False) -> DataFrame:
        return M.mine(self.index, previous, collections, force)
