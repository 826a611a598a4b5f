"""Registered queries over the given tables.

The corpus is ``documents`` with the language as collection and the source as base. Its index is
built once per session and folder, and every query works on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import chunking
from lexivane.functions import sql as SQL
from lexivane.functions import text as T
from lexivane.operators import append as A
from lexivane.operators import cascade as CA
from lexivane.operators import catalog as C
from lexivane.operators import expand as E
from lexivane.operators import explain as X
from lexivane.operators import index as I
from lexivane.operators import lexicon as L
from lexivane.operators import mining as M
from lexivane.operators import phrases as PH
from lexivane.operators import profile as P
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.plans.store import TableStore
from lexivane.sources import base_json as J
from lexivane.sources import thesaurus as TH
from lexivane.sources import vocabulary as V
from lexivane.sources.driver_catalog import DriverCatalog
from lexivane.streaming.appends import ChunkLog, append_stream
from lexivane.streaming.mining_cycles import KnowledgeStore, run_cycle

# Parameters of the registered searches.
SEARCHES = [
    "thereou onthwh reing",
    "ciónmenteraí para doci",
    "keitver ungsch der die",
    "éeuxle euxai émentch",
    "and the of",
    "eratsh therin anatesan lyesha",
    "menten queéch anier pale",
]
CHAINS = ["reing", "paraci", "keitver", "mentpa", "the", "anen"]
PHRASES = ["the of the", "the and", "orantion orantion orantion", "hehely hehely", "de la", "der die", "the"]
SYNONYMS = {
    "para": ["por", "pale", "Para", "parami"],
    "doci": ["cidor", "eneste", "zzzyx"],
    "keitver": ["verkeit", "ungver", "ver"],
    "thereou": ["there", "reou", "ouer the"],
    "émentch": ["ment", "chement"],
}
SMALL_CHUNK = 256
MINED_FIRST = ["de", "en"]

_indexes: dict[tuple[str, str], I.Index] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.select(F.col("lang").alias("collection"), F.col("source").alias("base"), F.col("doc_id").alias("doc"), "text")


def index_of(spark: SparkSession, folder: str) -> I.Index:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        _indexes[key] = I.build_index(corpus(spark, folder), TableStore(spark))
    return _indexes[key]


def synonym_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYNONYMS.items()), "w string, s array<string>")


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _big(name: str):
    return F.col(name).cast("long").alias(name)


# ---------------------------------------------------------------- text


def word_counts(spark, folder):
    return L.word_counts(table(spark, folder, "documents"))


def syllable_counts(spark, folder):
    return L.syllable_counts(table(spark, folder, "documents"))


def word_lexicon(spark, folder):
    return L.lexicon(L.word_counts(table(spark, folder, "documents")))


def phonetic_groups(spark, folder):
    words = L.lexicon(L.word_counts(table(spark, folder, "documents")))
    return words.groupBy("phonetic").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"))


def literal_needles(spark, folder):
    documents = table(spark, folder, "documents")
    rows = documents.select("doc_id", F.array_join(T.alnum_needles(F.col("text")), " ").alias("needles"))
    return rows.where("needles <> ''")


def query_keys(spark, folder):
    rows = table(spark, folder, "benchmark")
    return rows.select("item_id", F.md5(T.normalize_query(F.col("text"))).alias("query_key"))


def cleaned_texts(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.md5(T.clean_corpus(F.col("text"))).alias("cleaned"))


def page_names(spark, folder):
    url = F.col("url")
    name = T.safe_name(T.derive_base_name(url))
    return table(spark, folder, "pages").select(
        "page_id",
        name.alias("base_name"),
        T.file_extension(url).alias("extension"),
        T.hit_path(name, F.lit("page.html")).alias("path"),
        T.percent_decode(url).alias("decoded"),
        T.mask_key(url).alias("masked"),
    )


def interpret_pages(spark, folder):
    """Drivers of all pages by extension before an install, after it, and after the driver is gone again."""
    catalog = DriverCatalog(TableStore(spark))
    web = spark.createDataFrame([("tokens_Web_PTBR.drv", "Web", "web pages", "", [".html", ".htm"])], "file string, driver string, header string, description string, extensions array<string>")
    base = V.base_syllabary(spark)
    catalog.add(V.derive_driver(base, "Web", ["div", "span", " Div", "href"]), web)
    catalog.add(base, web.select(F.lit(V.FALLBACK_FILE).alias("file"), F.lit(V.BASE_DRIVER).alias("driver"), "header", "description", F.array(F.lit(".txt")).alias("extensions")), installed=True)
    pages = table(spark, folder, "pages").select("page_id", "url")

    def routed(step):
        listed = V.list_drivers(catalog.vocab(), catalog.meta()).select(F.col("driver").alias("language"), _big("keywords"), _big("vocab_size"))
        found = V.interpret(pages, catalog.meta(), "url").join(listed, "language", "left")
        return found.select("page_id", F.lit(step).alias("step"), "extension", "matched", "driver", "language", "keywords", "vocab_size")

    before = routed("before")
    catalog.install("tokens_Web_PTBR.drv")
    installed = routed("installed")
    catalog.uninstall("tokens_Web_PTBR.drv")
    return before.unionByName(installed).unionByName(routed("uninstalled"))


def key_terms(spark, folder):
    rows = Q.query_terms(table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    terms = rows.select(F.col("query_id").alias("item_id"), F.posexplode("terms").alias("term_no", "t"))
    return terms.select("item_id", _big("term_no"), F.translate("t.term", "|", "-").alias("term"), F.col("t.k").cast("long").alias("k"), F.col("t.sx").alias("sx"))


# ---------------------------------------------------------------- index


def chunk_index(spark, folder):
    rows = C.chunk_rows(index_of(spark, folder))
    return rows.select("collection", "base", _big("doc"), _big("chunk"), _big("start"), _big("len"), F.md5("text").alias("text_md5"))


def chunk_stats(spark, folder):
    rows = C.chunk_rows(index_of(spark, folder))
    return rows.select("collection", "base", _big("chunk"), _big("tokens"), _big("oov"), _r("norm"))


def base_meta(spark, folder):
    return index_of(spark, folder).bases.select(
        "collection", "base", "bytes", "n_chunks", "vocab_size", "vocab_used", "tokens_total", "oov_total", _r("coverage", 4)
    )


def idf_table(spark, folder):
    return index_of(spark, folder).idf.select("collection", "base", _big("dim"), "token", "df", _r("idf"))


def idf_classic(spark, folder):
    value = I.classic_idf(F.col("n_chunks"), F.col("df"))
    return index_of(spark, folder).idf.select("collection", "base", "token", F.round(value, 6).alias("idf"))


def postings(spark, folder):
    index = index_of(spark, folder)
    return index.numbered(index.postings).select("collection", "base", _big("chunk"), _big("dim"), "token", _big("tf"))


def tfidf_weights(spark, folder):
    index = index_of(spark, folder)
    return index.numbered(L.tfidf_weights(index)).select("collection", "base", _big("chunk"), "token", _r("weight"))


def position_lists(spark, folder):
    index = index_of(spark, folder)
    rows = L.position_lists(index, numbered=True)
    return rows.select("collection", "base", _big("chunk"), "token", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def position_gaps(spark, folder):
    index = index_of(spark, folder)
    rows = L.position_gaps(index, numbered=True)
    return rows.select("collection", "base", _big("chunk"), "token", F.array_join(F.col("gaps").cast("array<string>"), " ").alias("gaps"))


def seek_position(spark, folder):
    index = index_of(spark, folder)
    rows = L.seek_positions(L.position_lists(index, numbered=True), 100)
    return rows.select("collection", "base", _big("chunk"), "token", _big("seek_index"), _big("seek_position"))


def _zipf(spark, folder):
    return L.zipf_table(index_of(spark, folder).store, L.syllable_counts(table(spark, folder, "documents")))


def zipf_table(spark, folder):
    return _zipf(spark, folder).select("syllable", _big("n"), _big("rank"), _r("freq", 8), _r("cumulative", 8))


def zipf_exponent(spark, folder):
    return L.zipf_exponent(_zipf(spark, folder)).select(_r("exponent"), "n_syllables")


def zipf_coverage(spark, folder):
    return L.zipf_coverage(_zipf(spark, folder)).select(_big("top_n"), _r("covered"))


def active_dims(spark, folder):
    return L.active_dims(index_of(spark, folder)).select("collection", "base", "active_dims", "vocab_size", _r("sparsity"))


def oov_tokens(spark, folder):
    return L.out_of_vocabulary(index_of(spark, folder))


def oov_top(spark, folder):
    return L.out_of_vocabulary(index_of(spark, folder)).orderBy(F.desc("n"), F.asc("token")).limit(15)


def bigrams(spark, folder):
    return L.bigram_counts(index_of(spark, folder))


def base_embeddings(spark, folder):
    return L.dense_base_vectors(index_of(spark, folder)).select("collection", "base", _big("dim"), "token", "n")


# ---------------------------------------------------------------- catalog and profile


def bases_in_scope(spark, folder):
    return C.list_bases(index_of(spark, folder), None, "src1*").select("collection", "name", "n_chunks", "vocab_size", "has_text")


def collections(spark, folder):
    return C.list_collections(index_of(spark, folder))


def stats_rollup(spark, folder):
    return C.stats(index_of(spark, folder))


def memory_estimate(spark, folder):
    return C.memory_estimate(index_of(spark, folder)).select("collection", "base", _big("text_bytes"), _big("vec_bytes"), _big("words_bytes"))


def chunk_window(spark, folder):
    rows = C.chunk_window(index_of(spark, folder), 3, 1, 2)
    return rows.select("collection", "base", _big("chunk"), _big("start"), _big("len"), _big("tokens"), _big("oov"), F.md5("text").alias("text_md5"))


def chunks_by_id(spark, folder):
    rows = C.chunks_by_id(index_of(spark, folder), [4, 0, 9999])
    return rows.select("collection", "base", _big("position"), _big("chunk"), _big("start"), F.md5("text").alias("text_md5"))


def word_keys(spark, folder):
    return C.scope_word_keys(index_of(spark, folder), "es").select(F.translate("key", T.KEY_SEPARATOR, "+").alias("key"))


def union_vocabulary(spark, folder):
    index = index_of(spark, folder)
    rows = P.union_vocabulary(index).join(index.union_idf, ["collection", "token"], "left")
    return rows.select("collection", "token", _big("u_dim"), "df", _r("uidf"))


def union_norms(spark, folder):
    index = index_of(spark, folder)
    return index.numbered(index.chunk_stats).select("collection", "base", _big("chunk"), _r("union_norm", 5))


def fingerprints(spark, folder):
    return P.fingerprint(index_of(spark, folder))


def base_profile(spark, folder):
    return P.base_profile(index_of(spark, folder)).select("collection", "base", _big("rank"), _big("dim"), "syllable", _r("idf"))


def collection_profile(spark, folder):
    return P.collection_profile(index_of(spark, folder)).select("collection", _big("rank"), _big("dim"), "syllable", _r("uidf"))


def base_vectors(spark, folder):
    return P.base_vectors(index_of(spark, folder)).select("collection", "base", "n_chunks", _big("rank"), "syllable", _r("weight"))


def mined_sources(spark, folder):
    return M.source_hashes(index_of(spark, folder).bases)


def mined_anatomy(spark, folder):
    rows = M.corpus_rows(index_of(spark, folder))
    return rows.select("collection", "base", "n_chunks", "vocab_size", F.size("vec").cast("long").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, w: a + w), 5).alias("mass"))


def mined_records(spark, folder):
    """Both pillars after two cycles: two collections are enabled in the first, all in the second, which leaves the unchanged ones."""
    index = index_of(spark, folder)
    knowledge = KnowledgeStore(TableStore(spark))
    run_cycle(index, knowledge, 0, MINED_FIRST)
    run_cycle(index, knowledge, 1)
    item = lambda kind, field: F.get_json_object(F.get(F.filter("knowledge", lambda k: k["type"] == kind), 0)["content"], f"$.{field}")
    records = knowledge.current().select(
        "collection", _big("level"), "source_hash", _big("cycle"),
        F.col("provenance.digestion_id").alias("digestion_id"),
        (F.col("updated").isNotNull() & (F.col("provenance.inputs.source_hash") == F.col("source_hash"))).alias("traced"),
        F.size("knowledge").cast("long").alias("items"),
        item("RootIndex", "n_bases").cast("long").alias("n_bases"),
        item("RootIndex", "total_chunks").cast("long").alias("total_chunks"),
        item("RootIndex", "salient_roots[0].syllable").alias("first_root"),
        item("CorpusDict", "unified_vocab_size").cast("long").alias("unified_vocab_size"),
    )
    total = F.aggregate("vec", F.lit(0.0), lambda a, w: a + w)
    bases = knowledge.anatomy().select("collection", "base", "n_chunks", F.size("vec").cast("long").alias("dims"), F.round(total, 5).alias("mass"))
    return records.join(bases, "collection")


# ---------------------------------------------------------------- search


def _hits(df):
    return df.select(
        _big("query_id"), _big("rank"), "collection", "base", "path", _r("matchpoint"), _r("coverage"), _big("span"), _r("cos"), _big("chunk"), _big("start"), "recency"
    )


def search_all(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, k=10, now=0, snippets=False))


def search_phonetic(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, k=10, phonetic=True, now=0, snippets=False))


def search_unified(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, k=10, unified=True, now=0, snippets=False))


def search_recall_only(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, k=5, rerank=False, now=0, snippets=False))


def search_one_base(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, collection="en", base="src1", k=5, now=0, snippets=False))


def search_one_collection(spark, folder):
    return _hits(S.search(index_of(spark, folder), SEARCHES, collection="fr", base="src1*", k=5, recall_n=10, now=0, snippets=False))


def search_benchmark(spark, folder):
    """Every benchmark text as a query, best hit lists in one job."""
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _hits(S.search(index_of(spark, folder), queries, k=5, recall_n=5, now=0, snippets=False))


def snippets(spark, folder):
    hits = S.search(index_of(spark, folder), SEARCHES, k=5, now=0)
    return hits.select(_big("query_id"), _big("rank"), "snippet")


def search_report(spark, folder):
    rows = S.search_report(index_of(spark, folder), SEARCHES)
    return rows.select(_big("query_id"), "collection", "base", "n_chunks", "n_converge", "dims", _big("oov"))


def _recall(spark, folder, **options):
    index = index_of(spark, folder)
    queries = Q.query_frame(spark, SEARCHES)
    scores = S.recall(index, S.open_scope(index), queries, **options)
    top = index.numbered(S.top_candidates(scores, 20))
    return top.select(_big("query_id"), "collection", "base", _big("recall_rank"), _big("chunk"), _r("cos"))


def recall_candidates(spark, folder):
    return _recall(spark, folder)


def recall_true_cosine(spark, folder):
    return _recall(spark, folder, cosine="true", idf_mode="classic")


def recall_unified(spark, folder):
    return _recall(spark, folder, unified=True)


def search_sequence(spark, folder):
    index = index_of(spark, folder)
    rows = index.numbered(S.search_sequence(index, SEARCHES, k=3, recall_n=5))
    return rows.select(_big("query_id"), "collection", "base", _big("rank"), _big("chunk"), _r("rr"), _r("mf"), _big("span"), _r("cos"))


def bag_scores(spark, folder):
    rows = PH.bag_scores(index_of(spark, folder), CHAINS)
    return rows.select(_big("query_id"), "collection", "base", _big("score"), _r("coverage"), _r("cosine"), "verdict")


def word_chains(spark, folder):
    rows = PH.word_chain_hits(index_of(spark, folder), CHAINS)
    return rows.select(_big("query_id"), "collection", "base", _big("hits"), _big("bigrams"), "verdict")


def phrase_positions(spark, folder):
    index = index_of(spark, folder)
    rows = index.numbered(PH.phrase_positions(index, CHAINS))
    return rows.select(_big("query_id"), "collection", "base", _big("chunk"), _big("pos"))


def document_phrases(spark, folder):
    """Phrases in document positions, across words and chunks."""
    rows = PH.document_phrases(index_of(spark, folder), PHRASES)
    return rows.select(_big("query_id"), "collection", "base", "doc", _big("pos"))


def correlation_peaks(spark, folder):
    """Matched-filter curve of a word over all chunks, as its peak and mean per chunk."""
    index = index_of(spark, folder)
    curve = PH.correlation_curve(index, index.chunks, "keitver")
    peaks = curve.groupBy("collection", "base", "doc", "piece").agg(
        F.count("*").alias("offsets"), F.max("fraction").alias("peak"), F.sum("fraction").alias("mass")
    )
    return index.numbered(peaks).select("collection", "base", _big("chunk"), "offsets", _r("peak"), _r("mass"))


# ---------------------------------------------------------------- expansion


def dictionary_variants(spark, folder):
    """Benchmark texts expanded by the given synonyms and by the spellings of their words in the documents."""
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    spelled = L.word_counts(table(spark, folder, "documents")).groupBy(T.normalize("word").alias("w")).agg(F.collect_set("word").alias("s"))
    words = synonym_table(spark).unionByName(spelled)
    merged = words.groupBy("w").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    return E.dictionary_expansions(queries, merged).select(F.col("query_id").alias("item_id"), _big("variant_no"), "variant")


def search_expanded(spark, folder):
    rows = E.search_expand(index_of(spark, folder), SEARCHES, synonym_table(spark), k=8)
    return rows.select(_big("query_id"), _big("rank"), "collection", "base", _big("chunk"), _r("coverage"), _big("span"), _r("cos"), _r("var_cov"), "via")


def did_you_mean(spark, folder):
    missing = spark.createDataFrame([(0, "therrou"), (0, "onthe"), (1, "keitverr"), (2, "paresi")], "query_id long, term string")
    rows = E.suggest_terms(index_of(spark, folder), missing)
    return rows.select(_big("query_id"), _big("rank"), "word", _big("same_sound"), _big("shared"), _big("distance"))


def absence(spark, folder):
    queries = Q.query_frame(spark, ["zzzyx qqwk", "thereou", "xyzzy"])
    none = E.expansions(queries)
    rows = E.absence_report(index_of(spark, folder), queries, none)
    return rows.select(_big("query_id"), "absent", F.array_join("dropped", " ").alias("dropped"), F.array_join("did_you_mean", " ").alias("did_you_mean"))


def literal_hits(spark, folder):
    rows = E.literal_fallback(index_of(spark, folder), "ticket OE-6016 at 192 or 10 of 2024", k=10)
    return rows.select(
        _big("rank"), "collection", "base", _big("chunk"), _big("start"), _r("coverage"), _big("span"), F.array_join("needles_matched", " ").alias("needles"), "snippet"
    )


#: Queries that end in each step of the cascade: dictionaries, cache (one of them absent), expander, literal search, nothing.
CASCADE = ["ciónmenteraí para doci", "and the of", "zzzyx qqwk", "menten queéch", "ticket OE-6016 at 192 or 10 of 2024", "xyzzy", "invoice 2024 and QX-99999"]
CACHED = {"and the of": ["reing", "onthwh reing"], "zzzyx qqwk": ["qqwkz", "therrou"]}
EXPANDED = {"menten queéch": ["anier pale", "zzzyx", "para"], "and the of": ["never asked"]}


def search_cascade(spark, folder):
    """Outcome and hits of queries that end in different steps."""
    index = index_of(spark, folder)
    cache = CA.ExpansionCache(TableStore(spark))
    for _ in range(2):  # the second time each row is replaced by itself
        cache.upsert(spark.createDataFrame(list(CACHED.items()), "query_key string, variants array<string>"))
    known = spark.createDataFrame(list(EXPANDED.items()), "query string, variants array<string>")
    expander = lambda left: left.join(known, "query").select("query_id", F.posexplode("variants").alias("n", "variant")).select("query_id", (F.col("n") + 1).alias("variant_no"), "variant")
    found = CA.cascade(index, CASCADE, synonym_table(spark), cache, expander)
    rows = found.outcome.join(found.hits.drop("source"), "query_id", "left")
    flat = [F.array_join(c, ";").alias(c) for c in ("expansions", "dropped", "did_you_mean")]
    return rows.select(_big("query_id"), "source", "absent", *flat, _big("rank"), "collection", "base", _big("chunk"), _r("coverage"), _big("span"), "via")


# ---------------------------------------------------------------- SQL


def sql_syllables(spark, folder):
    """Syllables by language, in SQL; counted by document first, and coded when each stands once, so that every step hashes and none sorts."""
    SQL.register(spark)
    return spark.sql(
        """SELECT lang, syllable, n, n_docs, phonetic_code(syllable) AS code
        FROM (SELECT lang, syllable, sum(n) AS n, count(doc_id) AS n_docs
            FROM (SELECT lang, doc_id, syllable, count(*) AS n
                FROM (SELECT lang, doc_id, syllables(text) AS said FROM {documents}) LATERAL VIEW explode(said) AS syllable
                GROUP BY lang, doc_id, syllable)
            GROUP BY lang, syllable)""",
        documents=table(spark, folder, "documents"),
    )


def sql_chunks(spark, folder):
    """Chunks of all documents with their word counts, in SQL."""
    SQL.register(spark)
    return spark.sql(
        """SELECT doc_id, CAST(piece AS BIGINT) AS piece, start, md5(c.text) AS text_md5, CAST(size(text_words(c.text)) AS BIGINT) AS n_words
        FROM {documents} d, LATERAL chunks(d.text, 2048) c""",
        documents=table(spark, folder, "documents"),
    )


# ---------------------------------------------------------------- incremental


def turns(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select(F.lit("talks").alias("collection"), F.col("conv_id").cast("string").alias("base"), F.col("turn").alias("seq"), "text")


def append_packed(spark, folder):
    """Turns appended one after the other to the base of their conversation."""
    rows = A.packed_chunks(turns(spark, folder), size=SMALL_CHUNK)
    return rows.select("base", _big("chunk"), _big("start"), F.md5("text").alias("text_md5"))


def append_to_existing(spark, folder):
    """First turns indexed, all later ones appended."""
    every = turns(spark, folder)
    first = every.where("seq = 0").select("collection", "base", F.lit(0).alias("doc"), "text")
    cut = chunking.with_chunks(first, ["collection", "base", "doc"], SMALL_CHUNK).where("piece is not null")
    rows = A.append_rows(cut.withColumnRenamed("piece", "chunk"), every.where("seq > 0"), SMALL_CHUNK)
    return rows.select("base", _big("chunk"), _big("start"), F.md5("text").alias("text_md5"))


def append_index(spark, folder):
    """An index of the first turns after the later ones came in two batches: chunks, frequencies and norms."""
    every = turns(spark, folder)
    index = I.build_index(every.where("seq = 0").select("collection", "base", F.lit(0).alias("doc"), "text"), TableStore(spark), SMALL_CHUNK)
    for batch in ("seq between 1 and 2", "seq > 2"):
        index = A.append_to_index(index, every.where(batch))
    stats = index.chunk_stats.select(*I.CHUNK, "oov", "norm", "union_norm")
    rows = index.numbered(index.chunks.select(*I.CHUNK, "start", "tokens", "text").join(stats, I.CHUNK))
    return rows.select("base", _big("chunk"), _big("start"), _big("tokens"), _big("oov"), _r("norm"), _r("union_norm", 5), F.md5("text").alias("text_md5"))


def append_streamed(spark, folder):
    """The turns arriving in three lots; the stream is started anew for each and goes on from its state."""
    store = TableStore(spark)
    every = turns(spark, folder)
    log = ChunkLog(store)
    for lot, seqs in enumerate(("seq = 0", "seq between 1 and 2", "seq > 2")):
        every.where(seqs).write.parquet(store.path(f"arriving/lot={lot}"))
        texts = spark.readStream.schema(every.schema).parquet(store.path("arriving/lot=*"))
        append_stream(texts, log, store.path("stream_state"), SMALL_CHUNK).awaitTermination()
    return log.current().select("base", _big("chunk"), _big("start"), F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- explain, shards, contract, dictionaries


def explained_dims(spark, folder):
    index = index_of(spark, folder)
    queries = Q.query_frame(spark, SEARCHES)
    rows = X.query_dims(index, queries, X.best_chunks(index, queries))
    return rows.select(_big("query_id"), "token", _big("dim"), _big("count"), "hit", _big("chunk_count"))


def explained_peaks(spark, folder):
    index = index_of(spark, folder)
    queries = Q.query_frame(spark, SEARCHES)
    rows = X.peaks(X.matched_filter(index, queries, X.best_chunks(index, queries)))
    return rows.select(_big("query_id"), _big("word_no"), "term", _big("k"), _r("peak"), _big("peak_pos"), _big("points"))


def recall_sharded(spark, folder):
    index = index_of(spark, folder)
    scores = S.recall(index, S.open_scope(index), Q.query_frame(spark, SEARCHES), cosine="true", idf_mode="classic")
    top = index.numbered(S.best_overall(scores, 20))
    return top.select(_big("query_id"), _big("rank"), "collection", "base", _big("chunk"), _r("cos"))


def json_contract(spark, folder):
    """Bases written as contract lines and parsed back."""
    lines = J.export_lines(index_of(spark, folder))
    sizes = J.parse_lines(lines.where("kind = 'idf'")).groupBy("collection", "base").agg(F.sum(F.size("idf")).alias("n_idf"))
    rows = J.parse_lines(lines.where("kind = 'chunk'")).select("collection", "base", F.col("chunk").alias("c")).join(sizes, ["collection", "base"])
    return rows.select(
        "collection", "base", _big("n_idf"), F.col("c.id").cast("long").alias("chunk"), F.col("c.start").cast("long").alias("start"), F.col("c.tokens").cast("long").alias("tokens"),
        F.col("c.oov").cast("long").alias("oov"), F.size("c.vec").cast("long").alias("dims"), F.round("c.norm", 6).alias("norm"), F.md5("c.text").alias("text_md5"),
    )


def _synonym_rows(df):
    return df.select("w", F.array_join("s", ";").alias("s"))


def dictionary_comma(spark, folder):
    lines = table(spark, folder, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(", "), "p_brand").alias("value"))
    return _synonym_rows(TH.finalize(TH.parse_comma_lines(lines)))


def _part_synsets(spark, folder):
    lines = table(spark, folder, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(";"), "p_type", F.lit(" (kind)")).alias("value"))
    return TH.finalize(TH.parse_synsets(lines))


def dictionary_synsets(spark, folder):
    return _synonym_rows(_part_synsets(spark, folder))


def dictionary_composed(spark, folder):
    """Part names translated to brands, directly and through synonyms."""
    entry = F.concat(
        F.lit("<entry><form><orth>"), F.substring_index("p_name", " ", 1), F.lit('</orth></form><cit type="trans"><quote>'), "p_brand", F.lit("</quote></cit></entry>")
    )
    bridge = TH.parse_bridge(table(spark, folder, "part").select(entry.alias("value")))
    return _synonym_rows(TH.compose(bridge, _part_synsets(spark, folder)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        word_counts, syllable_counts, word_lexicon, phonetic_groups, literal_needles, query_keys, cleaned_texts,
        page_names, interpret_pages, key_terms,
        chunk_index, chunk_stats, base_meta, idf_table, idf_classic, postings, tfidf_weights, position_lists,
        position_gaps, seek_position, zipf_table, zipf_exponent, zipf_coverage, active_dims, oov_tokens, oov_top,
        bigrams, base_embeddings,
        bases_in_scope, collections, stats_rollup, memory_estimate, chunk_window, chunks_by_id, word_keys,
        union_vocabulary, union_norms, fingerprints, base_profile, collection_profile, base_vectors,
        mined_sources, mined_anatomy, mined_records,
        search_all, search_phonetic, search_unified, search_recall_only, search_one_base, search_one_collection,
        search_benchmark, snippets, search_report, recall_candidates, recall_true_cosine, recall_unified,
        search_sequence, bag_scores, word_chains, phrase_positions, document_phrases, correlation_peaks,
        sql_syllables, sql_chunks,
        dictionary_variants, search_expanded, did_you_mean, absence, literal_hits, search_cascade,
        append_packed, append_to_existing, append_index, append_streamed,
        explained_dims, explained_peaks, recall_sharded, json_contract, dictionary_comma, dictionary_synsets, dictionary_composed,
    ]
}
