"""Ranked search: sparse recall over postings, row-local rerank, merge over bases.

All queries of a call run in one job keyed by ``query_id``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexivane.functions import text as T
from lexivane.operators import queries as Q
from lexivane.operators import rerank as R
from lexivane.operators.batch_recall import best_by_base
from lexivane.operators.index import BASE, CHUNK, Index, cell_of, cell_prefix, cell_suffix, classic_idf
from lexivane.operators.snippets import with_snippet

SORT_DIGITS = 9
RECENCY_DECAY_SECONDS = 7 * 86400.0


#: As many tokens of a batch of queries are named to the scans of postings and frequencies.
NAMED_TOKENS = 1000
#: Batches of more queries are recalled chunk by chunk instead of posting by posting.
FEW_QUERIES = 50


@dataclass
class Scope:
    """Bases a search looks at, and the condition that leaves only their cells and rows of a stored table."""

    bases: DataFrame
    condition: Column | None
    collection: Column | None

    def of(self, df: DataFrame) -> DataFrame:
        """``df``, a table that is stored by cells, cut to the scope: cells by their folders, bases by row groups."""
        return df if self.condition is None else df.where(self.condition)

    def of_collections(self, df: DataFrame) -> DataFrame:
        return df if self.collection is None else df.where(self.collection)


def scope_conditions(collection: str | None = None, base: str = "*") -> tuple[Column | None, Column | None]:
    """Conditions on ``cell, collection, base``, and on ``collection`` alone; None where all is in scope."""
    named, exact = collection not in (None, "*"), not base.endswith("*")
    held = []
    if named and exact:
        held.append(F.col("cell") == cell_of(F.lit(collection), F.lit(base)))
    elif named:
        held.append(F.col("cell").startswith(cell_prefix(F.lit(collection))))
    elif exact:
        held.append(F.col("cell").endswith(F.concat(F.lit("b"), cell_suffix(F.lit(base)))))
    if named:
        held.append(F.col("collection") == collection)
    if exact:
        held.append(F.col("base") == base)
    elif base != "*":
        held.append(F.col("base").startswith(base[:-1]))
    whole = None
    for one in held:
        whole = one if whole is None else whole & one
    return whole, F.col("collection") == collection if named else None


def resolve_scope(index: Index, collection: str | None = None, base: str = "*") -> DataFrame:
    """Bases by exact collection (or all) and exact, ``prefix*`` or ``*`` base name."""
    rows = index.bases
    if collection not in (None, "*"):
        rows = rows.where(F.col("collection") == collection)
    if base.endswith("*"):
        return rows.where(F.col("base").startswith(base[:-1])) if base != "*" else rows
    return rows.where(F.col("base") == base)


def open_scope(index: Index, collection: str | None = None, base: str = "*") -> Scope:
    """Bases in scope, each with ``shared``: whether its collection has others in scope."""
    rows = resolve_scope(index, collection, base)
    alone = not base.endswith("*")  # a name is one base of a collection
    shared = F.lit(False) if alone else F.count("*").over(Window.partitionBy("collection")) > 1
    return Scope(rows.select(*BASE, "n_chunks", "language", shared.alias("shared")), *scope_conditions(collection, base))


def _by(*keys):
    return [F.round(F.col(k), SORT_DIGITS).desc() for k in keys]


def known_tokens(index: Index, queries: DataFrame) -> tuple[DataFrame, Column]:
    """Token counts of queries that the vocabulary has, and a condition on ``token`` for the scans that they are joined with."""
    known = index.vocab.select("token")
    tokens = Q.query_tokens(queries).join(known, "token", "left_semi")
    names = [r["token"] for r in tokens.select("token").distinct().limit(NAMED_TOKENS + 1).collect()]
    return tokens, F.col("token").isin(*names) if len(names) <= NAMED_TOKENS else F.lit(True)


def query_vectors(index: Index, scope: Scope, tokens: DataFrame, idf_mode: str = "smoothed", unified: bool = False, named: Column | None = None) -> DataFrame:
    """``query_id, collection, base, token, qw, q_norm``: weights of each query in each base.

    A unified search weighs by the collection where the collection has several bases in scope.
    """
    bases = scope.bases.select(*BASE, "shared")
    local_idf = F.col("idf") if idf_mode == "smoothed" else F.round(classic_idf(F.col("n_chunks"), F.col("df")), 6)
    named = F.lit(True) if named is None else named
    idf = scope.of(index.idf).where(named).select(*BASE, "token", local_idf.alias("idf"))
    w = Window.partitionBy("query_id", *BASE)
    norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(w))
    finish = lambda df: df.where(F.col("qw") != 0).withColumn("q_norm", norm)
    keep = ["query_id", *BASE, "token", "qw"]
    local = idf.join(tokens, "token").join(bases, BASE).withColumn("qw", F.col("q_tf") * F.col("idf"))
    if not unified:
        return finish(local.select(keep))
    wide = (
        scope.of_collections(index.union_idf).where(named).select("collection", "token", "uidf")
        .join(tokens, "token")
        .join(bases.where("shared"), "collection")
        .withColumn("qw", F.col("q_tf") * F.col("uidf"))
    )
    alone = local.where(~F.col("shared"))
    return finish(wide.select(keep).unionByName(alone.select(keep)))


def recall(
    index: Index,
    scope: Scope,
    queries: DataFrame,
    unified: bool = False,
    cosine: str = "asymmetric",
    idf_mode: str = "smoothed",
) -> DataFrame:
    """Score every chunk that shares a token with a query: ``query_id, CHUNK, uid, cos``.

    ``asymmetric`` multiplies the query's tf-idf with the raw counts of the chunk over the product of
    the tf-idf norms; ``true`` weighs both sides; ``plain`` uses raw counts on both sides.
    """
    tokens, named = known_tokens(index, queries)
    qv = query_vectors(index, scope, tokens, idf_mode, unified, named)
    joined = scope.of(index.postings).where(named).select(*BASE, "uid", "token", "tf").join(qv, BASE + ["token"])
    weight = F.col("qw") / F.col("q_norm") * F.col("tf")
    if cosine == "true":
        local = F.col("idf_exact") if idf_mode == "smoothed" else classic_idf(F.col("n_chunks"), F.col("df"))
        joined = joined.join(scope.of(index.idf).where(named).select(*BASE, "token", local.alias("c_idf")), BASE + ["token"])
        weight = weight * F.col("c_idf")
    # two long keys and one double: the compact shape of Spark's hash aggregation
    dots = joined.select("query_id", "uid", weight.alias("w")).groupBy("query_id", "uid").agg(F.sum("w").alias("dot"))
    scored = dots.join(chunk_norms(index, scope, unified, idf_mode), "uid")
    return scored.withColumn("cos", F.col("dot") / F.col("c_norm")).where("cos > 0").select("query_id", *CHUNK, "uid", "cos")


def chunk_norms(index: Index, scope: Scope, unified: bool = False, idf_mode: str = "smoothed") -> DataFrame:
    """``CHUNK, uid, c_norm``: the norm that divides the scores of a chunk."""
    norms = scope.of(index.chunk_stats).select(*CHUNK, "uid", "norm", "union_norm")
    if idf_mode != "smoothed":
        norms = norms.drop("norm").join(_classic_norms(index, scope), "uid")
    c_norm = F.col("norm")
    if unified:
        norms = norms.join(scope.bases.select(*BASE, "shared"), BASE)
        c_norm = F.when(F.col("shared"), F.col("union_norm")).otherwise(F.col("norm"))
    return norms.select(*CHUNK, "uid", c_norm.alias("c_norm"))


def best_recalled(index: Index, scope: Scope, queries: DataFrame, n: int, unified: bool = False) -> DataFrame:
    """:func:`top_candidates` of :func:`recall`. Few queries meet the postings of their tokens; of many, most tokens are
    asked for by some, so chunks meet all queries at once."""
    n_queries = queries.limit(FEW_QUERIES + 1).count()
    if n_queries <= FEW_QUERIES:
        return top_candidates(recall(index, scope, queries, unified), n)
    tokens, named = known_tokens(index, queries)
    qv = query_vectors(index, scope, tokens, unified=unified, named=named)
    weights = qv.select("query_id", *BASE, "token", (F.col("qw") / F.col("q_norm")).alias("w"))
    chunks = scope.of(index.chunks).select("uid", "hist").join(chunk_norms(index, scope, unified), "uid")
    found = best_by_base(chunks, scope.bases.select(*BASE, "n_chunks"), weights, queries.count(), n)
    return top_candidates(found, n)


def _classic_norms(index: Index, scope: Scope) -> DataFrame:
    idf = scope.of(index.idf).select(*BASE, "token", classic_idf(F.col("n_chunks"), F.col("df")).alias("c_idf"))
    weight = F.col("tf") * F.col("c_idf")
    total = F.sqrt(F.sum(weight * weight))
    return scope.of(index.postings).join(idf, BASE + ["token"]).groupBy("uid").agg(
        F.round(F.when(total > 0, total).otherwise(1.0), 6).alias("norm")
    )


def top_candidates(scores: DataFrame, n: int) -> DataFrame:
    """Best ``n`` chunks per query and base; ties go to the later chunk.

    The row-number filter becomes a group limit before the shuffle, so a hot base sends only ``n``
    rows per task.
    """
    w = Window.partitionBy("query_id", *BASE).orderBy(*_by("cos"), F.desc("doc"), F.desc("piece"))
    return scores.withColumn("recall_rank", F.row_number().over(w)).where(F.col("recall_rank") <= n)


def best_overall(scores: DataFrame, n: int) -> DataFrame:
    """Best ``n`` chunks per query over all bases; Spark keeps n rows per task before it merges them."""
    order = Window.partitionBy("query_id").orderBy(*_by("cos"), F.desc("doc"), F.desc("piece"), F.asc("collection"), F.asc("base"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def term_weights(index: Index, scope: Scope, terms: DataFrame) -> DataFrame:
    """``query_id, collection, base, weight_of``: idf mass per term, in the scale of the collection
    when it has several bases in scope."""
    tokens = Q.term_tokens(terms)
    bases = scope.bases.select(*BASE, "shared")
    keys = ["query_id", *BASE, "term_no"]
    wide = scope.of_collections(index.union_idf).join(tokens, "token").join(bases.where("shared"), "collection").select(*keys, F.col("uidf").alias("w"))
    alone = scope.of(index.idf).join(tokens, "token").join(bases.where(~F.col("shared")), BASE).select(*keys, F.col("idf").alias("w"))
    summed = wide.unionByName(alone).groupBy(*keys).agg(F.sum("w").alias("w"))
    return summed.groupBy("query_id", *BASE).agg(F.map_from_entries(F.collect_list(F.struct("term_no", "w"))).alias("weight_of"))


@dataclass
class Chosen:
    """Candidate chunks in a table of their own, and the condition that leaves their cells and surrogates of ``chunks``."""

    rows: DataFrame
    condition: Column

    def of(self, chunks: DataFrame) -> DataFrame:
        return chunks.where(self.condition)


def chosen(index: Index, candidates: DataFrame) -> Chosen:
    """Write candidates (with ``uid``), a few per query and base, and note the cells they lie in, which are bounded by the layout, and their range."""
    seen = Observation()
    cells = F.collect_set(cell_of(F.col("collection"), F.col("base")))
    rows = index.store.save(f"candidates-{uuid.uuid4().hex}", candidates.observe(seen, F.min("uid").alias("lo"), F.max("uid").alias("hi"), cells.alias("cells")))
    at = seen.get
    if not at["cells"]:
        return Chosen(rows, F.lit(False))
    return Chosen(rows, F.col("cell").isin(*at["cells"]) & F.col("uid").between(at["lo"], at["hi"]))


def scored_candidates(
    index: Index,
    scope: Scope,
    queries: DataFrame,
    candidates: Chosen,
    phonetic: bool,
    carry: tuple[str, ...] = ("cos",),
) -> DataFrame:
    """Join candidates with their syllable lines, then add coverage and span."""
    terms = Q.query_terms(queries)
    few = candidates.rows.select("query_id", *CHUNK, *carry)
    lines = candidates.of(index.chunks).select(*CHUNK, "start", "line").join(few, CHUNK)
    return R.with_coverage(lines, terms, term_weights(index, scope, terms), phonetic, ("start", *carry))


def path_columns(hits: DataFrame) -> DataFrame:
    return hits.withColumn("path", T.hit_path(F.col("base"), F.col("corpus")))


def recency(mtime, now):
    """Freshness factor shown with a hit; it never changes the order by itself."""
    age = F.greatest(now - mtime, F.lit(0))
    return F.format_number(
        F.when(mtime == 0, F.lit(1.0)).otherwise(1 + 0.10 * F.exp(-age / RECENCY_DECAY_SECONDS)), 3
    )


def merge(hits: DataFrame, k: int) -> DataFrame:
    """Best ``k`` hits per query over all bases: relevance, proximity, cosine, then recency."""
    order = [
        *_by("matchpoint"),
        F.col("span").asc_nulls_first(),
        *_by("cos"),
        F.desc("mtime"),
        F.asc("collection"),
        F.asc("base"),
        F.desc("doc"),
        F.desc("piece"),
    ]
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    index: Index,
    queries,
    collection: str | None = None,
    base: str = "*",
    k: int = 5,
    recall_n: int = 20,
    rerank: bool = True,
    phonetic: bool = False,
    unified: bool = False,
    now: int | None = None,
    snippets: bool = True,
    with_keys: bool = False,
) -> DataFrame:
    """Ranked hits of every query over the scope; ``with_keys`` keeps ``doc``, ``piece`` and ``uid``."""
    queries = Q.query_frame(index.spark, queries)
    scope = open_scope(index, collection, base)
    keep = max(k, recall_n) if rerank else k
    candidates = chosen(index, best_recalled(index, scope, queries, keep, unified))
    meta = index.bases.select(*BASE, "corpus", "mtime", "with_text")
    if rerank:
        # bases without stored texts have no coverage: their hits rank by cosine
        scored = scored_candidates(index, scope, queries, candidates, phonetic).join(meta, BASE)
        scored = scored.withColumns({c: F.when(F.col("with_text"), F.col(c)) for c in ("coverage", "span")})
        scored = scored.withColumn("matchpoint", F.coalesce("coverage", "cos"))
    else:
        starts = candidates.of(index.chunks).select(*CHUNK, "start")
        scored = (
            starts.join(candidates.rows.drop("uid"), CHUNK)
            .withColumn("matchpoint", F.col("cos"))
            .withColumn("coverage", F.lit(None).cast("double"))
            .withColumn("span", F.lit(None).cast("int"))
            .join(meta, BASE)
        )
    if with_keys:
        scored = scored.join(candidates.rows.select("query_id", *CHUNK, "uid"), ["query_id", *CHUNK])
    hits = merge(scored.drop("with_text"), k)
    clock = F.lit(now) if now is not None else F.unix_timestamp()
    hits = path_columns(hits).withColumn("recency", recency(F.col("mtime"), clock))
    if snippets:
        # texts are read only for the hits that are shown
        texts = candidates.of(index.chunks).select(*CHUNK, "text")
        asked = hits.join(queries, "query_id")
        hits = with_snippet(texts.join(asked, CHUNK))
    else:
        hits = hits.withColumn("snippet", F.lit(None).cast("string"))
    spans = scope.of(index.doc_spans).select(*BASE, "doc", "first_chunk")
    numbered = spans.join(hits, BASE + ["doc"])
    return numbered.withColumn("chunk", (F.col("first_chunk") + F.col("piece")).cast("long")).select(
        "query_id", "rank", *BASE, "corpus", "path", "matchpoint", "coverage", "span", "cos", "chunk", "start", "snippet", "recency",
        *(["doc", "piece", "uid"] if with_keys else []),
    )


def search_report(index: Index, queries, collection: str | None = None, base: str = "*", unified: bool = False) -> DataFrame:
    """Per query and base: chunks, converging chunks, active dimensions, out-of-vocabulary count.

    A unified search leaves the out-of-vocabulary count at 0, as the collection space decides.
    """
    queries = Q.query_frame(index.spark, queries)
    scope = open_scope(index, collection, base)
    tokens = Q.query_tokens(queries)
    keys = ["query_id", *BASE]
    converge = recall(index, scope, queries, unified).groupBy(*keys).agg(F.count("*").alias("n_converge"))
    dims = query_vectors(index, scope, tokens, unified=unified).groupBy(*keys).agg(F.count("*").alias("dims"))
    known = index.vocab.select("token").distinct().withColumn("hit", F.lit(1))
    unknown = tokens.join(known, "token", "left").groupBy("query_id").agg(
        F.sum(F.when(F.col("hit").isNull(), F.col("q_tf")).otherwise(0)).alias("oov")
    )
    asked = queries.agg(F.collect_list("query_id")).scalar()
    every = scope.bases.select(*BASE, "n_chunks", F.explode(asked).alias("query_id"))
    zero = F.lit(0)
    return (
        every.join(converge, keys, "left")
        .join(dims, keys, "left")
        .join(unknown, "query_id", "left")
        .select(
            *keys,
            "n_chunks",
            F.coalesce("n_converge", zero).alias("n_converge"),
            F.coalesce("dims", zero).alias("dims"),
            (zero if unified else F.coalesce("oov", zero)).alias("oov"),
        )
    )


def search_sequence(index: Index, queries, collection=None, base="*", k: int = 5, recall_n: int = 20) -> DataFrame:
    """Proof-of-concept mode: classic idf, sliding matched filter, score ``mf / (1 + span/8)``."""
    queries = Q.query_frame(index.spark, queries)
    scope = open_scope(index, collection, base)
    keep = max(k, recall_n)
    candidates = chosen(index, top_candidates(recall(index, scope, queries, idf_mode="classic"), keep))
    worded = queries.withColumn("q_words", T.chunk_words(F.col("query")))
    carried = candidates.rows.drop("uid").join(worded, "query_id")
    lines = candidates.of(index.chunks).select(*CHUNK, "start", "line", "text")
    scored = R.with_matched_filter(lines.join(carried, CHUNK))
    order = [*_by("rr", "cos"), F.desc("doc"), F.desc("piece")]
    w = Window.partitionBy("query_id", *BASE).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return with_snippet(best, fixed_window=True).select(
        "query_id", *CHUNK, "rank", "rr", "mf", "span", "cos", "start", "snippet"
    )
