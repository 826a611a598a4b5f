"""Row-local tokenizing, positions, batch recall and the SQL of syllables against plain forms of the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.functions import lines
from lexivane.functions import text as T
from lexivane.operators import batch_recall
from lexivane.operators import catalog as C
from lexivane.operators import expand as E
from lexivane.operators import index as I
from lexivane.operators import lexicon as L
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.plans import workloads
from lexivane.plans.store import TableStore

TEXTS = [
    "Casa verde, águia! Quinhentos chapéus; guerra de guitarra", "saída PAÍS coração\npsicologia  atleta", "", "...", None,
    "ilha lhama ninho ñandu İstanbul ΣΑΣ über", "aqui agora agudo linguiça pinguim " * 40, "x" * 90 + "ae" * 30, "a a a casa casa",
]


def indexed(spark, texts=TEXTS, size=64):
    rows = [("c" + str(i % 2), "b" + str(i % 3), i, t) for i, t in enumerate(texts)]
    return I.build_index(spark.createDataFrame(rows, "collection string, base string, doc long, text string"), TableStore(spark), size)


def test_histograms_of_batches_equal_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(lines, "ROWS_AT_ONCE", 3)
    index = indexed(spark)
    said = T.syllable_seq(F.col("text"))
    rows = index.chunks.select("line", "tokens", "hist", T.syllable_line(F.col("text")).alias("l"), F.size(said).alias("n"), T.histogram(said).alias("h")).collect()
    assert len(rows) > 10
    assert all((r.line, r.tokens, r.hist) == (r.l, r.n, r.h) for r in rows)
    empty = index.raw_chunks.where("piece is null").select("tokens", "hist", "line").collect()
    assert empty and all(r.tokens is None for r in empty)


def test_tokenizing_runs_no_expression_per_syllable(spark):
    plan = I.token_columns(spark.createDataFrame([], "collection string, base string, doc long, piece int, driver string, start long, len int, doc_bytes long, text string"))
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan


def test_norms_do_not_shuffle_postings(spark):
    index = indexed(spark)
    stats = I.stats_per_chunk(index.chunks, index.postings, index.idf, index.union_idf, index.store)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = stats._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [collection" in plan


def test_positions_are_numbered_before_they_are_spread(spark):
    index = indexed(spark)
    got = L.position_lists(index, numbered=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    listed = index.numbered(index.chunks).select("base", "collection", "chunk", F.posexplode(T.line_syllables(F.col("line"))).alias("pos", "token"))
    expected = {(r.collection, r.base, r.chunk, r.token): r.p for r in listed.groupBy("collection", "base", "chunk", "token").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()}
    assert {(r.collection, r.base, r.chunk, r.token): r.positions for r in got.collect()} == expected


def test_words_and_keys_leave_a_task_once(spark):
    index = indexed(spark)
    got = sorted(r.key for r in C.scope_word_keys(index).collect())
    plain = index.chunks.select(F.explode(F.transform(T.line_words(F.col("line")), T.word_key)).alias("key")).distinct()
    assert got == sorted(r.key for r in plain.collect()) and got
    assert "Generate" not in C.scope_word_keys(index)._jdf.queryExecution().optimizedPlan().toString()
    words = index.chunks.select(T.word_line(F.col("text"))).mapInArrow(lines.distinct_words, "word string").distinct()
    plain = index.chunks.select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    assert sorted(r.word for r in words.collect()) == sorted(r.word for r in plain.collect())


def test_expanded_search_looks_through_the_scope_once(spark):
    index = indexed(spark)
    queries = Q.query_frame(spark, ["casa verde"])
    kept = spark.createDataFrame([(0, 0, "casa verde", "original"), (0, 1, "guerra", "dict")], "query_id long, variant_no int, variant string, source string")
    marked = kept.where(F.col("variant") != "a mark of this test")
    found = E.search_kept(index, queries, marked)
    assert "a mark of this test" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count()


@pytest.mark.parametrize("unified", [False, True])
def test_batch_recall_equals_postings(spark, monkeypatch, unified):
    words = ["casa", "verde", "porta", "janela", "rua", "mesa", "livro", "chuva"]
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice(words, 12)) for _ in range(60)] * 2 + ["", None]
    index = indexed(spark, texts)
    queries = spark.createDataFrame([(i, " ".join(draw.choice(words, 3))) for i in range(12)] + [(99, "zzz"), (100, "")], "query_id long, query string")
    scope = S.open_scope(index)
    rows = lambda df: sorted((r.query_id, r.collection, r.base, r.recall_rank, r.doc, r.piece, r.uid, round(r.cos, 8)) for r in df.collect())
    expected = rows(S.top_candidates(S.recall(index, scope, queries, unified), 4))
    monkeypatch.setattr(S, "FEW_QUERIES", 0)
    for name, value in (("CHUNKS_OF_A_GROUP", 7), ("QUERIES_OF_A_GROUP", 5), ("TILE", 3), ("PENDING", 10)):
        monkeypatch.setattr(batch_recall, name, value)
    got = S.best_recalled(index, scope, queries, 4, unified)
    assert expected and rows(got) == expected


def test_syllables_by_sql_hash_and_count_each_document_once(spark, tmp_path):
    rows = [(1, "casa casa", "pt"), (1, "casa", "pt"), (None, "casa", "pt"), (2, "verde", None), (3, None, "pt")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = workloads.sql_syllables(spark, str(tmp_path))
    assert "SortAggregate" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {(r.lang, r.syllable): (r.n, r.n_docs, r.code) for r in got.collect()} == {
        ("pt", "ca"): (4, 1, "C000"), ("pt", "sa"): (4, 1, "S000"), (None, "ver"): (1, 1, "V600"), (None, "de"): (1, 1, "D000"),
    }
