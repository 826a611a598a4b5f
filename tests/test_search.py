import math

import pytest
from pyspark.sql import functions as F

import brute
from lexivane.functions import text as T
from lexivane.operators import index as I
from lexivane.operators import profile as P
from lexivane.operators import search as S
from lexivane.plans.store import TableStore

TEXTS = {
    ("books", "a"): ["casa verde com porta azul", "casa amarela sem janela e outra casa"],
    ("books", "b"): ["o aparecimento da lua na casa", "ele apareceu e desapareciam as luzes"],
    ("notes", "solo"): ["Aslan falou da montanha"],
}


def docs(spark, texts=TEXTS):
    rows = [(c, b, i, t) for (c, b), listed in texts.items() for i, t in enumerate(listed)]
    return spark.createDataFrame(rows, "collection string, base string, doc long, text string")


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(docs(spark), TableStore(spark))


def hits(index, query, **options):
    return S.search(index, query, now=0, **options).orderBy("query_id", "rank").collect()


def test_smoothed_idf(index):
    rows = {(r["base"], r["token"]): r["idf"] for r in index.idf.collect()}
    assert rows["a", "ca"] == round(math.log(3 / 2), 6)
    assert rows["solo", "mon"] == round(math.log(2), 6)


def test_one_chunk_score_may_exceed_one(index):
    row = hits(index, "falou", base="solo", rerank=False)[0]
    assert row["cos"] > 0.5 and row["matchpoint"] == row["cos"] and row["coverage"] is None
    top = hits(index, TEXTS["notes", "solo"][0], base="solo")[0]
    assert top["cos"] == pytest.approx(1 / math.log(2), abs=1e-5)


def test_dense_numbers_and_offsets(index):
    rows = index.numbered(index.chunks).select("base", "chunk", "start").collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 1, 0), ("solo", 0, 0)]


def test_root_matches_only_at_word_start(index):
    found = hits(index, "aparecimento", collection="books")
    by_chunk = {(r["base"], r["chunk"]): r["coverage"] for r in found}
    assert by_chunk["b", 0] == 1.0
    assert by_chunk["b", 1] == 1.0  # shares the first three syllables
    assert all(v == 0.0 for k, v in by_chunk.items() if k[0] == "a")


def test_phonetic(index):
    assert hits(index, "Aslam", base="solo")[0]["coverage"] == 0.0
    assert hits(index, "Aslam", base="solo", phonetic=True)[0]["coverage"] == 1.0


def test_span_and_weights_against_brute_force(spark, index):
    query = "casa janela porta"
    split = lambda t: [w.split("|") for w in spark.range(1).select(T.line_words(T.syllable_line(F.lit(t))).alias("w")).first()["w"]]
    terms = [t for t in split(query) if len(t) > 1]
    texts = [t for (c, _), listed in TEXTS.items() if c == "books" for t in listed]
    vocab = {r["token"] for r in index.vocab.collect()}
    chunks = [{s for w in split(t) for s in w} for t in texts]
    weight = lambda term: sum(brute.idf(len(chunks), n) for s in term if s in vocab and (n := sum(s in c for c in chunks)))
    want = {t: brute.coverage(terms, [weight(x) for x in terms], split(t)) for t in texts}
    at = {(b, i): t for (c, b), listed in TEXTS.items() if c == "books" for i, t in enumerate(listed)}
    for row in hits(index, query, collection="books", k=10):
        cover, span = want[at[row["base"], row["chunk"]]]
        assert row["coverage"] == pytest.approx(cover) and row["span"] == span


def test_ties_prefer_the_later_chunk(spark):
    same = I.build_index(docs(spark, {("c", "b"): ["casa", "casa", "casa"]}), TableStore(spark))
    assert [r["chunk"] for r in hits(same, "casa", k=2)] == [2, 1]


def test_snippet_marks(index):
    assert hits(index, "porta")[0]["snippet"] == "casa verde com «porta» azul"


def test_scope_and_empty_queries(index):
    assert hits(index, "zzz www") == []
    assert {r["base"] for r in hits(index, "casa", base="a*")} == {"a"}
    assert S.resolve_scope(index, "books", "*").count() == 2


def test_profile_values(spark):
    vocab = spark.createDataFrame([("one", 0, "fro", False), ("one", 1, "do", False), ("two", 0, "do", False), ("two", 1, "ga", False)], "driver string, dim int, token string, is_keyword boolean")
    rows = spark.createDataFrame([("c", "a", 0, "fro do", "one"), ("c", "b", 0, "do ga", "two")], "collection string, base string, doc long, text string, driver string")
    built = I.build_index(rows, TableStore(spark), vocab=vocab)
    uidf = {r["token"]: r["uidf"] for r in built.union_idf.collect()}
    assert uidf["do"] == pytest.approx(math.log(3 / 2)) and uidf["fro"] == pytest.approx(math.log(3))
    dims = {r["token"]: r["u_dim"] for r in P.union_vocabulary(built).collect()}
    assert dims == {"fro": 0, "do": 1, "ga": 2}
    found = S.search(built, "do", unified=True, rerank=False).collect()
    assert {r["base"] for r in found} == {"a", "b"}


def test_last_dimension_of_a_duplicate_wins(spark):
    vocab = spark.createDataFrame([("PTBR", 0, "ca", False), ("PTBR", 1, "sa", False), ("PTBR", 2, "ca", True)], "driver string, dim int, token string, is_keyword boolean")
    built = I.build_index(docs(spark, {("c", "b"): ["casa"]}), TableStore(spark), vocab=vocab)
    assert {r["token"]: r["dim"] for r in built.postings.collect()} == {"ca": 2, "sa": 1}
    assert built.bases.first()["vocab_size"] == 3


def test_without_text_there_is_no_rerank(spark):
    built = I.build_index(docs(spark), TableStore(spark), with_text=False)
    row = S.search(built, "casa", k=1).first()
    assert row["coverage"] is None and row["matchpoint"] == row["cos"]


def test_sequence_mode(index):
    rows = S.search_sequence(index, "montanha falou", base="a*").collect()
    assert all(0 <= r["mf"] <= 1 and r["rr"] <= r["mf"] for r in rows)
    exact = S.search_sequence(index, "casa verde", base="a").orderBy("rank").first()
    assert exact["mf"] == 1.0 and exact["rr"] == pytest.approx(1 / (1 + 2 / 8))


def test_hot_base_is_numbered_in_order(spark):
    rows = spark.range(3000).select(
        F.lit("c").alias("collection"),
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("base"),
        F.col("id").alias("doc"),
        F.repeat(F.lit("casa "), (F.col("id") % 5).cast("int")).alias("text"),
    )
    built = I.build_index(rows, TableStore(spark), chunk_size=8)
    numbers = built.numbered(built.chunks).where("base = 'hot'").select("doc", "piece", "chunk").orderBy("doc", "piece").collect()
    assert [r["chunk"] for r in numbers] == list(range(len(numbers)))
