"""Phrases over whole documents, and the functions by their SQL names."""

from pyspark.sql import functions as F

from lexivane.functions import chunking, sql
from lexivane.functions import text as T
from lexivane.operators import index as I
from lexivane.operators import phrases as PH
from lexivane.plans.store import TableStore


def test_phrases_across_cuts(spark):
    rows = [
        (None, "b", 1, "casa verde ... , casa verde casa"),
        ("c", "b", 2, "verde 12345678901234567890 -- ,, casa verde porta"),
        ("c", "b", 3, "porta"),
        ("c", None, 4, " ".join(["casa"] * 40)),
        ("c", "d", 5, ""),
        ("c", "d", 6, None),
    ]
    docs = spark.createDataFrame(rows, "collection string, base string, doc long, text string")
    index = I.build_index(docs, TableStore(spark), chunk_size=8)
    phrases = ["casa verde", "verde casa verde", "casa casa casa casa", "porta", "a", ""]
    said = {}
    for r in index.chunks.orderBy("doc", "piece").select("collection", "base", "doc", T.line_syllables(F.col("line")).alias("s")).collect():
        said.setdefault((r.collection, r.base, r.doc), []).extend(r.s)
    want = set()
    for i, phrase in enumerate(phrases):
        chain = spark.range(1).select(T.syllable_seq(F.lit(phrase)).alias("c")).first().c
        for key, seq in said.items():
            want |= {(i, *key, p) for p in range(len(seq)) if len(chain) > 1 and seq[p : p + len(chain)] == chain}
    found = [tuple(r) for r in PH.document_phrases(index, phrases).select("query_id", "collection", "base", "doc", "pos").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {w[0] for w in want} == {0, 1, 2, 3}
    inside = PH.phrase_positions(index, phrases).count()
    assert inside < len(want)


def test_sql_names_equal_column_functions(spark):
    texts = [("Coração d'água, o que guerra\\ 'linguística' Häuser",), ("",), (None,), ("a " * 3000,)]
    df = spark.createDataFrame(texts, "value string")
    sql.register(spark)
    sql.register(spark)
    for name, function in sql.SCALARS.items():
        asked = spark.sql(f"SELECT {name}(value) AS x FROM {{t}}", t=df)
        assert asked.collect() == df.select(function(F.col("value")).alias("x")).collect(), name
        assert "Python" not in asked._jdf.queryExecution().executedPlan().toString()


def test_sql_chunks_equal_column_chunks(spark):
    texts = [(1, "um dois três quatro"), (2, ""), (3, None), (4, "x" * 50 + " y"), (5, "  ")]
    df = spark.createDataFrame(texts, "doc long, text string")
    sql.register(spark)
    asked = spark.sql("SELECT doc, c.piece, c.start, c.text FROM {t} t, LATERAL chunks(t.text, 8) c", t=df)
    cut = chunking.with_chunks(df, ["doc"], 8).where("piece is not null").select("doc", "piece", "start", "text")
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, cut.collect()))
    assert asked.count() > 8
