"""Tables stored by cells: scans pruned by scope, changes that leave other cells alone."""

import re

import pytest
from pyspark.sql import functions as F

from lexivane.operators import append as A
from lexivane.operators import index as I
from lexivane.operators import queries as Q
from lexivane.operators import search as S
from lexivane.plans.store import TableStore

ROWS = [(f"c{i % 3}", f"b{i % 7}", i, f"casa verde numero {i} com porta azul e janela " * (1 + i % 4)) for i in range(84)]
SCHEMA = "collection string, base string, doc long, text string"


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(spark.createDataFrame(ROWS, SCHEMA), TableStore(spark), 128)


def scans(df):
    """Partition filters and pushed filters of every scan of a table by cells."""
    plan = df._jdf.queryExecution().optimizedPlan().toString() and df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for block in re.split(r"\n\n", plan):
        found = re.search(r"Location: .*/(postings|idf|chunk_stats|chunks|doc_spans)/generation", block)
        if found:
            part = re.search(r"PartitionFilters: \[(.*)\]", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            yield found[1], part[1] if part else "", pushed[1] if pushed else ""


def test_scope_reaches_every_scan(spark, index):
    asked = Q.query_frame(spark, ["casa azul"])
    scope = S.open_scope(index, "c1", "b4")
    found = list(scans(S.recall(index, scope, asked)))
    assert {name for name, *_ in found} == {"postings", "idf", "chunk_stats"}
    for name, part, pushed in found:
        assert "cell" in part and "EqualTo(base,b4)" in pushed, name
        assert name == "chunk_stats" or "In(token" in pushed or "EqualTo(token" in pushed, name
    by_collection = list(scans(S.recall(index, S.open_scope(index, "c1"), asked)))
    assert by_collection and all("StartsWith(cell" in part or "cell" in part for _, part, _ in by_collection)
    candidates = S.chosen(index, S.top_candidates(S.recall(index, scope, asked), 5))
    ((name, part, pushed),) = scans(candidates.of(index.chunks).select(*I.CHUNK, "line"))
    assert name == "chunks" and "cell" in part and "uid" in pushed


def test_hits_of_a_scope_are_those_of_the_whole(spark, index):
    rows = lambda **scope: {tuple(r) for r in S.search(index, ["casa azul", "numero porta"], k=100, recall_n=100, now=0, snippets=False, **scope).drop("rank").collect()}
    whole = rows()
    assert rows(collection="c1", base="b4") == {r for r in whole if (r[1], r[2]) == ("c1", "b4")}
    assert rows(base="b*") == whole and rows(base="b9") == set()
    assert {r[:8] for r in rows(base="b4")} == {r[:8] for r in whole if r[2] == "b4"}


def files_of(index):
    return {name: set(index.frame(name).inputFiles()) for name in ("chunks", "postings", "idf", "doc_spans")}


def state(index):
    stats = index.numbered(index.chunk_stats).select(*I.BASE, "chunk", "tokens", "oov", F.round("norm", 6), F.round("union_norm", 6))
    idf = index.union_idf.select("collection", "token", "df", "n_chunks")
    return sorted(map(tuple, stats.collect())), sorted(map(tuple, idf.collect())), sorted(map(tuple, index.bases.select(*I.BASE, "n_chunks", "bytes").collect()))


def test_append_leaves_other_cells_alone(spark, index):
    before, old = files_of(index), state(index)
    more = spark.createDataFrame([("c1", "b4", 0, " mais uma casa vermelha"), ("c1", "new", 0, "texto novo")], "collection string, base string, seq long, text string")
    after = A.append_to_index(index, more)
    assert state(index) == old  # readers of the former generation keep theirs
    cells = {r["cell"] for r in more.select(I.cell_of(F.col("collection"), F.col("base")).alias("cell")).collect()}
    untouched = lambda files: {f for f in files if not any(f"cell={c}/" in f for c in cells)}
    for name, files in files_of(after).items():
        assert untouched(files) == untouched(before[name]) and untouched(files) and files != before[name], name

    named = I.changed_index(after, spark.createDataFrame([("c2", "b4")], "collection string, base string"), lambda rows: rows.where("base <> 'b4' or collection <> 'c2'"))
    rebuilt = I.index_rows(named.source_rows, TableStore(spark), 128)
    assert state(named) == state(rebuilt)
    assert named.bases.where("collection = 'c2' and base = 'b4'").count() == 0
