"""The JSON contract line by line."""

import json

import pytest
from pyspark.sql import functions as F

from lexivane.operators import index as I
from lexivane.plans import workloads
from lexivane.plans.store import TableStore
from lexivane.sources import base_json as J

ROWS = [("c", "a", 0, "casa verde\nOE-6016 casa " * 300), ("c", "a", 1, "porta azul"), ("c", "b c", 0, "porta da montanha"), ("d", "7", 0, "livro")]


def test_lines_hold_the_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "DIMS_PER_LINE", 100)
    index = I.build_index(spark.createDataFrame(ROWS, "collection string, base string, doc long, text string"), TableStore(spark))
    J.write_lines(index, str(tmp_path / "out"))
    lines = J.read_lines(spark, str(tmp_path / "out")).collect()
    assert all(len(json.loads(r["json"])) == 1 for r in lines)
    for row in J.export_bases(index, 100).collect():
        want = json.loads(row["json"])
        vocab = want["meta"].pop("vocab")
        own = [json.loads(r["json"]) for r in lines if (r["collection"], r["base"]) == (row["collection"], row["base"])]
        of = lambda kind: [x[kind] for x in own if kind in x]
        joined = lambda kind: {k: v for x in of(kind) for k, v in x.items()}
        assert of("meta") == [want["meta"]] and joined("idf") == want["idf"] and len(of("vocab")) == -(-len(vocab) // 100)
        assert joined("vocab") == {str(i): t for i, t in enumerate(vocab)}
        assert sorted(of("chunk"), key=lambda c: c["id"]) == want["chunks"]
    parsed = J.parse_lines(J.read_lines(spark, str(tmp_path / "out")))
    assert parsed.where("chunk is not null").count() == index.chunks.count()


def test_registered_query_has_no_limit(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, t, c, b) for i, (c, b, _, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def refuse(*_):
        raise ValueError("limit")

    monkeypatch.setattr(J, "check_limits", refuse)
    rows = workloads.json_contract(spark, str(tmp_path))
    index = workloads.index_of(spark, str(tmp_path))
    assert rows.count() == index.chunks.count() > 4
    assert rows.select("collection", "base", "chunk").distinct().count() == rows.count()
    with pytest.raises(ValueError):
        J.export_bases(index, 1)
    assert rows.where(F.col("n_idf") <= 0).count() == 0
