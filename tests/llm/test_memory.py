"""What a Python worker of the packing operators holds at once."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexivane.llm import complement_packing, ngram_join, packing, word_ids
from lexivane.llm.common import BATCH_BYTES, stored


def test_batches_are_bounded_by_bytes(spark):
    """texts go to Python in batches of the given bytes, however many rows a task has, and the session's limit comes back."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "held"])

    before = spark.conf.get(BATCH_BYTES)
    df = spark.range(0, 6000, 1, 1).select("id", F.expr("repeat(cast(id as string), 500)").alias("text"))
    got = stored(df.mapInArrow(sizes, "rows long, held long"), "batches", 1 << 20).collect()
    assert sum(r.rows for r in got) == 6000 and len(got) > 5 and max(r.held for r in got) < 2 << 20
    assert spark.conf.get(BATCH_BYTES) == before
    with pytest.raises(PySparkException):
        stored(spark.range(3).select(F.expr("raise_error('divided')").alias("x").cast("int")), "batches", 1 << 20)
    assert spark.conf.get(BATCH_BYTES) == before


def test_packing_bounds_its_batches(spark, monkeypatch):
    """the steps of the pipeline and of op9, op13 that hand texts to Python ask for bounded batches; a worker remembers few words."""
    asked = {}
    for module in (packing, complement_packing, ngram_join):
        def counted(df, label, batch_bytes=None):
            asked[label] = batch_bytes
            return stored(df, label, batch_bytes)

        monkeypatch.setattr(module, "stored", counted)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(df).collect()} == {1, 2, 3} == {r.doc_id for r in complement_packing.pack(df).collect()}
    assert ngram_join.linked(df).count() == 3
    for label in ("packing-tokens", "complement-pieces", "ngram-zones", "ngram-sets"):
        assert asked[label] and asked[label] <= 4 << 20, label
    assert word_ids.REMEMBERED_BYTES <= 16 << 20
