"""The pipeline against its stages in plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from test_documents import plain_dropped, plain_groups


def rows():
    rng = random.Random(8)
    vocabulary = [f"word{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(8) for _ in range(4)]
    out = []
    for i in range(50):
        out.append((i, "\n".join(rng.choice(shared) if rng.random() < 0.3 else line(rng.choice([5, 30])) for _ in range(3))))
    for i in range(50, 70):
        words = out[rng.randrange(20)][1].replace("\n", " ").split()
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    out.append((71, line(5000)))
    out += [(80, None), (81, ""), (82, "12 34 !!"), (83, "a"), (84, "a"), (85, out[0][1])]
    return [(i, t, "xx", "s", None if t is None else len(t)) for i, t in out]


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, t) for i, t, *_ in rows() if any(c.isalpha() for c in t or "")]
    gone = plain_dropped(docs)
    docs = [(i, t, "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone.get((i, t), ()))) for i, t in docs]
    docs = [(i, new) for i, old, new in docs if new == old or new.strip()]
    first = {group for (_, n, group) in plain_groups(docs, words=5, percent=80) if n}
    docs = {i: t for i, t in docs if i in first}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in out} == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert max(Counter({r.sequence_id: r.offset + r.length for r in out}).values()) <= 4096


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("print", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
