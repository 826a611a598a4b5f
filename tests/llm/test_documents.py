"""Operators on documents against plain statements on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.llm import language_id, line_dedup, lm_scoring, ngram_join, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = {"aa": "la casa verde que los niños miran en el camino".split(), "bb": "the green house that children look at on their way".split()}


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, prose(rng, lang, rng.choice([1, 5, 40, 400])), lang, "s", 1, "x"))
    rows += [(200, None, "aa", None, None, None), (201, "", None, "s", 0, "x"), (202, "12 ... !!", "bb", "s", 9, "x"), (203, "x" * 30000, None, "s", 30000, "x")]
    rows += [rows[0], rows[0], (None, "la casa verde", "aa", "s", 3, "x"), (None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(doc_id, parts, part):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == part


def test_language(documents):
    rows, df = documents
    out = language_id.identified(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    lang = {r[0]: r[2] for r in rows}
    right = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert sum(right) >= 0.9 * len(right)
    for r in out:
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))


def test_language_of_nothing(documents, empty):
    assert language_id.identified(empty).count() == 0
    untaught = language_id.predict(documents[1].select("doc_id", "text"), {})
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_language_stage_keeps_columns(documents):
    rows, df = documents
    kept = language_id.known_language(df.withColumn("lang_pred", F.lit(1)))
    assert kept.columns == [*df.columns, "lang_pred"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_language_model(documents, empty):
    rows, df = documents
    out = lm_scoring.scored(df, lookup=8).collect()
    counts = Counter()
    for r in rows:
        if not held(r[0], 10, 0):
            counts.update([*tokens(r[1]), ""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        own = [*tokens(r[1]), ""]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        want[(r[0], held(r[0], 10, 0), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.scored(empty).count() == 0


def test_language_model_is_normalised(documents):
    _, df = documents
    counts = lm_scoring.count_words(df)
    look = lm_scoring.build_lookup(counts, 1 << 10)
    first, second, norm = lm_scoring.Model(look).scores()
    total = np.exp(first[3] + second[5] - norm[3, 5]).sum()
    assert abs(total - 1) < 1e-9


def test_packing(documents, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = documents
    odd = [(300, "I'm <|endoftext|>x E\u0301tat a\x1cb ΣΑΣ don't. 12,5 ...,. ﬁn"), (301, "日本語 . , \t é " * 900)]
    all_rows = [(r[0], r[1]) for r in rows] + odd
    out = packing.pack(df.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in all_rows:
        if [r[0] for r in all_rows].count(doc_id) > 1:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    copies = [r for r in out if r.doc_id == 0]
    assert sum(r.length for r in copies) == 3 * copies[0].doc_tokens
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096 and len(filled) <= sum(filled.values()) // 4096 + 1
    assert packing.pack(empty).count() == 0


def test_packing_balances_cost():
    pieces = packing.assign(np.array([2000, 2000, 1000, 1000, 500, 500, 1192]), capacity=4096)
    cost = Counter()
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert len(cost) == 2 and max(cost.values()) < 1.2 * min(cost.values())


def plain_groups(rows, words=4, percent=85):
    sets, nodes = {}, list(range(len(rows)))
    for i, (_, text) in enumerate(rows):
        w = tokens(text)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]) and nodes[i] != nodes[j]:
                old, new = max(nodes[i], nodes[j]), min(nodes[i], nodes[j])
                nodes = [new if x == old else x for x in nodes]
    ids = {}
    for i, x in enumerate(nodes):
        if rows[i][0] is not None:
            ids[x] = min(ids.get(x, rows[i][0]), rows[i][0])
    return Counter((r[0], len(sets[i]), ids.get(nodes[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("common", [3, 24])
def test_ngram_groups(documents, empty, spark, monkeypatch, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    rng = random.Random(common)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(40), [(r[0], r[1]) for r in documents[0]]
    for _ in range(4):
        base = text(rng.choice([30, 120]))
        for _ in range(rng.choice([4, 70])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(copy)))
    for _ in range(40):
        own = text(rng.choice([20, 60]))
        rows.append((1000 + len(rows), " ".join(own[:10] + passage + own[10:])))
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_groups(rows)
    assert ngram_join.linked(empty).count() == 0


def test_first_of_each_group(documents):
    rows, df = documents
    kept = ngram_join.first_of_each(df)
    assert kept.columns == df.columns
    groups = plain_groups([(r[0], r[1]) for r in rows])
    want = {g for _, n, g in groups if n}
    assert Counter(r.doc_id for r in kept.collect() if tokens(r.text)) == Counter(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.choice([0, 1])] = rng.choice([[], ["é"], ["b"]])
    return "".join(letters)


def test_edit_distance(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 8, 70])))
        pairs.append((a, changed(rng, a, rng.choice([0, 1, 2, 3]))))
    a, b = line_dedup.letters(F.col("a")), line_dedup.letters(F.col("b"))
    found = line_dedup.distance_from(line_dedup.band_after(a, b), F.length("a"), F.length("b"))
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", found.alias("d"), line_dedup.shared_prefix(F.col("a"), F.col("b")).alias("p")).collect():
        d = distance(r.a, r.b)
        assert r.d == (d if d <= 2 else None)
        assert r.a[: r.p] == r.b[: r.p] and r.a[r.p : r.p + 1] != r.b[r.p : r.p + 1] or r.p == min(len(r.a), len(r.b))


def plain_dropped(rows):
    seen = []
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: -1 if r[0] is None else r[0]):
        seen += [((doc_id, text), at, line) for at, line in enumerate(text.split("\n")) if len(line) >= 20]
    first = {}
    for i, (_, _, line) in enumerate(seen):
        first.setdefault(line, i)
    out = {}
    for i, (doc, at, line) in enumerate(seen):
        if first[line] != i or any(first[x] < first[line] and abs(len(x) - len(line)) <= 2 and distance(x, line) <= 2 for x in first):
            out.setdefault(doc, []).append(at)
    return out


def line_rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([20, 25, 41]))) for _ in range(15)]
    rows = [(i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.choice([1, 2, 4])))) for i in range(60)]
    return rows + [(500, None), (501, ""), (None, base[0]), (502, base[0] + "\n" + base[0]), (503, "short\nshort"), (503, "short\nshort"), (504, base[1]), (504, base[1])]


def test_line_report(spark, empty):
    rows = line_rows()
    gone = plain_dropped(rows)
    want = Counter((i, 0 if t is None else t.count("\n") + 1, tuple(gone.get((i, t), ()))) for i, t in rows)
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_lines, tuple(r.dropped)) for r in got) == want
    assert all(r.n_dropped == len(r.dropped) for r in got)
    assert line_dedup.report(empty).count() == 0


def test_line_texts(spark):
    rows = line_rows()
    gone = plain_dropped(rows)
    want = Counter()
    for i, t in rows:
        drop = gone.get((i, t), [])
        kept = t if not drop else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in drop)
        if not drop or kept.strip():
            want[(i, kept, None if kept is None else len(kept))] += 1
    df = spark.createDataFrame([(i, t, "x", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, dropped string, n_chars long")
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want
