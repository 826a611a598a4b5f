"""Repeated lines of any length."""

import random

from pyspark.sql import functions as F

from lexivane.llm import line_dedup, registry


def registered(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return {r.doc_id: r.dropped for r in registry.op3_line_dedup(spark, str(tmp_path)).collect()}


def test_short_repeats_go(spark, tmp_path):
    rows = [(1, "Ietzte.\n\nIetzte.\n  \nother"), (2, "\n  \nIetzte.\nIetzte"), (3, None)]
    assert registered(spark, tmp_path, rows) == {1: [2], 2: [2], 3: []}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(df, short_repeats=True).collect()}
    assert kept == {1: "Ietzte.\n\n  \nother", 2: "\n  \nIetzte", 3: None}


def words_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_changed_words(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 6, 8]))) for _ in range(400)]
    lines = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([9, 10, 11, 12, 17, 20, 35, 60, 72, 75, 100]))]
        lines.append(base)
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 3, 7])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
            lines.append(copy)
    rng.shuffle(lines)
    want = {}
    for i, x in enumerate(lines):
        near = any(words_distance(x, y) <= max(len(x), len(y)) // 10 for y in lines[:i] if abs(len(x) - len(y)) <= 10)
        want[i] = [0] if near or any(" ".join(y) == " ".join(x) for y in lines[:i]) else []
    assert 20 < sum(map(bool, want.values())) < len(lines) - 20
    assert registered(spark, tmp_path, [(i, " ".join(x)) for i, x in enumerate(lines)]) == want


def test_crowds_make_no_more_rows_than_keys(spark, tmp_path, monkeypatch):
    """a crowd of near copies is compared without a row for each pair, and later copies go although its first line is near to none of some."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 6, 8]))) for _ in range(600)]
    lines = []
    for size, own, first_own in ((40, 1, 1), (40, 2, 5), (31, 2, 4)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for i in range(60):
            copy = list(base)
            for at in rng.sample(range(size), first_own if i < 3 else own):
                copy[at] = rng.choice(vocabulary)
            lines.append(copy)
    want = {}
    for i, x in enumerate(lines):
        want[i] = [0] if any(words_distance(x, y) <= max(len(x), len(y)) // 10 for y in lines[:i]) else []
    counts = {}
    write = line_dedup.stored

    def counted(df, label):
        out = write(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    assert registered(spark, tmp_path, [(i, " ".join(x)) for i, x in enumerate(lines)]) == want
    by_words = {k: n for k, n in counts.items() if k.startswith("lines-word-")}
    assert max(by_words.values()) <= counts["lines-met"] and by_words["lines-word-near"] <= len(lines)
    assert by_words["lines-word-pairs"] < len(lines) * 10


def test_long_and_repeating_lines_keep_their_run_keys(spark):
    """places inside the longs of runs: a line of one word repeated, and one with a word changed every ten, meet by their keys."""
    rng = random.Random(3)
    base = [rng.randrange(-(2**63), 2**63) for _ in range(1500)]
    near = [rng.randrange(2**63) if i % 10 == 9 else x for i, x in enumerate(base)]
    rows = [(0, base), (1, near), (2, [7] * 50), (3, [7] * 48)]
    keys = {r.i: set(r.word_keys) for r in line_dedup.with_word_keys(spark.createDataFrame(rows, "i int, words array<bigint>")).collect()}
    assert keys[0] & keys[1] and keys[2] & keys[3] and not keys[0] & keys[2]
    assert all(x % (1 << line_dedup.PLACE_BITS) == 0 for x in keys[0])


def test_runs_that_begin_alike(spark, tmp_path):
    """runs are picked by their first words; lines of few different words have many runs that begin alike."""
    rng = random.Random(11)
    lines = []
    for _ in range(25):
        base = [rng.choice(["abcdef", "ghijkl", "mnopqr"]) for _ in range(rng.choice([36, 41, 60, 90]))]
        lines.append(base)
        for changes in (1, 3, 6):
            copy = list(base)
            for _ in range(changes):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = rng.choice([[], ["stuvwx"], ["abcdef"]])
            lines.append(copy)
    rng.shuffle(lines)
    want = {}
    for i, x in enumerate(lines):
        want[i] = [0] if any(words_distance(x, y) <= max(len(x), len(y)) // 10 for y in lines[:i] if abs(len(x) - len(y)) <= 10) else []
    assert 20 < sum(map(bool, want.values())) < len(lines) - 20
    assert registered(spark, tmp_path, [(i, " ".join(x)) for i, x in enumerate(lines)]) == want


def test_words_between_any_white_space(spark):
    """words are split at single spaces; other white space, and several spaces, still part words as ``\\s+`` does."""
    lines = ["a b c", "  a  b ", "\ta\x0bb\r", "a \f b\n c", "one", "", " \t ", "a b   c", "a\x1cb"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", line_dedup.words_of(F.col("line")).alias("words"), F.expr(r"filter(split(line, '\\s+'), w -> w <> '')").alias("want"))
    for r in got.collect():
        assert r.words == (r.want or [""])


def test_runs_meet_by_number_of_words(spark):
    """a run of words meets only among lines whose numbers of words their edits allow for; letters meet as before."""
    rows = [(1, 20, [], [5]), (2, 23, [], [5]), (3, 30, [], [6]), (4, 33, [], [6]), (5, 90, [], [6]), (6, 9, [70, 71, 72, 73], []), (7, 9, [80, 81, 82, 70], [])]
    keyed = spark.createDataFrame(rows, "h long, n int, keys array<bigint>, word_keys array<bigint>")
    met = {tuple(r) for r in line_dedup.met_keys(keyed, 2).collect()}
    assert met == {(3, 6, 30), (4, 6, 33), (6, 70, 1), (7, 70, 0)}


def test_lines_and_keys_are_read_once(spark, tmp_path, monkeypatch):
    """distinct lines are kept with their text, so whole texts are not joined for the lines that meet; keys of runs of words are not kept."""
    tables = {}
    write = line_dedup.stored

    def noted(df, label):
        tables[label] = df.columns
        return write(df, label)

    monkeypatch.setattr(line_dedup, "stored", noted)
    text = " ".join(f"word{k}" for k in range(30))
    assert registered(spark, tmp_path, [(1, text), (2, text.replace("word7 ", "")), (3, text)]) == {1: [], 2: [0], 3: [0]}
    assert tables["lines-distinct"] == ["h", "h2", "first", "times", "line"] and tables["lines-met"] == ["h", "key", "kind"]
