"""Language-model scores of texts from a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words (A-Z only) and one end per text. The most frequent words are outputs of the neural
model themselves; every other word belongs to one of a few dozen classes told by its last bytes, and takes its
share of the class by smoothed counts. The model predicts the output of a token from the two before it:

    s(w | u, v) = q_w . (one_u + two_v) + b_w        P(w | u, v) = exp s / sum over all w

Each task trains on the tokens of its own partition, and the parameters are averaged by token counts. Training
contrasts a token with noise drawn by frequency. The sum over all outputs is one matrix product for all pairs of
contexts, so the scores are normalised log-probabilities. Word counts cover all training texts. The most frequent
``LOOKUP`` words are looked up in a broadcast table of that size at most, all others meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import in_part, stored, word_codes

OUTPUTS = 1024
SUFFIXES = 32
CLASSES = 3 * SUFFIXES
SINGLES = OUTPUTS - CLASSES
LOOKUP = 1 << 18
WIDTH = 24
NOISE = 25
STEP = 0.1
TRAIN_BATCH = 2048
FIRST_BLOCK = 1 << 18
END = b""
SMOOTH = 0.1


def word_class(word: bytes) -> int:
    """Class of a word that is no output itself: by its last two bytes and its closing comma or full stop."""
    stem = word.rstrip(b".,")
    mark = 0 if len(stem) == len(word) else 1 if word.endswith(b",") else 2
    return SINGLES + zlib.crc32(stem[-2:]) % SUFFIXES * 3 + mark


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of all tokens: word (empty: the end), class, n."""

    def count(batches):
        found: Counter = Counter()

        def rows():
            out = pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                codes, sizes, words = word_codes(batch.column(0).slice(i, 1000), lower=True)
                for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    if n:
                        found[word] += n
                found[END] += len(sizes)
                if len(found) > 250_000:
                    yield rows()
        if found:
            yield rows()

    def with_class(batches):
        for batch in batches:
            classes = [word_class(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int32()), batch.column(1)], ["word", "class", "n"])

    parts = df.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(with_class, "word binary, class int, n long")


@dataclass
class Lookup:
    """The most frequent words by falling count: position, output, counts; and what the corpus has of each class."""

    place: dict[bytes, int]
    output: np.ndarray
    base: np.ndarray
    within: np.ndarray
    class_total: np.ndarray
    output_n: np.ndarray
    tokens: int
    distinct: int


def build_lookup(counts: DataFrame, size: int = LOOKUP) -> Lookup:
    """Collect at most ``size`` words, all that occur at least as often as a threshold found from a histogram."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 16)
    histogram = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    histogram.sort(key=lambda r: -r["bucket"])
    tokens, distinct = sum(r["tokens"] for r in histogram), sum(r["words"] for r in histogram)
    least, taken = None, 0
    for r in histogram:
        if (taken := taken + r["words"]) > size:
            break
        least = r["bucket"]
    kept = F.col("word") == F.lit(END)
    found = counts.where(kept if least is None else kept | (bucket >= least)).select("word", "class", "n")
    top = list(zip(*found.toArrow().to_pydict().values()))
    top.sort(key=lambda r: (-r[2], r[0]))
    end = next((r for r in top if r[0] == END), (END, SINGLES, 0))
    top = [end, *(r for r in top if r[0] != END)]
    number = np.array([r[2] for r in top], dtype=np.float64)
    output = np.array([r[1] for r in top], dtype=np.int32)
    single = min(SINGLES, len(top))
    total, words = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[r["class"]], words[r["class"]] = r["n"], r["words"]
    np.subtract.at(total, output[:single], number[:single])
    np.subtract.at(words, output[:single], (number[:single] > 0).astype(np.float64))
    output[:single] = np.arange(single)
    class_total = total + SMOOTH * (words + 1)
    within = np.where(np.arange(len(top)) < single, 0.0, np.log10((number + SMOOTH) / class_total[output]))
    output_n = total.copy()
    output_n[:single] = number[:single]
    base = np.log10((number + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))
    return Lookup({r[0]: i for i, r in enumerate(top)}, output, base, within, class_total, output_n, tokens, distinct)


@dataclass
class Tokens:
    """Tokens of some texts in one run, ends included; ``rare``: (text, word number, count) not in the lookup."""

    sizes: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    out: np.ndarray
    one: np.ndarray
    two: np.ndarray
    words: list[bytes]
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]


def tokens_of(texts: pa.Array, look: Lookup) -> Tokens:
    codes, sizes, words = word_codes(texts, lower=True)
    place = np.fromiter(map(look.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    place = np.append(place, 0)
    output = np.where(place >= 0, look.output[place], 0)
    for w in np.flatnonzero(place < 0).tolist():
        output[w] = word_class(words[w])
    closed = np.insert(codes.astype(np.int64), np.cumsum(sizes), len(words))
    sizes = sizes + 1
    starts = np.cumsum(sizes) - sizes
    at, out = place[closed], output[closed].astype(np.int32)
    one, two = np.zeros_like(out), np.zeros_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[starts] = 0
    two[starts] = 0
    two[starts[sizes > 1] + 1] = 0
    missing = np.flatnonzero(at < 0)
    text_of = np.searchsorted(starts, missing, side="right") - 1
    pairs, n = np.unique((text_of << 32) | closed[missing], return_counts=True)
    return Tokens(sizes, starts, at, out, one, two, words, (pairs >> 32, pairs & 0xFFFFFFFF, n))


class Model:
    """Parameters: context vectors ``one`` and ``two``, output vectors ``q``, output biases ``b``."""

    def __init__(self, look: Lookup):
        rng = np.random.default_rng(7)
        share = (look.output_n + 0.5) / (look.output_n.sum() + 0.5 * OUTPUTS)
        self.noise = share / share.sum()
        self.one, self.two, self.q = (rng.normal(0, 0.1, (OUTPUTS, WIDTH)).astype(np.float32) for _ in range(3))
        self.b = np.log(self.noise).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.one.ravel(), self.two.ravel(), self.q.ravel(), self.b])

    def set(self, vector: np.ndarray) -> None:
        parts = np.split(vector.astype(np.float32), [OUTPUTS * WIDTH, 2 * OUTPUTS * WIDTH, 3 * OUTPUTS * WIDTH])
        self.one, self.two, self.q = (p.reshape(OUTPUTS, WIDTH) for p in parts[:3])
        self.b = parts[3]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of both contexts in every output's score, bias added, and log of the sum over outputs by contexts."""
        q = self.q.astype(np.float64)
        first, second = self.one.astype(np.float64) @ q.T + self.b, self.two.astype(np.float64) @ q.T
        high, more = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        norm = np.log(np.exp(first - high) @ np.exp(second - more).T) + high + more.T
        return first, second, norm


class Trainer:
    """Noise-contrastive steps with per-parameter step sizes."""

    def __init__(self, model: Model, seed: int):
        self.m = model
        self.rng = np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)
        self.edges = np.cumsum(model.noise)
        self.seen = [np.full_like(p, 1e-2) for p in (model.one, model.two, model.q, model.b)]

    @staticmethod
    def _gather(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        index = (rows[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH)).ravel()
        return np.bincount(index, values.ravel(), OUTPUTS * WIDTH).reshape(OUTPUTS, WIDTH).astype(np.float32)

    def step(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(out)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), OUTPUTS - 1)
        context = m.one[one] + m.two[two]
        q = m.q[out]
        real = np.einsum("ij,ij->i", context, q) + m.b[out] - self.log_noise[out]
        false = context @ m.q[noise].T + (m.b[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        change = up[:, None] * q + down @ m.q[noise]
        by_output = self._gather(out, up[:, None] * context)
        np.add.at(by_output, noise, down.T @ context)
        bias = np.bincount(out, up, OUTPUTS)
        np.add.at(bias, noise, down.sum(axis=0))
        changes = (self._gather(one, change), self._gather(two, change), by_output, bias.astype(np.float32))
        for value, seen, g in zip((m.one, m.two, m.q, m.b), self.seen, changes):
            g /= n ** 0.5
            seen += g * g
            value += STEP * g / np.sqrt(seen)

    def block(self, out, one, two) -> None:
        for i in range(0, len(out), TRAIN_BATCH):
            self.step(out[i : i + TRAIN_BATCH], one[i : i + TRAIN_BATCH], two[i : i + TRAIN_BATCH])


def fit(df: DataFrame, look: Lookup, text: str = "text") -> Model:
    """Train on all texts: every task on its partition, then the mean of the parameters by tokens.

    A task goes four times over its first block of tokens and once over the rest.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(look)

    def train(batches):
        own = Model(shared.value)
        task = TaskContext.get().partitionId()
        trainer, tokens = Trainer(own, task), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                t = tokens_of(batch.column(0).slice(i, 1000), shared.value)
                for _ in range(4 if tokens < FIRST_BLOCK else 1):
                    trainer.block(t.out, t.one, t.two)
                tokens += int(t.sizes.sum())
        if tokens:
            yield pa.record_batch([pa.array([task], pa.int64()), pa.array([float(tokens)]), pa.array([(own.vector().astype(np.float64) * tokens).tobytes()], pa.binary())], ["task", "tokens", "total"])

    def added(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("task", kind="stable")
        total = sum(np.frombuffer(x) for x in own["total"])
        return pd.DataFrame({"task": own["task"].iloc[:1], "tokens": [own["tokens"].sum()], "total": [total.tobytes()]})

    slim = df.select(F.col(text).alias("text"))
    parts = slim.mapInArrow(train, "task long, tokens double, total binary")
    lots = max(1, int(slim.rdd.getNumPartitions() ** 0.5))
    level = parts.groupBy((F.col("task") % lots).alias("lot")).applyInPandas(added, parts.schema)
    found = level.groupBy(F.lit(0).alias("lot")).applyInPandas(added, parts.schema).collect()
    model = Model(look)
    if found:
        model.set(np.frombuffer(found[0]["total"]) / found[0]["tokens"])
    shared.unpersist()
    return model


def score(df: DataFrame, counts: DataFrame, look: Lookup, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score (both log10). Repeated rows are scored one by one."""
    spark = df.sparkSession
    first, second, norm = model.scores()
    tables = [x.astype(np.float32) / np.float32(np.log(10)) for x in (first, second, norm)]
    shared = spark.sparkContext.broadcast((look, tables))

    def part_scores(batches):
        own, (first, second, norm) = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                t = tokens_of(piece.column(1), own)
                known = t.at >= 0
                base = np.where(known, own.base[t.at], 0.0)
                values = np.where(known, own.within[t.at], 0.0) + (first[t.one, t.out].astype(np.float64) + second[t.two, t.out] - norm[t.one, t.two])
                text_of, word, times = t.rare
                ends = np.searchsorted(text_of, np.arange(len(t.sizes) + 1)).astype(np.int32)
                names = [t.words[w] for w in word.tolist()]
                rare = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array([word_class(w) for w in names], pa.int32()), pa.array(times.astype(np.int64))], ["word", "class", "n"])
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(range(row, row + len(t.sizes)), pa.int64()), pa.array(t.sizes), pa.array(np.add.reduceat(known.astype(np.int64), t.starts)),
                    pa.array(np.add.reduceat(base, t.starts)), pa.array(np.add.reduceat(values, t.starts)), pa.ListArray.from_arrays(pa.array(ends), rare),
                ], ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rare"])
                row += len(t.sizes)

    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string("row long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,class:int,n:long>>").fields])
    parts = stored(slim.mapInArrow(part_scores, schema), "lm-parts")
    every = F.lit(float(look.tokens + SMOOTH * (look.distinct + 1)))
    totals = F.element_at(F.lit(look.class_total.tolist()), F.col("class") + 1)
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.class", F.col("r.n").alias("times"))
    met = rare.join(counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") / every)).alias("more_base"), F.sum(F.col("times") * F.log10(F.col("c") / totals)).alias("more_score"),
    )
    return parts.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def scored(df: DataFrame, parts: int = 10, held: int = 0, lookup: int = LOOKUP) -> DataFrame:
    """Learn from the documents outside the held-out part and score all documents.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text counts as empty: its only
    token is the end. With nothing to learn from, all outputs are equally likely and base_score is 0 for every token.
    """
    slim = df.select("doc_id", "text")
    learned = slim.where(~in_part("doc_id", parts, held))
    counts = stored(count_words(learned), "lm-counts")
    look = build_lookup(counts, lookup)
    out = score(slim, counts, look, fit(learned, look))
    return out.select("doc_id", in_part("doc_id", parts, held).alias("held_out"), "n_tokens", "n_known", F.lit(look.tokens).cast("long").alias("train_tokens"), "base_score", "score")
