"""Language identification with hyperdimensional profiles.

Every letter owns a random +1/-1 vector. A letter trigram is the product of its three letter vectors, the
first rotated by two places and the second by one (binding). A text is the sum of its trigram vectors
(bundling), a language prototype the sum of the texts labelled with it. A text gets the language whose
prototype, seen from the mean of all prototypes, has the largest cosine with it.

All sums are sums of whole numbers, so neither the partitioning nor a repeated task changes a prototype.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import give_back, in_part

DIMENSIONS = 512
UNKNOWN = "und"
SLOTS = 64
SEED = 20240517
GROUP_POSITIONS = 1 << 19


@lru_cache(maxsize=1)
def letter_slots() -> np.ndarray:
    """Slot of every code point: 0 for what is no letter, 1-26 for a-z, else 27-63 by the code point."""
    slots = np.zeros(0x110000, dtype=np.uint8)
    letters = np.fromiter((c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()), dtype=np.int64)
    slots[letters] = 27 + (letters * 40503 >> 3) % (SLOTS - 27)
    slots[97:123] = np.arange(1, 27)
    return slots


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter vectors, rotated by two, one and no places."""
    plain = np.random.default_rng(SEED).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and how often each occurs; none without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    slots = letter_slots()[points]
    padded = np.zeros(len(slots) + 2, dtype=np.uint32)
    padded[1:-1] = slots
    padded = padded[np.concatenate(([True], (padded[1:] | padded[:-1]) != 0))]
    if len(padded) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.unique((padded[:-2] << 12) | (padded[1:-1] << 6) | padded[2:], return_counts=True)


def text_vectors(texts: list[str | None], dimensions: int):
    """Yield (first text, matrix of text vectors) for runs of texts that fit in memory together."""
    first, found, positions = 0, [], 0
    for at, text in enumerate(texts):
        found.append(trigrams(text))
        positions += len(found[-1][0])
        if positions >= GROUP_POSITIONS or at == len(texts) - 1 or len(found) == 256:
            yield first, _bundle(found, dimensions)
            first, found, positions = at + 1, [], 0


def _bundle(found: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    codes = np.unique(np.concatenate([c for c, _ in found]))
    if not len(codes):
        return np.zeros((len(found), dimensions))
    two, one, plain = letter_vectors(dimensions)
    bound = two[codes >> 12] * one[(codes >> 6) & 63] * plain[codes & 63]
    exact = np.float32 if max(n.sum() for _, n in found) < 1 << 24 else np.float64
    counts = np.zeros((len(found), len(codes)), dtype=exact)
    for row, (own, n) in enumerate(found):
        counts[row, np.searchsorted(codes, own)] = n
    return (counts @ bound.astype(exact)).astype(np.float64)


def train(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language, learned from every row whose text and language are not null.

    Each task sends one row of sums per language; the result has one vector per language name.
    """

    def sums(batches):
        totals: dict[str, np.ndarray] = {}

        def rows():
            out = pa.record_batch([pa.array(list(totals)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.int64()))], ["lang", "total"])
            totals.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                texts, names = (batch.column(k).slice(i, 1000).to_pylist() for k in (0, 1))
                for first, vectors in text_vectors(texts, dimensions):
                    own = names[first : first + len(vectors)]
                    for name in set(own):
                        part = vectors[[x == name for x in own]].sum(axis=0).astype(np.int64)
                        totals[name] = totals.get(name, 0) + part
                if len(totals) > 4096:
                    yield rows()
        if totals:
            yield rows()
        give_back()

    known = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = known.mapInArrow(sums, "lang string, total array<long>")
    rows = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("total")).collect()
    found: dict[str, np.ndarray] = {}
    for row in rows:
        found.setdefault(row["lang"], np.zeros(dimensions, dtype=np.int64))[row["pos"]] = row["total"]
    return dict(sorted(found.items()))


def directions(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Unit vectors from the mean prototype to each prototype (the prototype itself, if it is the only one)."""
    names = [name for name, v in prototypes.items() if np.any(v)]
    if not names:
        return [], np.zeros((0, 1))
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n].astype(np.float64)) for n in names])
    seen = unit - unit.mean(axis=0) if len(names) > 1 else unit
    length = np.linalg.norm(seen, axis=1, keepdims=True)
    return names, np.where(length > 1e-12, seen / np.maximum(length, 1e-12), unit)


def decide(texts: list[str | None], names: list[str], seen: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of every text; ties go to the name that sorts first."""
    langs, scores = [], []
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    for _, vectors in text_vectors(texts, seen.shape[1]):
        length = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ seen.T) / np.maximum(length, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        for row, at in enumerate(best):
            known = length[row] > 0
            langs.append(names[at] if known else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, cosine[row, at]))) if known else 0.0)
    return langs, scores


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and the cosine, cut to 0..1.

    A null text, and one without letters, gets ``und`` and score 0; so does every text when nothing was learned.
    Rows stay as they are otherwise, copies included. Columns named like the two new ones are replaced.
    """
    names, seen = directions(prototypes)
    kept = df.drop(lang_pred, score)
    at = kept.columns.index(text)

    def label(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                langs, scores = decide(batch.column(at).to_pylist(), names, seen)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_pred, score])
        give_back()

    from pyspark.sql import types as T

    return kept.mapInArrow(label, T.StructType([*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def identified(df: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out part and predict all: doc_id, held_out, lang_pred, score."""
    slim = df.select("doc_id", "text")
    prototypes = train(df.where(~in_part("doc_id", parts, held)))
    out = predict(slim, prototypes)
    return out.select("doc_id", in_part("doc_id", parts, held).alias("held_out"), "lang_pred", "score")


def known_language(df: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """The documents whose language can be told; those without any letter go. Columns stay.

    Where no language was learned, all documents with a letter stay.
    """
    prototypes = train(df.where(~in_part("doc_id", parts, held)))
    columns = df.columns
    if not directions(prototypes)[0]:
        return df.where(F.col("text").rlike(r"\p{L}"))
    return predict(df, prototypes, lang_pred="__lang", score="__score").where(F.col("__lang") != UNKNOWN).select(*columns)
