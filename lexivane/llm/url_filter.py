"""URL rules decided by Bloom filter cascades.

A rule is a host and a path prefix; it fits its host and all subdomains. Of a URL all keys that a rule could have
are formed: every suffix of the host's labels with every path prefix as long as some rule's path. The distinct keys
of the corpus are the universe of a cascade: its first level encodes the listed keys, the second those keys of the
universe that wrongly pass the first, the third the listed keys that wrongly pass the second, and so on until none
is left. Over the universe the answer is then exact, without a join. The allow list and the block list have a
cascade each. A filter's size follows from the length of the list alone and is checked before it is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import stored

MAX_FILTER_BYTES = 64 << 20
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule with a path of one of these lengths could have for the host and path."""
    labels = F.split(host, r"\.")
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    starts = F.filter(starts, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, so that every level has hashes of its own."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    def passes(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.places(one, two).reshape(self.hashes, len(one))
        return ((self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(axis=0)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The bits of the keys with these hashes: all first ones, all second ones and so on."""
        one, two = (scrambled(x.view(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for x in (one, two | 1))
        return np.concatenate([(one + np.uint64(k) * two) % np.uint64(self.size) for k in range(self.hashes)])


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Membership by both hashes of the keys."""
        answer, open_rows = np.zeros(len(one), dtype=bool), np.arange(len(one))
        for at, level in enumerate(self.levels):
            passed = level.passes(one[open_rows], two[open_rows])
            answer[open_rows[~passed]] = at % 2 == 1
            open_rows = open_rows[passed]
        answer[open_rows] = len(self.levels) % 2 == 1
        return answer


def both_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def build_level(keys: DataFrame, count: int, rate: float, seed: int, max_bytes: int) -> Level:
    """A Bloom filter of the ``key`` column; the tasks send its 64-bit words, combined by bit before the shuffle."""
    size = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    if size // 8 > max_bytes:
        raise ValueError(f"a filter of {size // 8} bytes is over the bound of {max_bytes}: split the list")
    hashes = max(1, round(math.log2(1 / rate)))
    empty = Level(np.zeros(size // 64 + 1, dtype=np.uint64), size, hashes, seed)

    def own_words(batches):
        for batch in batches:
            at = np.unique(empty.places(batch["one"].to_numpy(), batch["two"].to_numpy()))
            word, first = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pd.DataFrame({"word": word, "bits": bits.view(np.int64)})

    one, two = both_hashes(F.col("key"))
    parts = keys.select(one.alias("one"), two.alias("two")).mapInPandas(own_words, "word long, bits long")
    words = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    bits = np.zeros(size // 64 + 1, dtype=np.int64)
    for row in words:
        bits[row["word"]] = row["bits"]
    return Level(bits.view(np.uint64), size, hashes, seed)


def contained(keys: DataFrame, cascade: Cascade) -> DataFrame:
    one, two = both_hashes(F.col("key"))
    return keys.where(member(cascade)(F.array(one), F.array(two))[0])


def member(cascade: Cascade):
    """A function of two arrays of hashes that tells for each key whether the cascade contains it."""

    @F.pandas_udf("array<boolean>")
    def test(one: pd.Series, two: pd.Series) -> pd.Series:
        sizes = one.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        flat = cascade.contains(np.concatenate(one.to_list()).astype(np.int64), np.concatenate(two.to_list()).astype(np.int64))
        return pd.Series([x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])])

    return test


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """A cascade that tells the keys of ``listed`` from all other keys of ``universe`` (both: column ``key``)."""
    inside = stored(listed.select("key").where("key is not null").distinct(), "cascade-listed")
    outside = universe.select("key").where("key is not null").distinct().join(inside, "key", "left_anti")
    sides, counts = [inside, stored(outside, "cascade-outside")], [inside.count(), 0]
    counts[1] = sides[1].count()
    levels: list[Level] = []
    while counts[len(levels) % 2] and len(levels) < MAX_LEVELS:
        side = len(levels) % 2
        rate = 0.5 if levels else min(0.5, max(1e-6, counts[0] / max(1, counts[1]) * math.sqrt(0.5)))
        levels.append(build_level(sides[side], counts[side], rate, len(levels), max_bytes))
        sides[1 - side] = stored(contained_by_last(sides[1 - side], levels[-1]), "cascade-passed")
        counts[1 - side] = sides[1 - side].count()
    if counts[len(levels) % 2] and len(levels) == MAX_LEVELS:
        raise ValueError("two different keys share both hashes")
    return Cascade(levels)


def contained_by_last(keys: DataFrame, level: Level) -> DataFrame:
    return contained(keys, Cascade([level]))


def judged(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", id_column: str = "page_id") -> DataFrame:
    """The URL's id, host, path, rule (host and path of the rule that decides, else null) and verdict.

    ``rules``: (host, path, ``allow`` or ``block``). Of the rules that fit, the longest decides; a URL that none
    fits is in no list, so it is allowed. A null URL, and one without ``://``, has an empty host and path and no
    rule. Repeated rows are judged each; other columns are left out.
    """
    lists = {v: [(h + p,) for h, p, verdict in rules if verdict == v] for v in ("allow", "block")}
    if {k for k, in lists["allow"]} & {k for k, in lists["block"]}:
        raise ValueError("a rule is in both lists")
    spark = df.sparkSession
    lengths = sorted({len(path) for _, path, _ in rules})
    parts = df.select(F.col(id_column).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = stored(keyed.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    out = keyed.withColumn("one", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("two", F.transform("keys", lambda k: F.xxhash64(k, F.lit("second"))))
    for verdict, keys in lists.items():
        cascade = build_cascade(spark.createDataFrame(keys, "key string"), universe)
        hit = member(cascade)("one", "two")
        found = F.filter(F.zip_with("keys", hit, lambda k, h: F.when(h, F.struct(F.length(k).alias("n"), k.alias("key")))), lambda x: x.isNotNull())
        out = out.withColumn(verdict, F.array_max(found))
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("block") > F.col("allow")))
    rule = F.when(blocks, F.col("block.key")).otherwise(F.col("allow.key"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))
