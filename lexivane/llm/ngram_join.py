"""Jaccard self-join of documents on word n-grams with prefix trees.

A document's set holds the 64-bit hashes of its distinct n-grams, in the global order of the hash values. Equal
sets are one node. Two sets that are similar enough differ in few elements, so of the smallest part of each
(its zone) they share a known number at least. Candidate pairs come from shared zone elements:

* Elements held by at most ``COMMON`` nodes are joined pair by pair; pairs with too few of them are dropped.
* A pair can only be missed if common elements make up much of both zones. Such nodes are compared by their
  whole sets, the elements that few of them hold first: similar sets share one of their first elements. What is
  common almost throughout belongs to large groups of near copies. It is first compared with the purest node of
  its elements and then, across the components found, with each other.

Candidates of a node are verified together: their sorted sets form a prefix tree, whose branches are walked with
partial overlaps shared and cut where the remaining lengths cannot reach the threshold any more. Groups with
thousands of near copies therefore need about one comparison per member, and no pair of different texts is lost.

Sets are 64-bit fingerprints: two different n-grams, or sets, fall together with a chance of about 1e-19 a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexivane.llm.common import give_back, stored, word_codes
from lexivane.llm.components import components

WORDS = 4
PERCENT = 85
COMMON = 24
LEADERS = 4
CHUNK = 256
BUCKET_ROWS = 2000
BITMAP_BITS = 1 << 23
BATCH_BYTES = 4 * 1024 * 1024
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with fewer words is one n-gram, one without words has none."""
    codes, sizes, distinct = word_codes(texts, lower=True)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[codes]
    total = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        total += hashes[k : k + len(total)] * FACTORS[k % len(FACTORS)] + np.uint64(k)
    total = mixed(total).view(np.int64)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(total[at : at + n - words + 1]))
        elif n:
            short = np.uint64(n)
            for k in range(n):
                short = mixed(np.array([short ^ hashes[at + k]]))[0]
            out.append(np.array([short]).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
        at += n
    return out


def node_of(grams: np.ndarray) -> int:
    """Fingerprint of a set."""
    total = mixed(grams.view(np.uint64) ^ FACTORS[0]).sum(keepdims=True) + np.array([len(grams)], dtype=np.uint64) * FACTORS[1]
    return int(mixed(total).view(np.int64)[0])


def zone_size(n: int, percent: int) -> int:
    """A tenth more than what a similar set may lack."""
    return min(n, n * (110 - percent) // 100 + 1)


def zones(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """doc_id, print (hash of the text), node (null for an empty set), n, zone."""

    def build(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sets = gram_sets(part.column(2), words)
                cut = [s[: zone_size(len(s), percent)] for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cut))),
                ], ["doc_id", "print", "node", "n", "zone"])
        give_back()

    slim = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return slim.mapInArrow(build, T.StructType([slim.schema["doc_id"], *T._parse_datatype_string("print long, node long, n long, zone array<long>").fields]))


def whole_sets(df: DataFrame, marked: DataFrame, needed: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(node, grams) of the needed nodes, from one document of each.

    A bitmap of fixed size over the hashes of those documents' ids tells most other texts apart before they are
    looked at; with very many of them it lets more texts pass, and never keeps one of them out.
    """
    holders = marked.join(needed.distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    places = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
    bits = holders.select(places("doc_id").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    words_set = bits.toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    bitmap[words_set["word"].to_numpy()] = words_set["bits"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def build(batches):
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64)
            on = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            rows = batch.filter(pa.array(on))
            for i in range(0, rows.num_rows, 1000):
                sets = [s for s in gram_sets(rows.column(1).slice(i, 1000), words) if len(s)]
                yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.astype(">i8").tobytes() for s in sets], pa.binary())], ["node", "grams"])

    found = df.select(places(doc_id).alias("at"), F.col(text).alias("text")).mapInArrow(build, "node long, grams binary")
    return found.join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"])


def each_gram(sets: DataFrame) -> DataFrame:
    """(node, n, token) of all elements of the sets."""

    def unpack(batches):
        for batch in batches:
            sets = [np.frombuffer(x, dtype=">i8").astype(np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            if len(sets):
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], ["node", "n", "token"])

    return sets.select("node", "grams").mapInArrow(unpack, "node long, n long, token long")


class PrefixTree:
    """Sorted sets in lexical order, so that those with a common beginning stand together.

    A branch of the tree is a range of sets and a depth up to which they agree.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.lengths = [len(s) for s in self.sets]
        self.shared = [0] * len(sets)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = int(differ[0]) if len(differ) else m

    def similar(self, anchor: np.ndarray, percent: int = PERCENT, wanted: list[bool] | None = None) -> list[int]:
        """Which of the (wanted) sets are similar to ``anchor``, by their first numbers, in one walk.

        The overlap with the anchor up to a depth is counted once for the whole branch. A branch is left when even
        its longest set, or what remains of the anchor, cannot reach the threshold, or nothing in it is wanted.
        """
        if not self.sets or not len(anchor):
            return []
        needed = [-(-percent * (len(anchor) + n) // (100 + percent)) for n in self.lengths]
        if wanted is not None:
            needed = [n if wanted[i] else 1 << 62 for n, i in zip(needed, self.order)]
        found: list[int] = []
        branches = [(0, len(self.sets), 0, 0)]
        while branches:
            lo, hi, depth, overlap = branches.pop()
            to = min(self.shared[lo + 1 : hi], default=self.lengths[lo])
            own = self.sets[lo][depth:to]
            if len(own):
                place = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
                overlap += int((anchor[place] == own).sum())
            rest = len(anchor) - (int(np.searchsorted(anchor, self.sets[lo][to - 1], side="right")) if to else 0)
            if not any(overlap + min(rest, self.lengths[i] - to) >= needed[i] for i in range(lo, hi)):
                continue
            if hi - lo == 1:
                if overlap >= needed[lo]:
                    found.append(self.order[lo])
                continue
            start = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or self.shared[i] == to:
                    branches.append((start, i, to, overlap))
                    start = i
        return sorted(found)


def join_across(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets (node, part, grams) of different parts; a link joins their parts for what follows.

    Without ``right`` the sets of ``left`` are compared with each other.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    others = left if right is None else right
    tree, found = PrefixTree([grams for _, _, grams in others]), []
    for at, (node, part, grams) in enumerate(left):
        mine = top(part)
        wanted = [top(p) != mine for _, p, _ in others]
        if right is None:
            wanted[: at + 1] = [False] * (at + 1)
        if any(wanted):
            for i in tree.similar(grams, percent, wanted):
                found.append((node, others[i][0]))
                up[top(others[i][1])] = top(part)
    return found


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (anchor, other) whose sets are similar. A chunk of an anchor's partners is one prefix tree."""
    count = pairs.count()
    buckets = max(1, math.ceil(count / BUCKET_ROWS))
    counts = pairs.groupBy("anchor").agg(F.count("*").alias("partners"))
    dealt = pairs.join(counts, "anchor").withColumn("chunk", F.pmod(F.xxhash64("other"), F.ceil(F.col("partners") / CHUNK)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("anchor", "chunk"), F.lit(buckets))).select("bucket", "anchor", "chunk", "other")
    anchors = dealt.select("bucket", "anchor", "chunk", F.col("anchor").alias("other")).distinct()
    rows = dealt.unionByName(anchors).join(sets.select(F.col("node").alias("other"), "grams"), "other")

    def check(own: pd.DataFrame) -> pd.DataFrame:
        left, right = [], []
        for (anchor, _), part in own.groupby(["anchor", "chunk"], sort=False):
            grams = {n: np.frombuffer(g, dtype=">i8").astype(np.int64) for n, g in zip(part["other"], part["grams"])}
            mine = grams.pop(anchor)
            names = list(grams)
            hits = PrefixTree([grams[n] for n in names]).similar(mine, percent)
            left += [anchor] * len(hits)
            right += [names[i] for i in hits]
        return pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

    return rows.groupBy("bucket").applyInPandas(check, "a long, b long")


def linked(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * common n-grams >= percent * all n-grams of both. Equal sets always link. A
    null text, or one without words, has no n-grams and links with nothing; repeated rows link like any copies.
    A null doc_id stands in no component_id unless all of the component are null.
    """
    if not 80 <= percent <= 100:
        raise ValueError("zones are cut for similarities of 80 % and more")
    marked, by_node = grouped(df, doc_id, text, words, percent)
    out = marked.select("doc_id", "node", "n").join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def grouped(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their nodes, and (node, first): the smallest doc_id, with its print, of the node's component."""
    if not 80 <= percent <= 100:
        raise ValueError("zones are cut for similarities of 80 % and more")
    marked = stored(zones(df, doc_id, text, words, percent), "ngram-zones", BATCH_BYTES)
    found = components(links(df, marked, doc_id, text, words, percent)).select("node", "component")
    # null ids come last
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    named = marked.where("node is not null").groupBy("node").agg(F.min(place).alias("first")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    return marked, stored(named.select("node", "component").join(least, "component").select("node", "first"), "ngram-groups")


def first_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Columns stay as they are.

    Documents without words stay. Rows that agree in doc_id and text count as one document, of which one stays.
    """
    marked, by_node = grouped(df, doc_id, text, words, percent)
    here = marked.select("doc_id", "print", "node").join(by_node, "node", "left")
    stay = here.where(F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))))
    stay = stored(stay.groupBy(F.col("doc_id").alias("__doc"), F.col("print").alias("__print")).agg(F.count("*").alias("__rows")), "ngram-stay")
    kept = df.withColumn("__text", F.xxhash64(text)).join(stay, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__print")), "left_semi")
    repeated = stay.where("__rows > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([doc_id, text])).drop("__text")


def links(df: DataFrame, marked: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes, enough to connect every component."""
    miss = 100 - percent
    # of n elements a similar set lacks at most floor(miss * n / 100), so of a zone it holds at least:
    need = F.expr(f"least(n, ({110 - percent} * n) div 100 + 1) - ({miss} * n) div 100")
    by_token = Window.partitionBy("token")
    each = marked.where("node is not null").select("node", "n", F.explode("zone").alias("token"))
    shared = each.select("token", "node", "n", F.count("*").over(by_token).alias("held"), F.min("node").over(by_token).alias("lo"), F.max("node").over(by_token).alias("hi"))
    rows = stored(shared.where("lo <> hi").select("token", "node", "n", (F.col("held") > COMMON).alias("common")).distinct(), "ngram-shared")

    nodes = stored(rows.groupBy("node").agg(F.max("n").alias("n"), F.sum(F.col("common").cast("int")).alias("commons")).withColumn("need", need), "ngram-nodes")
    sides = {s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("commons").alias(f"commons_{s}"), F.col("need").alias(f"need_{s}")) for s in ("a", "b")}
    least_need = F.least("need_a", "need_b")
    ratio = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def joined(left: DataFrame, right: DataFrame, on) -> DataFrame:
        l = left.select(F.col("token"), F.col("node").alias("a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in on])
        r = right.select(F.col("token"), F.col("node").alias("b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in on])
        return l.join(r, "token").where(ratio)

    rare = rows.where(~F.col("common"))
    counted = stored(joined(rare, rare, []).where("a < b").groupBy("a", "b").agg(F.count("*").alias("met")), "ngram-counted")
    enough = counted.join(sides["a"], "a").join(sides["b"], "b").where(F.col("met") + F.least("commons_a", "commons_b") >= least_need)

    pairs = enough.select(F.col("a").alias("anchor"), F.col("b").alias("other"))
    # zones of which so much is common that a pair could have been missed
    crowded = stored(nodes.where(f"1000 * commons >= {percent} * n").select("node"), "ngram-crowded")
    sets = stored(whole_sets(df, marked, pairs.select(F.col("anchor").alias("node")).union(pairs.select("other")).union(crowded), doc_id, text, words), "ngram-sets", BATCH_BYTES)
    if crowded.isEmpty():
        return verified(stored(pairs, "ngram-pairs"), sets, percent)

    # their whole sets, elements that few of them hold first: similar sets share one of their first elements
    full = each_gram(sets.join(crowded, "node", "left_semi"))
    full = full.select("node", "n", "token", (F.count("*").over(by_token) > COMMON).alias("common"))
    by_node = Window.partitionBy("node")
    ranked = full.select("*", F.row_number().over(by_node.orderBy("common", "token")).alias("rank"), F.sum(F.col("common").cast("int")).over(by_node).alias("commons"))
    prefix = stored(ranked.where(f"rank <= ({miss} * n) div 100 + 1"), "ngram-prefixes")
    few = prefix.where("not common")
    beside = joined(few, few, []).where("a < b").select(F.col("a").alias("anchor"), F.col("b").alias("other")).distinct()
    # sets that are common but for a rest: near copies in large groups
    packed = prefix.where("common")
    leaders = packed.groupBy("token").agg(F.max(F.struct((F.col("commons") / F.col("n")).alias("share"), "node"))["node"].alias("leader"))
    first = F.row_number().over(by_node.orderBy("token"))
    to_leader = packed.withColumn("first", first).where(F.col("first") <= LEADERS).join(leaders, "token").where("node <> leader")
    every = stored(pairs.unionByName(beside).unionByName(to_leader.select(F.col("leader").alias("anchor"), F.col("node").alias("other"))).distinct(), "ngram-pairs")
    edges = stored(verified(every, sets, percent), "ngram-links")

    # nodes that packed elements tie together are compared in blocks, each with those of other components only
    ties = packed.join(packed.groupBy("token").agg(F.min("node").alias("least")), "token").where("node <> least").select("node", "least").distinct()
    places = components(ties, "node", "least").withColumnRenamed("component", "crowd").join(components(edges), "node", "left").select("node", "crowd", F.coalesce("component", "node").alias("part"))
    places = stored(places, "ngram-places")
    crowds = places.groupBy("crowd").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / CHUNK).alias("blocks")).where("lo <> hi").select("crowd", "blocks")
    placed = places.join(crowds, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = placed.select("crowd", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "part", "node").join(sets, "node")

    def compare(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        rows = [(b, n, p, np.frombuffer(g, dtype=">i8").astype(np.int64)) for b, n, p, g in zip(own["block"], own["node"], own["part"], own["grams"])]
        sides = [[r[1:] for r in rows if r[0] == b] for b in key[1:]]
        return pd.DataFrame(join_across(sides[0], None if key[1] == key[2] else sides[1], percent), columns=["a", "b"])

    return edges.unionByName(tasks.groupBy("crowd", "lo", "hi").applyInPandas(compare, "a long, b long"))
