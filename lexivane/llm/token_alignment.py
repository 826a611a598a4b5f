"""Alignment of two tokenizers over the same texts, in Arrow tables inside tasks and Spark sums between them.

A slice of texts is encoded by both. Token lists are flattened with their parents' numbers, token lengths become ends
by sums segmented by document, and a hash join of both sides on document and end finds the ends that they share. These
cut a document into groups, the smallest stretches that both tokenizers cover with whole tokens. Inside a
group, every token of one side is linked with every token of the other: again a hash join, on the group, whose rows are
summed per document and pair of ids. Where a group holds very many tokens, repeats of an id in it are counted first, so
the join grows with the distinct ids of a group.

How many documents hold a pair is counted by each task for its documents (``Table.group_by``) and summed by Spark.
Counts come back to the documents in two ways: the most frequent pairs, ``COMMON_PAIRS`` at most, are sent to all tasks,
and what remains, pairs that few documents hold, is joined by pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import byte_slices, give_back, stored

COMMON_PAIRS = 1 << 20
SLICE_BYTES = 1024 * 1024
PARTIAL_PAIRS = 4_000_000
#: Groups with more links than this have the repeats of their ids counted before the join.
PLAIN_LINKS = 256
SIDE = 1 << 20  # a pair is the first id times SIDE plus the second id

SUMS = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """Both encoders, the bytes of their tokens, and the decimal ids with the marks that may follow them."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(public_tokenizers.path(byte_vocabulary))
        self.plain.encode_special_tokens = True
        names = self.plain.get_vocab(with_added_tokens=False)
        unprinted = self._unprinted()
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, at in names.items():
            if all(c in unprinted for c in name):  # names of special tokens may not be byte-level
                a_bytes[at] = bytes(unprinted[c] for c in name)
        special = {x.content for x in self.plain.get_added_tokens_decoder().values()}
        ranks = {a_bytes[at]: at for name, at in names.items() if name not in special}
        # the same vocabulary and splitting rule in a faster encoder
        self.fast = tiktoken.Encoding("lexivane", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_vocabulary))
        b_bytes = [self._piece_bytes(at) for at in range(self.pieces.get_piece_size())]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes))
        marks = (b",", b"|", b",", b";")
        spans = (len(a_bytes), len(a_bytes), len(b_bytes), len(b_bytes))
        self.names = pa.array([str(i).encode() + mark for mark, n in zip(marks, spans) for i in range(n)], pa.large_binary())
        self.first_name = np.cumsum((0, *spans))[:4]

    @staticmethod
    def _unprinted() -> dict[str, int]:
        """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}

    def _piece_bytes(self, at: int) -> bytes:
        piece = self.pieces.id_to_piece(at)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(at) else piece.replace("▁", " ").encode()

    def a_ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # the fast encoder gives up on some very long runs with a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.plain.encode(text, add_special_tokens=False).ids

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(byte_vocabulary: str, piece_vocabulary: str) -> Tokenizers:
    return Tokenizers(byte_vocabulary, piece_vocabulary)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def _joined(side: pa.ListArray, token_bytes: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes of all tokens laid end to end, and where each list begins and ends in them."""
    taken = token_bytes.take(side.flatten())
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(taken).to_numpy())))
    data = taken.buffers()[2]
    return memoryview(data).cast("B") if data else memoryview(b""), ends[side.offsets.to_numpy() - side.offsets[0].as_py()]


def _same(whole: list[bytes], side: pa.ListArray, token_bytes: pa.Array) -> np.ndarray:
    data, cuts = _joined(side, token_bytes)
    return np.array([data[a:b] == text for text, a, b in zip(whole, cuts.tolist(), cuts[1:].tolist())], bool)


def _ends(side: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, parents, ends) of all tokens: ends are sums of token lengths that start anew with each list."""
    ids, parents = pc.list_flatten(side).to_numpy(), pc.list_parent_indices(side).to_numpy()
    length = pa.array(sizes[ids], pa.int64())
    run = pc.cumulative_sum(length).to_numpy()
    first = side.offsets.to_numpy()[:-1]
    before = np.concatenate(([0], run))[first]
    return ids, parents, run - before[parents]


def _shared(a_parents: np.ndarray, a_ends: np.ndarray, b_parents: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True at the tokens of either side whose end is an end of the other side too."""
    left = pa.table({"doc": a_parents, "end": a_ends, "a": np.arange(len(a_ends))})
    right = pa.table({"doc": b_parents, "end": b_ends, "b": np.arange(len(b_ends))})
    met = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False)
    out = []
    for name, n in (("a", len(a_ends)), ("b", len(b_ends))):
        mark = np.zeros(n, bool)
        mark[met.column(name).to_numpy()] = True
        out.append(mark)
    return out[0], out[1]


def _links(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, group_doc: np.ndarray, links: np.ndarray) -> pa.Table:
    """(doc, pair, times) of all links of the groups."""
    found = []
    for crowded in (False, True):
        sides = []
        for ids, group, name in ((a_ids, a_group, "a"), (b_ids, b_group, "b")):
            own = (links[group] > PLAIN_LINKS) == crowded
            side = pa.table({"group": group[own], name: ids[own].astype(np.int64)})
            if crowded:
                side = side.group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"times_{name}"])
            sides.append(side)
        if not sides[0].num_rows:
            continue
        met = sides[0].join(sides[1], keys="group", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(met.column("a"), SIDE), met.column("b"))
        times = pc.multiply(met.column("times_a"), met.column("times_b")) if crowded else pa.array(np.ones(met.num_rows, np.int64))
        found.append(pa.table({"doc": group_doc[met.column("group").to_numpy()], "pair": pair, "times": times}))
    if not found:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    return pa.concat_tables(found).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"])


def _digests(both: Tokenizers, a: tuple, b: tuple, a_last: np.ndarray, b_last: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: int, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[str]:
    """SHA-256 of the groups of each document, spelled as ``a1,a2|b1;a3|b2,b3``."""
    a_ids, b_ids = a[0], b[0]
    per_a, per_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    code = np.empty(len(a_ids) + len(b_ids), np.int64)
    code[np.arange(len(a_ids)) + (np.cumsum(per_b) - per_b)[a_group]] = a_ids + both.first_name[a_last.astype(np.int64)]
    code[np.arange(len(b_ids)) + np.cumsum(per_a)[b_group]] = b_ids + both.first_name[2 + b_last.astype(np.int64)]
    named = both.names.take(pa.array(code))
    data = memoryview(named.buffers()[2]).cast("B") if len(code) else memoryview(b"")
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(named).to_numpy())))[a_cuts + b_cuts]
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends.tolist(), ends[1:].tolist())]


def align(both: Tokenizers, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Counts per text, digests of the groups, and the links as (doc, pair, times) in the order of doc."""
    whole = [f" {x}" if x else "" for x in texts]
    a_lists = _lists([both.a_ids(x) if x else [] for x in whole])
    b_lists = _lists(both.b_ids([x or "" for x in texts]))
    raw = [x.encode() for x in whole]
    good = _same(raw, a_lists, both.a_bytes) & _same(raw, b_lists, both.b_bytes)
    if not good.all():
        keep = pa.array(good)
        a_lists, b_lists = (pc.if_else(keep, side, pa.scalar([], side.type)) for side in (a_lists, b_lists))
        a_lists, b_lists = (pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(s).to_numpy()))), pa.int32()), s.flatten()) for s in (a_lists, b_lists))
    a, b = _ends(a_lists, both.a_sizes), _ends(b_lists, both.b_sizes)
    a_last, b_last = _shared(a[1], a[2], b[1], b[2])
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    n_groups = int(a_last.sum())
    group_doc = a[1][a_last].astype(np.int64)
    links = np.bincount(a_group, minlength=n_groups) * np.bincount(b_group, minlength=n_groups)
    n = len(texts)
    counts = {
        "n_a": np.diff(a_lists.offsets.to_numpy()).astype(np.int64),
        "n_b": np.diff(b_lists.offsets.to_numpy()).astype(np.int64),
        "n_groups": np.bincount(group_doc, minlength=n),
        "n_links": np.concatenate(([0], np.cumsum(links)))[np.cumsum(np.bincount(group_doc, minlength=n))],
    }
    counts["n_links"] = np.diff(counts["n_links"], prepend=0)
    digests = _digests(both, a, b, a_last, b_last, a_group, b_group, n_groups, a_lists.offsets.to_numpy().astype(np.int64), b_lists.offsets.to_numpy().astype(np.int64))
    return counts, digests, _links(a[0], a_group, b[0], b_group, group_doc, links).sort_by("doc")


def aligned(docs: DataFrame, doc_id: str, text: str, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document."""

    def encode(batches):
        both, row = tokenizers(byte_vocabulary, piece_vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                counts, digests, links = align(both, part.column(1).to_pylist())
                cuts = pa.array(np.searchsorted(links.column("doc").to_numpy(), np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, links.column(x).combine_chunks()) for x in ("pair", "times")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + part.num_rows), pa.int64()), part.column(0), *(pa.array(counts[x], pa.int64()) for x in SUMS), pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", *SUMS, "groups_sha256", "pairs", "times"],
                )
                row += part.num_rows
        give_back()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("row", T.LongType()), slim.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in SUMS), T.StructField("groups_sha256", T.StringType())]
    return slim.mapInArrow(encode, T.StructType([*fields, T.StructField("pairs", longs), T.StructField("times", longs)]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether that is the most of its first id."""

    def count(batches):
        held, size = [], 0

        def partial():
            table = pa.table({"pair": pa.chunked_array(held, pa.int64())}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            return table.rename_columns(["pair", "n"]).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch.column(0).flatten())
            size += len(held[-1])
            if size >= PARTIAL_PAIRS:
                yield from partial()
                held, size = [], 0
        if size:
            yield from partial()
        give_back()

    counted = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored(counted, "alignment-pairs")
    first_id = F.floor(F.col("pair") / SIDE)
    most = counted.groupBy(first_id.alias("a")).agg(F.max("n").alias("most"))
    # a row per id of the first vocabulary: its size bounds what is sent
    marked = counted.withColumn("a", first_id).join(F.broadcast(most), "a")
    return marked.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs have that many documents or more."""
    scale = F.floor(F.log2("n")).cast("int")
    held = sorted(((r["s"], r["count"]) for r in counts.groupBy(scale.alias("s")).count().collect()), reverse=True)  # 64 rows at most
    total, least = 0, 1 << (held[0][0] + 1 if held else 0)
    for s, n in held:
        total += n
        if total > most:
            break
        least = 1 << s
    return least


def compared(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_vocabulary: str = "byte_bpe_50k.json", piece_vocabulary: str = "piece_bpe_32k.model", common_pairs: int = COMMON_PAIRS
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every row of ``docs`` is a document of its own, repeated ones count as often as they occur; a null id stays null.
    Null and empty texts, and those that either tokenizer does not give back byte by byte, have no tokens: zeros and an
    empty digest. Strings of special tokens are plain text. Texts of any length are taken whole. Other columns are not
    looked at, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(aligned(docs, doc_id, text, byte_vocabulary, piece_vocabulary), "alignment")
    counts = stored(pair_counts(rows), "alignment-counts")
    least = common_from(counts, common_pairs)
    common = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(common.column("pair").to_numpy())
    keys, n = common.column("pair").to_numpy()[order], common.column("n").to_numpy()[order]
    best = common.column("best").to_numpy(zero_copy_only=False)[order]
    sent = spark.sparkContext.broadcast((keys, n, best))

    def look_up(batches):
        keys, n, best = sent.value
        for batch in batches:
            pair, times = (batch.column(x).flatten().to_numpy() for x in ("pairs", "times"))
            cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("pairs")).to_numpy())))
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            value, good = (np.where(known, x[at] * times, 0) if len(keys) else np.zeros(len(pair), np.int64) for x in (n, best))
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[cuts]), pa.int64()) for x in (good, value)]
            left = pa.array(np.concatenate(([0], np.cumsum(~known)))[cuts], pa.int32())
            lists = [pa.ListArray.from_arrays(left, pa.array(x[~known], pa.int64())) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums, *lists], [*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    fields = rows.schema.fields
    longs = [T.StructField(x, T.LongType()) for x in ("n_best", "count_sum")]
    looked = rows.mapInArrow(look_up, T.StructType([*fields[:-2], *longs, *fields[-2:]]))
    shown = ["doc_id", *SUMS, "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # all pairs were sent
        return looked.select(*shown)
    looked = stored(looked, "alignment-sums")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "pair")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0)
    summed = looked.drop("pairs", "times").join(more, "row", "left")
    summed = summed.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", zero)).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", zero))
    return summed.select(*shown)
