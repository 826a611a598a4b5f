"""Ranked lexical search: the best documents of every item, by dense blocked matrix products.

Documents are read once for what they hold of the items' terms (term numbers and frequencies, a slim table) and for
their length. From that table come the statistics of all documents, the weight of every term, and the impact of a term
in a document. Items and documents are then multiplied in tiles: the weights of a few hundred items over the terms that
these items use, times the impacts of a thousand documents on the same terms, both dense and in double precision. Weights
and impacts are whole numbers, and the terms of a tile are chosen so that no sum of a product can reach 2^53, so
every product is exact; tiles of terms are added as 64-bit integers.

Every task keeps the best documents of each item, whole ties included until their order by id is known, and sends only
these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import byte_slices, give_back, stored

BEST = 20
SLICE_BYTES = 12 * 1024 * 1024
ITEM_TILE, TERM_TILE, DOCUMENT_TILE = 256, 2048, 1024
#: Pairs of an item and a term that are taken on at once; more items are searched in several passes.
BLOCK_PAIRS = 500_000
#: The largest impact: 10^9 * tf div (1000 * tf + 12 * m) stays below it.
MOST_IMPACT = 1_000_000
EXACT = 2**53
#: Repeats of a term in an item beyond this count go to further columns of their own.
MOST_REPEATS = 100_000

# Letters and digits stay, A-Z in lower case; other ASCII turns to blanks; bytes of other letters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of texts: their numbers in one run, terms per text, the distinct terms."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    cleaned = (data.to_pybytes() if data else b"")[offsets[0] : offsets[-1]].translate(_BYTES)
    plain = pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(cleaned)])
    split = pc.ascii_split_whitespace(plain)
    sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
    empty = pc.index(terms, "").as_py()
    if empty >= 0:
        real = codes != empty
        before = np.concatenate(([0], np.cumsum(real)))
        ends = np.cumsum(sizes)
        codes, sizes = codes[real], before[ends] - before[ends - sizes]
    return codes, sizes, terms


def _counts(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of every code of every text; codes below 0 are left out."""
    text = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
    keys, count = np.unique(text * width + codes[codes >= 0], return_counts=True)
    return keys // width, keys % width, count


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, times): rows that share an item_id are one item with the terms of all of them."""

    def count(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                codes, sizes, terms = term_codes(part.column(1))
                item, code, times = _counts(codes, sizes, max(1, len(terms)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item)), terms.take(pa.array(code)), pa.array(times, pa.int64())], ["item_id", "term", "times"])
        give_back()

    slim = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    fields = T.StructType([slim.schema["item_id"], T.StructField("term", T.StringType()), T.StructField("times", T.LongType())])
    return slim.mapInArrow(count, fields).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def held_terms(docs: DataFrame, vocabulary: pa.Array, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_terms, terms, times) of every document: how many terms it has, and those of ``vocabulary`` by place."""

    def hold(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                codes, sizes, terms = term_codes(part.column(1))
                place = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64)
                doc, term, times = _counts(place[codes] if len(codes) else codes, sizes, max(1, len(vocabulary)))
                cuts = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *lists], ["doc_id", "n_terms", "terms", "times"])
        give_back()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbers = T.ArrayType(T.IntegerType())
    fields = T.StructType([slim.schema["doc_id"], T.StructField("n_terms", T.LongType()), T.StructField("terms", numbers), T.StructField("times", numbers)])
    return slim.mapInArrow(hold, fields)


class Tile:
    """Items, a few hundred at most, by the terms that they use: dense weights, cut into tiles of terms."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, n_items: int):
        layers = np.maximum(1, -(-times // MOST_REPEATS))  # a term that an item repeats very often takes several columns
        again = np.repeat(np.arange(len(item)), layers)
        layer = np.arange(len(again)) - np.repeat(np.cumsum(layers) - layers, layers)
        part = np.minimum(MOST_REPEATS, times[again] - layer * MOST_REPEATS)
        column_keys, column = np.unique(term[again] * (int(layers.max(initial=1)) + 1) + layer, return_inverse=True)
        self.n_items, self.columns = n_items, column_keys // (int(layers.max(initial=1)) + 1)
        value = part * weight[term[again]]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        by_column = np.argsort(column, kind="stable")
        bounds = np.searchsorted(column[by_column], np.arange(len(self.columns) + 1))
        while at < len(self.columns):
            sums, stop = np.zeros(n_items, np.int64), at
            while stop < len(self.columns) and stop - at < TERM_TILE:
                own = by_column[bounds[stop] : bounds[stop + 1]]
                sums[item[again][own]] += value[own]
                if stop > at and int(sums.max()) * MOST_IMPACT >= EXACT:
                    break
                stop += 1
            own = by_column[bounds[at] : bounds[stop]]
            dense = np.zeros((n_items, stop - at))
            dense[item[again][own], column[own] - at] = value[own]
            self.parts.append((self.columns[at:stop], dense))
            at = stop

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, width: int) -> np.ndarray:
        """Scores of all items for a tile of documents, whose terms and impacts stand in one run."""
        total = np.zeros((self.n_items, n_docs), np.int64)
        for terms, dense in self.parts:
            first = np.full(width, -1)  # a term may have several columns: the first, then the others
            places, own = np.unique(terms, return_index=True)
            first[places] = own
            held = first[term] >= 0
            impacts = np.zeros((len(terms), n_docs))
            impacts[first[term[held]], doc[held]] = impact[held]
            further = np.setdiff1d(np.arange(len(terms)), own)
            impacts[further] = impacts[first[terms[further]]]
            total += np.rint(dense @ impacts).astype(np.int64)
        return total


class Best:
    """The best documents of each item so far: highest scores, then smallest ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.n_items, self.k = n_items, k
        self.item, self.score, self.doc, self.missing = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.ones(n_items, np.int64)

    def take(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        floor = self.floor
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, at = np.nonzero(scores >= floor[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, gone = np.concatenate([self.doc, docs[at]]), np.concatenate([self.missing, missing[at]])
        order = np.lexsort((doc, gone, -score, item))
        item = item[order]
        sizes = np.bincount(item, minlength=self.n_items)
        rank = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = order[rank < self.k]
        self.item, self.score, self.doc, self.missing = item[rank < self.k], score[kept], doc[kept], gone[kept]
        full = np.flatnonzero(sizes >= self.k)
        self.floor[full] = self.score[(np.cumsum(np.minimum(sizes, self.k)) - 1)[full]]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(times: np.ndarray, n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """Impact of a term that stands ``times`` times in a document of ``n_terms`` terms."""
    m = 100 - 25 + (25 * n_terms * n_docs) // max(1, all_terms)
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def _search_block(docs: DataFrame, asked: pa.Table, item_type: T.StructField, doc_id: str, text: str, k: int) -> DataFrame:
    """Best documents of some items, whose (item_id, term, times) are at hand: item_id, doc_id, score of every task."""
    terms = asked.column("term").combine_chunks().dictionary_encode()
    ids = asked.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary, width = terms.dictionary, len(terms.dictionary)
    item, term, times = ids.indices.to_numpy().astype(np.int64), terms.indices.to_numpy().astype(np.int64), asked.column("times").to_numpy()
    held = stored(held_terms(docs, vocabulary, doc_id, text), "rank-terms")
    total = held.agg(F.count(F.when(F.col("n_terms") > 0, 1)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    df = np.zeros(width, np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of these items
        df[row["term"]] = row["count"]
    n_docs, all_terms = total["n"], total["l"]
    weight = term_weights(n_docs, df)
    names, n_items = ids.dictionary, len(ids.dictionary)

    def tiles() -> list[Tile]:
        out = []
        for at in range(0, n_items, ITEM_TILE):
            own = (item >= at) & (item < at + ITEM_TILE)
            out.append(Tile(item[own] - at, term[own], times[own], weight, min(ITEM_TILE, n_items - at)))
        return out

    def search(batches):
        blocks = tiles()
        best = [Best(t.n_items, k) for t in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENT_TILE):
                part = batch.slice(at, DOCUMENT_TILE)
                sizes = pc.list_value_length(part.column(2)).to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                flat = [part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3)]
                impact = impacts(flat[1], part.column(1).to_numpy()[doc], n_docs, all_terms)
                missing = part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                docs_at = pc.fill_null(part.column(0), 0).to_numpy()
                for block, top in zip(blocks, best):
                    top.take(block.scores(doc, flat[0], impact, len(sizes), width), docs_at, missing)
        for at, top in enumerate(best):
            found = pa.array(top.doc, mask=top.missing > 0)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(top.item + at * ITEM_TILE)), found, pa.array(top.score)], ["item_id", "doc_id", "score"])
        give_back()

    return held.mapInArrow(search, T.StructType([item_type, T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item_id, rank, doc_id, score.

    Every row of ``docs`` is a document of its own, repeated ones are ranked as often as they occur; equal scores come
    in the order of doc_id, null ids last. Rows of ``items`` that share an item_id, null included, are one item. Null
    and empty texts have no terms: such items get no rows, such documents don't count. Texts of any length are taken
    whole. Other columns are not looked at, whatever their names. Without documents or items the result is empty.
    """
    asked = stored(item_terms(items, item_id, item_text), "rank-items")
    blocks = max(1, math.ceil(asked.count() / block_pairs))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = _search_block(docs, own.toArrow(), asked.schema["item_id"], doc_id, text, k)  # about ``block_pairs`` rows at most
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", "doc_id", "score")

