"""SentencePiece encoding and decoding by suffix-array matching.

A text is cut where no piece can reach across: before a run of spaces, around characters without a piece,
and between a letter and a comma or full stop where no piece holds both. The
distinct cuts of a batch that were not met before are laid end to end and indexed by a suffix array. Every piece of
the vocabulary is searched in it, which gives the range of its occurrences; each occurrence is an edge between two
places of the text. The edges are sorted by their start and relaxed: of all edges into a place, the one that
may follow the last piece before its start by the merge order of the vocabulary is the last piece up to there.
So the result is that of merging pairs by score, without merging. Characters without a piece become bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import runs

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
KEPT = 250_000
BLOCK_LETTERS = 1 << 19


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in the order of their first ``depth`` letters and more.

    As many letters as fit are packed into the first key; every further round doubles what is compared.
    """
    letters, rank = np.unique(text, return_inverse=True)
    width = int(len(letters)).bit_length()
    step = max(1, 62 // width)
    padded = np.concatenate((rank.astype(np.int64) + 1, np.zeros(step, dtype=np.int64)))
    key = np.zeros(len(text), dtype=np.int64)
    for k in range(step):
        key = (key << width) | padded[k : k + len(text)]
    while True:
        order = np.argsort(key)
        if step >= depth:
            return order.astype(np.int32)
        ordered = key[order]
        rank = np.empty(len(text) + step, dtype=np.int64)
        rank[len(text) :] = 0
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        key = rank[: len(text)] * (len(text) + 2) + rank[step:]
        step *= 2


def blocks(units: list[str]):
    """Runs of units of about ``BLOCK_LETTERS`` letters."""
    first, letters = 0, 0
    for at, unit in enumerate(units):
        letters += len(unit)
        if letters >= BLOCK_LETTERS or at == len(units) - 1:
            yield units[first : at + 1]
            first, letters = at + 1, 0


class Pieces:
    """A vocabulary of merged pieces: matching, merge order, bytes."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        every = range(processor.get_piece_size())
        plain = [i for i in every if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
        names = {i: processor.id_to_piece(i) for i in plain}
        if any(SPACE in name.lstrip(SPACE) for name in names.values()):
            raise ValueError("pieces reach across words")
        # numbers by merge order: single letters first, then the better scores
        self.ids = np.array(sorted(plain, key=lambda i: (len(names[i]) > 1, -processor.get_score(i), i)), dtype=np.int32)
        self.names = [names[i] for i in self.ids.tolist()]
        self.number = {name: i for i, name in enumerate(self.names)}
        self.letters = sum(len(name) == 1 for name in self.names)
        self.lengths = np.array([len(name) for name in self.names])
        self.depth = int(self.lengths.max())
        self.code = np.zeros((len(self.names), self.depth), dtype=np.uint32)
        for i, name in enumerate(self.names):
            self.code[i, : len(name)] = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)
        self.byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.strange = re.compile("([^" + re.escape("".join(name for name in self.names if len(name) == 1)) + "])")
        self._pair_table()
        self.bytes_of: dict[int, bytes] = {i: name.replace(SPACE, " ").encode() for i, name in names.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_by_id = np.array([*(self.bytes_of.get(i, b"") for i in every), b""], dtype=object)
        before_marks = "" if any(re.search(r"[^\W\d_][.,]", name) for name in self.names) else rf"{SPACE}*[^\W\d_]+(?=[.,])|"
        self.cuts = re.compile(f"{before_marks}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.known: dict[str, bytes] = {}

    def _pair_table(self) -> None:
        """What two pieces merge to, and which two made a piece."""
        pairs: list[tuple[int, int, int]] = []
        self.left = np.arange(len(self.names))
        self.right = np.arange(len(self.names))
        for i, name in enumerate(self.names):
            own = [(self.number[name[:k]], self.number[name[k:]]) for k in range(1, len(name)) if name[:k] in self.number and name[k:] in self.number]
            pairs += [(a * len(self.names) + b, i, 0) for a, b in own]
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.pair_whole = np.array([p[1] for p in pairs], dtype=np.int64)
        self.whole = {p[0]: p[1] for p in pairs}
        self.made = np.ones(len(self.names), dtype=bool)
        for i, name in enumerate(self.names):
            if len(name) > 1:
                ends = self._merge([self.number[c] for c in name if c in self.number]) if all(c in self.number for c in name) else None
                self.made[i] = ends is not None and ends[0] == [i]
                if self.made[i]:
                    self.left[i], self.right[i] = ends[1]

    def _merge(self, parts: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Merge neighbours by order, the first place first; the pieces left and the last pair merged."""
        last, n = None, len(self.names)
        while len(parts) > 1:
            best, at = min(((self.whole.get(parts[k] * n + parts[k + 1], n), k) for k in range(len(parts) - 1)))
            if best == n:
                break
            last = (parts[at], parts[at + 1])
            parts = [*parts[:at], best, *parts[at + 2 :]]
        return parts, last

    def may_follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether two pieces stay apart when the text of both is merged from its letters.

        The later made of both is taken back to its half at the border, again and again, and the pieces that then
        meet are asked whether they would have merged before.
        """
        out = np.ones(len(one), dtype=bool)
        rows, one, two = np.arange(len(one)), one.astype(np.int64), two.astype(np.int64)
        limit = np.full(len(one), 1 << 40)
        while len(rows):
            key = one * len(self.names) + two
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = (self.pair_keys[at] == key) & (self.pair_whole[at] < limit)
            out[rows[merged]] = False
            whole_one, whole_two = self.right[one] == one, self.left[two] == two
            first = ((one > two) & ~whole_one) | whole_two
            go = ~merged & ~(whole_one & whole_two)
            limit = np.where(first, one, two + 1)
            one, two = np.where(first, self.right[one], one), np.where(first, two, self.left[two])
            rows, one, two, limit = rows[go], one[go], two[go], limit[go]
        return out

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of all occurrences in a text, found by a binary search of every piece."""
        order = suffix_array(text, self.depth)
        padded = np.concatenate((text, np.zeros(self.depth, dtype=text.dtype)))
        lo, hi = np.zeros(len(self.names), dtype=np.int64), np.full(len(self.names), len(text), dtype=np.int64)
        for d in range(self.depth):
            on = np.flatnonzero((self.lengths > d) & (lo < hi))
            letter = self.code[on, d]
            bounds = []
            for after in (False, True):
                low, high = lo[on], hi[on]
                while (low < high).any():
                    middle = (low + high) // 2
                    there = padded[order[np.minimum(middle, len(order) - 1)] + d]
                    before = (there <= letter) if after else (there < letter)
                    open_rows = low < high
                    low, high = np.where(open_rows & before, middle + 1, low), np.where(open_rows & ~before, middle, high)
                bounds.append(low)
            lo[on], hi[on] = bounds
        sizes = np.where(self.made, hi - lo, 0)
        return order[runs(lo, sizes)], np.repeat(np.arange(len(self.names), dtype=np.int32), sizes)

    def match(self, units: list[str]) -> list[bytes]:
        """Ids of units that hold letters with pieces only."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        text = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), dtype=np.uint32)
        base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        start, piece = self.occurrences(text)
        inside = (np.arange(len(text)) - np.repeat(base, sizes + 1)).astype(np.uint16 if sizes.max() < 1 << 16 else np.int64)
        by_offset = np.argsort(inside[start], kind="stable")
        start, piece = start[by_offset], piece[by_offset]
        del by_offset
        offset = inside[start]
        last = np.full(len(text) + 1, -1, dtype=np.int64)
        cuts = np.searchsorted(offset, np.arange(int(sizes.max()) + 1, dtype=np.int64))
        for p in range(int(sizes.max())):
            s, t = start[cuts[p] : cuts[p + 1]], piece[cuts[p] : cuts[p + 1]]
            if p:
                key, back = np.unique(last[s] * len(self.names) + t, return_inverse=True)
                fits = self.may_follow(key // len(self.names), key % len(self.names))[back]
                s, t = s[fits], t[fits]
            last[s + self.lengths[t]] = t
        # walk back from the ends of all units at once
        places, units_at, found_unit, found_piece, found_place = base + sizes, np.arange(len(units)), [], [], []
        while len(places):
            t = last[places]
            found_unit.append(units_at)
            found_piece.append(t)
            found_place.append(places)
            places = places - self.lengths[t]
            more = places > base[units_at]
            places, units_at = places[more], units_at[more]
        unit, piece, place = (np.concatenate(x) for x in (found_unit, found_piece, found_place))
        forward = np.argsort(place, kind="stable")
        flat = self.ids[piece[forward]].astype("<i4").tobytes()
        cuts = [0, *(np.cumsum(np.bincount(unit, minlength=len(units))) * 4).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit numbers; a null text counts as empty."""
        cut = [self.cuts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = [u for u in set().union(*cut) if u not in self.known]
        learned: dict[str, bytes] = {}
        if new:
            parts = {u: self.strange.split(u) for u in new if self.strange.search(u)}
            plain = sorted({x for p in parts.values() for x in p[::2] if x}.union(u for u in new if u not in parts))
            ids: dict[str, bytes] = {}
            for block in blocks(plain):
                ids.update(zip(block, self.match(block)))
            strange = {c: np.array([self.byte_ids[b] for b in c.encode()], dtype="<i4").tobytes() for p in parts.values() for c in p[1::2]}
            learned = {u: ids[u] for u in new if u not in parts}
            learned |= {u: b"".join(ids.get(x, b"") if k % 2 == 0 else strange[x] for k, x in enumerate(p)) for u, p in parts.items()}
        if len(self.known) < KEPT:
            self.known.update(learned)
            return [b"".join(map(self.known.__getitem__, units)) for units in cut]
        both = self.known | learned if learned else self.known
        return [b"".join(map(both.__getitem__, units)) for units in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; what is no piece of text is left out, bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids >= 0) & (ids < len(self.bytes_by_id) - 1), ids, len(self.bytes_by_id) - 1)
        return b"".join(self.bytes_by_id[known].tolist()).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the ids of each text, as an array of int. A null or empty text has none.

    A column named like the new one is replaced; other columns and repeated rows stay.
    """
    kept = df.drop(ids)
    at = kept.columns.index(text)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = pieces(model).encode(part.column(at).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))], [*part.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of each array of ids; a null array gives an empty text, null ids are left out."""
    kept = df.drop(text)
    at = kept.columns.index(ids)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            flat = column.flatten()
            values = flat.fill_null(-1).to_numpy().astype(np.int64)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [pieces(model).decode(values[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Encode all texts and decode them again: doc_id, ids, n_ids, same (the decoded text is the text).

    Only texts with the space mark U+2581 itself, which stands for a space, don't come back. A null text counts as empty.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(1).to_pylist()
                found = pieces(model).encode(texts)
                sizes = [len(x) // 4 for x in found]
                same = [pieces(model).decode(np.frombuffer(x, dtype="<i4")) == t for x, t in zip(found, texts)]
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "same"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], *T._parse_datatype_string("ids array<int>, n_ids long, same boolean").fields]))
