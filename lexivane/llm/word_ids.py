"""Ids of whole texts by a word-end vocabulary that drops white space, for tasks that count or pack tokens.

The ids of a word don't depend on its neighbours, so the distinct words of a slice are encoded once and remembered.
Latin words are looked up in lower case and apart from trailing full stops and commas. Words are told apart, looked up
and laid out by Arrow and numpy, a slice at a time; only what is new goes to the tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexivane.llm.common import runs

REMEMBERED_BYTES = 12 * 1024 * 1024
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$"


class Remembered:
    """Ids by text, within a bound of bytes: beyond it, the half that was used longest ago is forgotten."""

    ENTRY = 28  # bytes of an entry's numbers

    def __init__(self, most: int):
        self.most = most
        self.texts = pa.array([], pa.string())
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.clock = np.zeros(0, np.int32), 0
        self.ids = np.zeros(0, np.uint32)

    def places(self, texts: pa.Array) -> np.ndarray:
        """Entry of each text, -1 where it is not known."""
        return pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy().astype(np.int64)

    def add(self, texts: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.texts = pa.concat_arrays([self.texts, texts])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.full(len(count), self.clock, np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def trim(self, used: np.ndarray) -> None:
        """Called between slices; ``used``: entries of the last one."""
        self.clock += 1
        self.used[used] = self.clock
        if self.texts.nbytes + self.ids.nbytes + self.ENTRY * len(self.texts) <= self.most:
            return
        kept = np.argsort(-self.used, kind="stable")
        size = pc.binary_length(self.texts).to_numpy()[kept] + 4 + 4 * self.count[kept] + self.ENTRY
        kept = np.sort(kept[np.cumsum(size) <= self.most // 2])
        count = self.count[kept]
        self.ids = self.ids[runs(self.first[kept], count)]
        self.texts, self.used = self.texts.take(pa.array(kept)), self.used[kept]
        self.first, self.count = np.cumsum(count) - count, count


class WordTokenizer:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        # tasks fill the cores; threads of the library's own would only keep memory each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[at for name, at in names.items() if name.endswith("</w>")]] = True
        self.known = Remembered(REMEMBERED_BYTES)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, texts: pa.Array, latin: bool) -> np.ndarray:
        """Entries of distinct texts; the unknown ones are encoded, Latin words many in one call, cut at their word ends."""
        found = self.known.places(texts)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = texts.take(pa.array(new))
            words = fresh.to_pylist()
            if latin:
                ids = np.concatenate(self._encode([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]))
                count = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
                if len(count) != len(words):
                    raise ValueError("this vocabulary doesn't mark the ends of words")
            else:
                each = self._encode(words)
                ids, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            found[new] = len(self.known.texts) + np.arange(len(new))
            self.known.add(fresh, ids, count)
        return found

    def ids(self, texts: pa.Array, end: bytes) -> tuple[bytes, np.ndarray]:
        """Ids of all texts laid end to end as little-endian 32-bit numbers, each closed by ``end``; ids per text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary

        # two places per distinct word: the word or its stem, and what trails the stem
        places = np.full((len(words), 2), -1, dtype=np.int64)
        latin = pc.match_substring_regex(words, LATIN).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(latin)
        if len(at):
            plain = words.take(pa.array(at))
            stems = pc.utf8_lower(pc.utf8_rtrim(plain, characters=".,")).dictionary_encode()
            places[at, 0] = self._places(stems.dictionary, True)[stems.indices.to_numpy()]
            tailed = at[pc.match_substring_regex(plain, "[.,]$").to_numpy(zero_copy_only=False)]
            if len(tailed):
                tails = pc.replace_substring_regex(words.take(pa.array(tailed)), "^[^.,]+", "").dictionary_encode()
                places[tailed, 1] = self._places(tails.dictionary, False)[tails.indices.to_numpy()]
        at = np.flatnonzero(~latin)
        if len(at):
            places[at, 0] = self._places(words.take(pa.array(at)), False)

        parts = places.ravel()
        there = parts >= 0
        count = np.where(there, self.known.count[parts], 0) if len(self.known.count) else np.zeros(len(parts), np.int64)
        first = np.where(there, self.known.first[parts], 0) if len(self.known.count) else count
        own = np.concatenate([self.known.ids[runs(first, count)], np.frombuffer(end, dtype="<u4")]).astype("<u4")
        length = np.append(count.reshape(-1, 2).sum(axis=1), len(end) // 4)
        self.known.trim(parts[there])

        closed = np.insert(codes, np.cumsum(sizes), len(words))
        total = np.concatenate(([0], np.cumsum(length[closed])))
        bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        return own[runs((np.cumsum(length) - length)[closed], length[closed])].tobytes(), np.diff(total[bounds])


@lru_cache(maxsize=2)
def word_tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)
