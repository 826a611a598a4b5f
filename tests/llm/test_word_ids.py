"""Ids of whole texts against the library, with a memory too small for them."""

import random

import numpy as np
import pyarrow as pa

from lexivane.llm import word_ids

ODD = [None, "", "  ", "a.b ..,, É.É ñandú,, x<|endoftext|>y <|startoftext|> ", "İı ﬁ ǅ 你好 　 a b it's we'll 12th ªº ß", "éa ., .", "x" * 5000]


def test_ids_with_little_memory():
    rng = random.Random(2)
    words = word_ids.WordTokenizer("word_bpe_49k.json")
    words.known.most = 6000
    vocabulary = ["".join(rng.choice("abcdéñ") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(3000)]
    most = 0
    for _ in range(30):
        texts = [" ".join(rng.choice(vocabulary) for _ in range(60)), *rng.sample(ODD, 3)]
        ids, sizes = words.ids(pa.array(texts, pa.string()), b"\x02\x00\x00\x00")
        want = [[*x.ids, 2] for x in words.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
        assert np.frombuffer(ids, "<u4").tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))
        most = max(most, len(words.known.texts))
    assert 20 < most < 1000
