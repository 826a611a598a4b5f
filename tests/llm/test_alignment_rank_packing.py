"""Token alignment, ranked search and complement packing against plain statements on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexivane.llm import complement_packing, lexical_rank, token_alignment

SCHEMA = "doc_id long, text string, term string, row int, pair string, item_id int"
TEXTS = [
    "La casa verde, que los niños miran.", "The green house; it's THE house", None, "", "   two  blanks\n\n\tand tabs ", "日本語のテキスト — emoji 😀😀 zero​width",
    "a" * 3000, "=" * 700 + " " * 400 + "x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁low line▁ is a blank", "x\x00y", "İstanbul ǅ ﬁ ½ ٣ é é", "The green house; it's THE house",
    "word " * 4000, "42 4242 42,42", "été été",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "term", 7, "p", 1) for i, x in enumerate(TEXTS)]
    rows += [rows[0], (None, "green house", "t", 1, "p", 1), (None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---------------------------------------------------------------- op11


def plain_alignment(texts):
    both = token_alignment.tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    a_bytes, b_bytes = both.a_bytes.to_pylist(), both.b_bytes.to_pylist()
    found, holders = [], Counter()
    for text in texts:
        a = both.plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.pieces.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            found.append((0, 0, [], Counter()))
            continue
        groups, i, j, at, bt, left = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at <= bt:
                at += len(a_bytes[a[i]])
                left[0].append(a[i])
                i += 1
            else:
                bt += len(b_bytes[b[j]])
                left[1].append(b[j])
                j += 1
            if at == bt and left[1]:
                groups.append(left)
                left = ([], [])
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        holders.update(links.keys())
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for n_a, n_b, groups, links in found:
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if holders[p] == most[p[0]]),
            sum(n * holders[p] for p, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.mark.parametrize("common", [1 << 20, 40, 0])
def test_alignment(docs, common):
    rows, df = docs
    got = token_alignment.compared(df, common_pairs=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]))]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert [x for x in want if x[0] == 9][0][1] == 0 and [x for x in want if x[0] == 0][0][1] > 0, key


def test_fast_and_plain_encoder_agree(spark):
    both = token_alignment.tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    for text in TEXTS + ["\n \n  x", "it's IT'S 1½ a1b ", "\r\n\r\n", "  ", "　　a", "Ⅷ ² x"]:
        if text:
            assert both.a_ids(" " + text) == both.plain.encode(" " + text, add_special_tokens=False).ids


def test_alignment_of_nothing(spark, docs):
    assert token_alignment.compared(docs[1].where("doc_id = -1")).collect() == []
    assert [tuple(r)[1:] for r in token_alignment.compared(docs[1].where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


# ---------------------------------------------------------------- op12


def plain_ranks(docs, items, k):
    terms = lambda x: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    held = [(d, Counter(terms(x)), len(terms(x))) for d, x in docs]
    n, total = sum(1 for x in held if x[2]), sum(x[2] for x in held)
    df = Counter(t for x in held for t in x[1])
    asked = defaultdict(Counter)
    for item, x in items:
        asked[item].update(terms(x))
    out = []
    for item, q in asked.items():
        scored = []
        for d, tf, size in held:
            m = 100 - 25 + (25 * size * n) // max(1, total)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in q.items() if tf[t])
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if gone else d, -s) for i, (s, gone, d) in enumerate(sorted(scored)[:k])]
    return out


ITEMS = [(1, "green HOUSE house"), (1, "casa"), (2, "été 42 emoji"), (3, None), (4, ""), (5, "zzz unknown"), (None, "the word"), (6, "word " * 300), (7, "x the a")]


def test_ranks(spark, docs, monkeypatch):
    rows, df = docs
    items = spark.createDataFrame([(i, x, 5, 6) for i, x in ITEMS], "item_id int, text string, doc_id int, times int")
    want = sorted(plain_ranks([r[:2] for r in rows], ITEMS, 5), key=str)
    got = lexical_rank.ranked(df, items, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    # several blocks of items, tiny tiles, terms repeated beyond a column
    for name, value in (("ITEM_TILE", 2), ("TERM_TILE", 2), ("DOCUMENT_TILE", 3), ("MOST_REPEATS", 7)):
        monkeypatch.setattr(lexical_rank, name, value)
    tiny = lexical_rank.ranked(df, items, k=5, block_pairs=4)
    assert sorted((tuple(r) for r in tiny.collect()), key=str) == want


def test_tied_documents_rank_by_id(spark):
    df = spark.createDataFrame([(i, "same text here") for i in range(3000, 0, -1)] + [(i, "none") for i in range(4000, 8000)] + [(None, "same text here"), (9999, "other")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "other here")], "item_id long, text string")
    got = [(r["rank"], r["doc_id"]) for r in lexical_rank.ranked(df, items).orderBy("rank").collect()]
    assert got[0] == (1, 9999) and [d for _, d in got[1:]] == list(range(1, 20))


def test_sums_of_a_tile_stay_exact():
    rng = np.random.default_rng(3)
    n_terms, times = 600, np.full(600, 90_000)
    tile = lexical_rank.Tile(np.zeros(n_terms, np.int64), np.arange(n_terms), times, np.full(n_terms, 28_000), 1)
    impact = rng.integers(900_000, 1_000_000, n_terms)
    assert tile.scores(np.zeros(n_terms, np.int64), np.arange(n_terms), impact, 1, n_terms)[0, 0] == sum(90_000 * 28_000 * int(x) for x in impact)
    assert all(int(dense.sum()) * lexical_rank.MOST_IMPACT < 2**53 for _, dense in tile.parts) and len(tile.parts) > 1


def test_ranks_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical_rank.ranked(docs[1].where("doc_id = -1"), items).collect() == []
    assert lexical_rank.ranked(docs[1], items.where("item_id = -1")).collect() == []


# ---------------------------------------------------------------- op13


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, got, capacity):
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(ids_of(r[1]))
    at, seen = defaultdict(list), defaultdict(Counter)
    for r in got:
        assert r["start"] == r["piece"] * capacity and 0 < r["length"] <= capacity
        seen[r["doc_id"]][(r["piece"], r["length"], r["ids_crc32"])] += 1
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(Counter)
    for doc, many in texts.items():
        for ids in many:
            for p in range(-(-len(ids) // capacity)):
                piece = ids[p * capacity : (p + 1) * capacity]
                want[doc][(p, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert seen == want
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_complement_packing(docs):
    rows, df = docs
    for capacity in (2048, 64):
        n = check_packing(rows, complement_packing.pack(df, capacity=capacity).collect(), capacity)
        total = sum(len(ids_of(r[1])) for r in rows)
        assert n <= -(-total // capacity) + 2
    assert complement_packing.pack(df.where("doc_id = -1")).collect() == []


def fewest(lengths, capacity):
    """The least number of sequences, by trying every placement."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for at in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[at] >= lengths[i]:
                place(i + 1, rooms[:at] + [rooms[at] - lengths[i]] + rooms[at + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


def test_plan_against_every_placement():
    rng = np.random.default_rng(5)
    off = 0
    for _ in range(40):
        lengths = sorted(rng.integers(1, 40, 9).tolist(), reverse=True)
        rows, n = complement_packing.plan(np.bincount(lengths, minlength=41), 40)
        off += n - fewest(lengths, 40)
        assert n - fewest(lengths, 40) <= 1
    assert off <= 3


def test_exact_complements_are_found():
    counts = np.zeros(101, np.int64)
    for n, k in ((60, 4), (40, 1), (25, 1), (15, 1), (20, 1), (13, 1), (7, 1), (33, 1)):
        counts[n] = k
    rows, n = complement_packing.plan(counts, 100)
    assert n == 4  # 60+40, 60+25+15, 60+20+13+7 and 60+33
    assert complement_packing.plan(np.bincount([5] * 3_000_000, minlength=11), 10)[1] == 1_500_000
