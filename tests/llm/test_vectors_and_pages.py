"""Operators on embeddings and pages against plain statements on small fixtures."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from lexivane.llm import ann, bit_codes, embedding_dedup, registry, url_filter, warc
from lexivane.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        rows.append((i, rng.normal(size=16).astype(np.float32).tolist(), i % 3))
    for g in range(8):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist(), g % 2))
    rows += [(600, None, 1), (620, [0.0] * 16, 1), (640, [math.nan] * 16, 1), (660, [math.inf] * 16, 1), (680, [1.0, None] * 8, 1), (700, [], 1), (720, [1.0] * 16, None), (740, [1.0] * 8, 1), (741, [1.0] * 8, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).cache()


def good(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def test_nearest(vectors, spark):
    rows, df = vectors
    usable = [(i, np.array(v, dtype=float)) for i, v, _ in rows if good(v)]
    want = {}
    for i, q in usable:
        if i % 20 == 0:
            scores = sorted((-float((q * v).sum()), j) for j, v in usable if j != i and len(v) == len(q))
            want[i] = [(j, -s) for s, j in scores[:20]]
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), slice_rows=100, group_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hit = sum(len({j for j, _ in want[i]} & {j for j, _ in got.get(i, [])}) for i in want)
    assert set(got) == set(i for i in want if want[i]) and hit >= 0.99 * sum(map(len, want.values()))
    assert ann.every_twentieth(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(500, 32)), rng.normal(size=(40, 32))
    codes = bit_codes.encode(x)
    true = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    off = np.abs(bit_codes.estimates(codes, bit_codes.turned_units(q)) - true)
    assert (off <= codes.spread()).mean() > 0.999 and off.mean() < 0.2


def test_vector_groups(vectors):
    rows, df = vectors
    links = {i: set() for i, _, _ in rows}
    usable = [(i, np.array(v, dtype=float), label) for i, v, label in rows if good(v) and label is not None]
    for i, v, a in usable:
        for j, w, b in usable:
            if i < j and a == b and len(v) == len(w) and float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    home = {}
    for i in sorted(links):
        todo = [i] if i not in home else []
        while todo:
            x = todo.pop()
            if x not in home:
                home[x] = i
                todo += links[x]
    for block in (7, 2048):
        out = embedding_dedup.deduplicated(df, block_rows=block).collect()
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out} == {(i, len(links[i]), home[i], home[i] == i) for i in links}
        assert len(out) == len(rows)
    assert embedding_dedup.deduplicated(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://h{i % 7}.example.com/en/{i}", "p" * (90 + i % 15)) for i in range(60)]
    rows += [
        (1001, None, None), (1002, "x", ""), (1003, "http://COM", "a" * 100), (1004, "://", "a" * 100), (1005, "HTTP://A.Net/es/x?y#z", "a" * 99), (1006, "h://net/fr/", "a" * 99),
        (1000, "q://www.example.com/en/", "a" * 100), (1009, "http://notexample.com/en/", "é" * 50), (1010, "http://com?/x", "é" * 50), (1011, "http://net/fr\n/", "z"),
        (1012, "http://x.example.com:80/en/", "y" * 70000), (1013, "a://com/\r\n\r\nContent-Length: 5", "x\r\n\r\n" * 40), (1000, "q://www.example.com/en/", "a" * 100), (None, "b://net/es/", "a" * 100),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).cache()


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in registry.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(pages):
    rows, df = pages
    out = url_filter.judged(df, registry.RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == Counter((r[0], *plain_verdict(r[1])) for r in rows)
    assert url_filter.judged(df.limit(0), registry.RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    assert {r.key for r in url_filter.contained(universe, cascade).collect()} == {r.key for r in listed.collect()}


def test_archives(pages, tmp_path):
    rows, df = pages
    first = {}
    for page_id, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page_id)
    want = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        again = len(payload) >= 100 and page_id != first.get(html or "", page_id)
        want[(page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[html] if again else None)] += 1
    out = warc.archived(df, folder=f"file://{tmp_path}").collect()
    assert Counter(tuple(r) for r in out) == want
    assert warc.archived(df.limit(0)).count() == 0
    members = list((tmp_path / "records").glob("*.warc.gz"))
    index = members[0].with_name(members[0].name + ".idx").read_text().splitlines()
    offset, length, kind, name = index[-1].split("\t")
    assert warc.read_record(members[0].read_bytes()[int(offset) : int(offset) + int(length)])[3] == kind


def test_damaged_archive():
    whole = warc.record("1", b"x" * 10, "0" * 64, None)
    with pytest.raises(ValueError):
        list(warc.records_in([whole[:-6]]))
    import gzip

    with pytest.raises(ValueError):
        warc.read_record(gzip.compress(whole))
