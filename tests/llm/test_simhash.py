import random

import numpy as np
import pytest
import xxhash

from atoflow.llm import simhash
from atoflow.llm.common import components

from .helpers import ROWS, awkward, classes, empty, rows, words


def plain_fp(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain(data, radius=2):
    fps = [plain_fp(t) for _, t in data]
    top = classes(len(data), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    low = {}
    for (i, _), c in zip(data, top):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, f - (1 << 64) if f >> 63 else f, low.get(c)) for (i, _), f, c in zip(data, fps, top)), key=repr)


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(simhash.near_dedup(docs), "doc_id", "fp", "component_id") == plain(data)


def test_awkward_rows(spark):
    assert rows(simhash.near_dedup(awkward(spark)), "doc_id", "fp", "component_id") == plain(ROWS)


@pytest.mark.parametrize("tile,radius", [(4, 2), (1024, 2), (7, 3), (16, 0)])
def test_links_give_the_components_of_all_pairs(spark, tile, radius, monkeypatch):
    """Chains and dense groups of fingerprints, over many and few tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd, fps = random.Random(tile), {0, (1 << 64) - 1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 12])):
            fps.add(x)
            for _ in range(rnd.choice([1, 2, 3])):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(signed(f))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(n for n, r in found.items() if r == root) for root in set(found.values())}
    assert all(root == min(n for n, r in found.items() if r == root) for root in set(found.values()))


def test_offsets_cover_every_pair():
    for radius in (0, 1, 2, 3):
        got = set(simhash.neighbour_offsets(radius))
        assert all(d == (0,) * 4 or tuple(-x for x in d) not in got for d in got)
        rng = np.random.default_rng(radius)
        for _ in range(300):
            a = int(rng.integers(0, 2 ** 63))
            b = a
            for k in rng.integers(0, 64, radius):
                b ^= 1 << int(k)
            d = tuple((b >> 16 * i & 0xFFFF).bit_count() - (a >> 16 * i & 0xFFFF).bit_count() for i in range(4))
            assert d in got or tuple(-x for x in d) in got


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1400)] + [(5, 5), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1400)}, 2: 2, 3: 2}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    df = awkward(spark)
    kept = simhash.drop_near_copies(df)
    assert kept.schema == df.schema
    want = {c for _, _, c in plain(ROWS) if c is not None}
    # and the group that has no id at all
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*want, None], key=repr)


def test_long_text_is_counted_piecewise():
    text = " ".join(f"w{i}" for i in range(70_000))
    assert simhash.simhash(text) == plain_fp(text)


def test_empty_table(spark):
    assert simhash.near_dedup(empty(spark)).count() == 0
    assert simhash.drop_near_copies(empty(spark)).count() == 0
