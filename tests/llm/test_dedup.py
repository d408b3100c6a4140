"""Exact and near-duplicate removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import exact_dedup as exact
from caseloom.llm import simhash_dedup as near
from caseloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))
    texts = [None, "", "  ", "Abc def", "abc DEF", "abc def ", "ÀB", "àb", long, long.upper(), long + " x", "one two three four five"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(3, "Abc def", "en", "s", 0), (None, "abc def", None, None, None), (None, "only null id", None, None, None), (4, "other text of id four", "de", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: F.lit(1) for c in ("fp", "row_id", "keep_id", "fingerprint", "gone", "component_id", "language", "kept")}
    return df.withColumns(extra)


def norm(text):
    return (text or "").encode().lower().decode()


def test_fingerprints_compose():
    raw = random.Random(1).randbytes(300_000)
    whole = exact.fingerprint(raw)
    for cuts in ([0, 1, 65536, 65537, 300_000], [0, 150_000, 300_000]):
        parts = [exact.fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert exact.combine(parts) == whole
    h = 0
    for byte in raw[:1000]:
        h = (h * exact.BASES[0] + byte) % exact.MODULI[0]
    assert exact.fingerprint(raw[:1000])[1] == h


def test_parts_of_huge_documents_combine(spark):
    raw = random.Random(2).randbytes(200_000)
    parts = [(7, i, len(p), *exact.fingerprint(p)[1:]) for i, p in enumerate((raw[:3], raw[3:70_000], raw[70_000:]))]
    df = spark.createDataFrame(parts, "key long, part_no long, n_bytes long, h1 long, h2 long")
    assert tuple(exact.combine_parts(df, "key").first()) == (7, *exact.fingerprint(raw))


@pytest.mark.parametrize("moduli", [exact.MODULI, (2, 3)])
def test_exact_groups(odd, moduli):
    """Also with moduli so small that most texts of a length collide."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact.exact_groups(odd, moduli=moduli).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    high = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(
        ((i, high[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr
    )
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_duplicates_keeps_columns(odd):
    kept = exact.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(r.text) for r in odd.collect()})


def slow_simhash(text, words):
    tokens = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in range(max(1, len(tokens) - words + 1))]
    hashes = hashes if tokens else []
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def slow_groups(ids, prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    x, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            root[find(i)] = find(int(j))
    low = {}
    for i, d in enumerate(ids):
        known = [v for v in (low.get(find(i)), d) if v is not None]
        low[find(i)] = min(known, default=None)
    return [low[find(i)] for i in range(len(x))]


def test_simhash_equals_bit_votes():
    for text in (None, "", " \t", "a", "A b C", "a b c d", "é b c d e f g\x0bh", "x " * 70_000):
        assert near.simhash(text.encode() if text else text, 4) == slow_simhash(text, 4)


def near_prints(n, centres, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(7):
        x = x ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(x)


@pytest.mark.parametrize("n,centres", [(1, 1), (400, 6), (3000, 1), (3000, 40)])
def test_tree_links_equal_all_pairs(n, centres):
    x = near_prints(n, centres)
    u, v = near.shard_links(x, 4)
    at = {int(a): i for i, a in enumerate(x)}
    assert (np.bitwise_count(u ^ v) >= 1).all()
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(u, v):
        root[find(at[int(a)])] = find(at[int(b)])
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(i), []).append(i)
    mine = {i: min(g) for g in groups.values() for i in g}
    assert [mine[i] for i in range(len(x))] == slow_groups(list(range(len(x))), x, 4)


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 50}, {"shard_rows": 1}])
def test_links_over_shards_and_tiles(spark, sizes):
    x = near_prints(1500, 12, seed=5)
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(near.links(fps, 4, **sizes)).collect()}
    signed = [int(v) for v in x.view(np.int64)]
    assert [found.get(v, v) for v in signed] == slow_groups(signed, x, 4)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_near_duplicate_groups(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = near.near_duplicate_groups(odd, words=4).collect()
    prints = [slow_simhash(t, 4) for _, t in rows]
    lows = slow_groups([i for i, _ in rows], prints, 4)
    want = sorted(((i, f"{p:016x}", low) for (i, _), p, low in zip(rows, prints, lows)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_op3_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [near.simhash(t.encode(), 4) for _, t in rows]
    lows = slow_groups([i for i, _ in rows], prints, 4)
    got = near.op3_simhash_near_dedup(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, f"{p:016x}", low) for (i, _), p, low in zip(rows, prints, lows))


def test_drop_near_duplicates(odd):
    kept = near.drop_near_duplicates(odd, words=4)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    lows = slow_groups([i for i, _ in rows], [slow_simhash(t, 4) for _, t in rows], 4)
    want = [(i, t) for (i, t), low in zip(rows, lows) if i == low]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(none).count() == 0
    assert exact.drop_exact_duplicates(none).columns == none.columns
    assert near.near_duplicate_groups(none).count() == 0
    assert near.drop_near_duplicates(none).count() == 0


def test_links_come_through_trees():
    """At production sizes every shard is split, the bound leaves pairs out, and planted pairs are found."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for i in range(0, 200, 2):
        points[i + 1] = points[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    points = np.unique(points)
    found = near._Links(points, 4)
    found.within(np.arange(len(points)))
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    for i, j in zip(*np.nonzero(close)):
        assert found.group[i] == found.group[j]
    assert len(np.unique(found.group)) == len(points) - 100
    assert found.splits > len(points) / near.LEAF / 2 and found.compared < len(points) ** 2 / 2


@pytest.mark.parametrize("n", [0, 1, 3000, 50_000, 10**6, 10**8, 10**10])
def test_masks_are_as_wide_as_the_set_needs(n):
    masks = near.shard_masks(n)
    bits = {m.bit_count() for m in masks}
    assert len(bits) == 1 and n / 2 ** bits.pop() <= near.SHARD_ROWS
    rng = random.Random(n)
    for _ in range(300):  # any four bits leave one mask untouched
        changed = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & changed for m in masks)
