import random
from collections import defaultdict

import numpy as np
import xxhash

from narrata.llm import queries
from narrata.llm import simhash as H
from narrata.llm import simhash_wide as W
from narrata.llm.graph import connected_components, forest_roots


def plain_fingerprint(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = [p for p in __import__("re").split(r"[\x20\x09-\x0D]+", parts) if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute(rows, limit=2):
    fps = [(i, plain_fingerprint(t or "")) for i, t in rows]
    linked = [(i, j) for i, a in fps for j, b in fps if i < j and (a ^ b).bit_count() <= limit]
    component = groups([i for i, _ in fps], linked)
    return sorted((i, f"{fp:016x}", component[i]) for i, fp in fps)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op9_simhash_near_dedup(spark, sf).collect()) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = H.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.id: r.component_id for r in rows}
    assert by[2] == 1 and by[5] == by[4] == by[9] == 4 and by[6] == 6 and by[None] is None
    assert H.near_duplicates(no_docs).count() == 0


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << rnd.randrange(12)
            if rnd.random() < 0.5:
                x ^= 1 << rnd.randrange(12)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bits in (1, 2):
        want = groups(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits])
        for cap in (4, 10_000):
            got = {r.node: r.component for r in connected_components(H.links(df, bits, cap)).collect()}
            assert {x: got.get(x, x) for x in signed} == want


def test_long_chain_is_one_component(spark):
    df = spark.range(0, 300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in connected_components(df).collect()} == {0}


def test_roots_of_a_forest(spark):
    rnd = random.Random(3)
    parent = {n: n - 1 if n < 70 else rnd.randrange(n) if n % 9 else 5 for n in range(1, 400) if n not in (90, 200)}  # a chain, a hot node, three trees
    root = groups(range(400), parent.items())
    got = {r.node: r.component for r in forest_roots(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()}
    assert got == {n: root[n] for n in parent.keys() | set(parent.values())}
    assert forest_roots(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_wide_groups_of_near_copies(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    rows, groups_of = [], {}
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(250)]
        for k in range(8):
            copy = list(base)
            for _ in range(0 if k == 0 else 3):
                copy[rnd.randrange(250)] = rnd.choice(vocab)
            groups_of[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (64, 3):  # with a small cap the large buckets' way is taken
        monkeypatch.setattr(W, "PAIR_BUCKET", cap)
        found = defaultdict(set)
        for r in W.wide_near_duplicates(df).collect():
            found[r.component_id].add(r.id)
        assert all(len({groups_of[i] for i in ids}) == 1 for ids in found.values())
        assert len(found) == 12
    kept = W.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "None"])
    assert W.keep_one(no_docs).count() == 0


def test_parities_tell_a_difference_and_never_more():
    """Of sets of any sizes no more is told than they differ in, and of near copies under the similarity enough to refuse them."""
    rnd = np.random.default_rng(5)
    sets = []
    for m in (1, 3, 16, 17, 100, 146, 300, 5000, 40_000):
        h = rnd.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, m, dtype=np.uint64)
        sets += [np.unique(h), np.unique(h[: m - m // 6]), np.unique(np.concatenate([h[m // 6 :], h[: m // 6] ^ np.uint64(0x9E3779B97F4A7C15)]))]
    marks = W.Parities([W.parity(h) for h in sets])
    x, y = np.meshgrid(np.arange(len(sets)), np.arange(len(sets)))
    x, y = x.ravel(), y.ravel()
    told = W.differ_by(marks, marks, x, y)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (told <= real).all() and (told[x == y] == 0).all()
    copies = [rnd.permutation(sets[15])[:122] for _ in range(60)]  # of 146 shingles 122, so two have about 102 in common: 0.72
    near = W.Parities([W.parity(h) for h in copies])
    x, y = np.triu_indices(60, 1)
    inter = np.array([len(np.intersect1d(copies[i], copies[j])) for i, j in zip(x, y, strict=True)])
    refused = W.differ_by(near, near, x, y) > 244 * 0.2 / 1.8 + 1e-6
    assert not refused[inter / (244 - inter) >= 0.8].any() and refused.mean() > 0.9


def test_radius_follows_the_similarity():
    assert W.radius(0.9, 768) < W.radius(0.8, 768) < 768 / 2
    for width in (16, 26, 33, 43):
        cut = W.Blocks.of_width(width)
        assert cut.width * cut.count <= 64 * cut.lanes
        fp, keys = W.sketch(W.shingle_set("one two three four five six seven"), cut)
        assert fp.dtype == np.int64 and len(fp) == cut.lanes and len(set(keys.tolist())) == cut.count << W.WEAK


def jaccard(a, b):
    a, b = ({tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} for p in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_wide_links_equal_exact_jaccard(spark, monkeypatch):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    rows, wanted = [], []
    for size in (30, 60, 150, 400):
        for k in range(60):
            base = [rnd.choice(vocab) for _ in range(size)]
            cut = round(size * (0.03 + 0.17 * k / 60))  # a changed end: similarities of about 0.65 to 0.95
            copy = base[: size - cut] + [rnd.choice(vocab) for _ in range(cut)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
            wanted.append((len(rows) - 2, jaccard(rows[-2][1], rows[-1][1])))
    line = " ".join(rnd.choice(vocab) for _ in range(12))  # a repeated line doesn't make texts alike
    rows += [(len(rows), f"{line}\n" * 80 + " ".join(rnd.choice(vocab) for _ in range(12)))]
    rows += [(len(rows), f"{line}\n" * 80 + " ".join(rnd.choice(vocab) for _ in range(12)))]
    wanted.append((len(rows) - 2, jaccard(rows[-2][1], rows[-1][1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (8, 1):
        monkeypatch.setattr(W, "PAIR_BUCKET", cap)
        part = {r.id: r.component_id for r in W.wide_near_duplicates(df).collect()}
        linked = {i for i, _ in wanted if part[i] == part[i + 1]}
        assert not {i for i, j in wanted if j < 0.8} & linked
        true = {i for i, j in wanted if j >= 0.8}
        assert len(true) > 60 and len(true - linked) <= 1
