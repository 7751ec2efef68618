"""The prefix trie against a plain one that is built turn by turn."""

import hashlib
import random
import zlib

import pytest

from narrata.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = T.prefix_trie(df).select(*COLUMNS).collect()
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_random_conversations(spark):
    rnd = random.Random(7)
    rows = []
    for c in [*range(-3, 25), *range(100, 130), *range(250, 262), 7001]:
        for t in range(rnd.choice([1, 2, 3, 5, 8, 9])):
            rows.append((c, t, "user" if t % 2 else None, rnd.choice(["a", "bb", "ünï𝄞", "", None])))
    rnd.shuffle(rows)
    check(spark, rows)


def test_copies_and_long_conversations(spark):
    rnd = random.Random(8)
    long = [(f"r{i % 2}", "x" * rnd.randrange(3)) for i in range(150)]
    rows = [(c, t, *turn) for c in range(100, 120) for t, turn in enumerate(long[: 150 if c < 105 else rnd.choice([16, 64, 65])])]
    rows += [(200, t, *turn) for t, turn in enumerate(long)] + [(201, t, *turn) for t, turn in enumerate([*long[:70], ("r", "other"), *long[71:]])]
    got = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert T.prefix_trie(got).where("depth = 0").first()["n_convs"] == 22
    check(spark, [r for r in rows if r[1] < 40])


@pytest.mark.parametrize(
    "rows",
    [
        [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, 1, "user", "then"), (5, 0, "user", "second")],
        [(103, t, "u", "x") for t in (0, 1)] + [(307, 0, "u", "x"), (307, 0, "u", "x")],
        [(None, 0, "user", "lost")],
    ],
)
def test_odd_rows(spark, rows):
    check(spark, rows)
