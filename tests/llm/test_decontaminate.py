import random

import numpy as np
import pyarrow as pa

from narrata.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_the_table():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(30))] for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a, b)


def test_words_by_bytes_equal_words_by_letters():
    for t in ["É à x_y 3d", "a—b “c” d×e÷f", "日本。語", "", "¿que? ñ", "it's"]:
        assert D.words_of(t) == [w.encode() for w in D.WORD.findall(t.lower())]


def test_terms_of_all_texts_at_once_equal_those_of_words():
    rnd = random.Random(4)
    signs = "abcXYZ019_-.,  \n\0éÉßÿÀÞ÷×—“İσΣж½'"
    texts = ["".join(rnd.choice(signs[: rnd.choice([8, 16, 26, len(signs)])]) for _ in range(rnd.choice([0, 1, 5, 90]))) for _ in range(600)]
    texts += ["x" * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 700)] + ["é" * 32 + " b", "", None, "É"]
    for some in (pa.array(texts), pa.array(texts).slice(200, 300), pa.array(["", None]), pa.array(["×"])):
        flat, sizes = D.terms_of(some)
        want = [[D.column_of(w) for w in D.words_of(t or "")] for t in some.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_sums_by_term_and_hopeful_pairs_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(6)
    places, owner, values = np.r_[rng.integers(0, 3, 200), rng.integers(0, 900, 400)], rng.integers(0, 50, 600), rng.normal(size=(50, 4)).astype(np.float32)
    want = np.zeros((D.TERMS, 4))
    np.add.at(want, places, values[owner])
    assert np.allclose(D.term_sums(places, owner, values), want, atol=1e-4)

    monkeypatch.setattr(D, "PRESENT", 400)  # several groups of pairs
    items = [D.Item(i, rng.integers(0, 40, n).tolist()) for i, n in enumerate((3, 9, 20, 1))]
    sizes = np.array([30, 0, 12, 60, 5, 25])
    flat = rng.integers(0, 50, sizes.sum())
    text, item = (x.ravel() for x in np.meshgrid([0, 2, 2, 3, 5], [3, 0, 1, 2], indexing="ij"))
    parts = [set(p.tolist()) for p in np.split(flat, np.cumsum(sizes)[:-1])]
    plain = [sum(x in parts[t] for x in items[i].terms) >= 0.5 * len(items[i].terms) for t, i in zip(text, item, strict=True)]
    assert D.Hopeful(items, 0.5)(text, item, flat, sizes).tolist() == plain and 0 < sum(plain) < len(plain)


def test_planted_passages(spark, odd_docs, no_docs):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, prose(20 + 3 * i)) for i in range(12)]
    docs = [(100 + i, prose(300)) for i in range(150)]
    docs += [(500 + i, prose(80) + " " + t.upper().replace(" ", "!! ") + " " + prose(90)) for i, t in items]
    paraphrased = items[11][1].split()
    paraphrased[5] = paraphrased[17] = "other"
    docs.append((600, prose(40) + " " + " ".join(paraphrased) + " " + prose(40)))
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, prose(20))], "item_id long, text string")
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, similarity double")
    got = {(r.id, r.item_id): r.similarity for r in D.leaks(df, bench).collect()}
    assert set(got) == {(500 + i, i) for i, _ in items} | {(600, 11)}
    assert all(got[500 + i, i] == 1.0 for i, _ in items) and 0.9 < got[600, 11] < 1.0
    assert D.leaks(no_docs, bench).count() == 0 and D.leaks(odd_docs, bench.limit(0)).count() == 0
    assert D.leaks(odd_docs, bench).count() == 0


def test_short_and_changed_items_are_found(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7))) for _ in range(3000)]
    weights = [1 / (k + 5) for k in range(len(vocab))]
    prose = lambda n: rnd.choices(vocab, weights, k=n)
    items, docs, wanted = [], [(i, " ".join(prose(300))) for i in range(100)], set()
    for i in range(240):
        words = prose((5, 9, 15, 16, 17, 18, 22, 30)[i % 8])
        items.append((i, " ".join(words)))
        m, copy = len(words), list(words)
        changed = 0 if i % 3 == 0 or m < 8 else int(0.28 * m)  # the rule accepts 0.7 of the words
        for k in rnd.sample(range(m - 3), changed):
            copy[k] = "".join(rnd.choice("klmnop") for _ in range(8))
        docs.append((1000 + i, " ".join([*prose(rnd.randrange(100)), *copy, *prose(rnd.randrange(100))])))
        wanted.add((1000 + i, i))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.id, r.item_id): r for r in found}
    assert not wanted - set(got)
    assert all(got[1000 + i, i].similarity == 1.0 for i in range(0, 240, 3)) and min(r.cosine for r in found) < 0.45


def test_anchors_leave_out_no_stretch(spark):
    rnd = random.Random(4)
    idf = np.random.default_rng(1).random(D.TERMS)
    for _ in range(60):
        items = [D.Item(i, [rnd.randrange(60) for _ in range(rnd.randint(1, 24))]) for i in range(6)]
        texts = [[rnd.randrange(60) for _ in range(rnd.randrange(50))] for _ in range(5)]
        for t in texts[:3]:
            words = [x if rnd.random() < 0.8 else rnd.randrange(60) for x in rnd.choice(items).terms]
            t[len(t) // 2 : len(t) // 2] = words
        sizes = np.array([len(t) for t in texts])
        flat = np.array([x for t in texts for x in t])
        places = list(D.Anchors(items, idf, 0.7).places(flat, sizes))
        starts = [sum(sizes[:k]) for k in range(len(texts))]
        for k, t in enumerate(texts):
            for i, item in enumerate(items):
                m = len(item.terms)
                room = m + max(2, m // 8)
                for s in range(max(1, len(t) - room + 1)):
                    if lcs(item.terms, t[s : s + room]) >= D.words_needed(m, 0.7):
                        lo, hi = starts[k] + s, starts[k] + min(len(t), s + room)
                        assert any(a == k and b == i and c <= lo and hi <= d for a, b, c, d in places)
