"""The hidden Markov model against plain recursions and enumerated paths, and whole rows against plain counting."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from narrata.llm import hmm_lm as H
from narrata.llm.queries import QUERIES


def random_model(k, columns, seed=1):
    rng = np.random.default_rng(seed)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) ** 2)
    return H.Hmm(share(k), share(k, k), share(k, columns).T.copy(), share(k))


def plain_log(text, model, first=None):
    a, total = (model.start if first is None else first) * model.emit[text[0]], 0.0
    for x in text[1:]:
        total += math.log(a.sum())
        a = (a / a.sum()) @ model.move * model.emit[x]
    return total + math.log(a.sum())


def test_likelihoods_of_short_and_long_texts():
    rng = np.random.default_rng(2)
    model = random_model(4, 30)
    lengths = np.array([1, 7, 256, 257, H.LONG, H.LONG + 1, 3, 3 * H.LONG + 100])
    flat = rng.integers(0, 30, lengths.sum()).astype(np.uint16)
    starts = np.cumsum(lengths) - lengths
    got = H.likelihoods(flat, starts, lengths, model)
    want = [plain_log(flat[s : s + n], model) for s, n in zip(starts, lengths, strict=True)]
    assert np.allclose(got, want, rtol=1e-12)


def test_expected_counts_equal_enumerated_paths():
    model = random_model(3, 5)
    texts = [[0, 3, 1, 4], [2], [4, 4]]
    begins = np.array([True, False, True])
    flat, lengths = np.array(sum(texts, []), np.uint16), np.array([4, 1, 2])
    counts, moves, first, total = H.expected(flat, np.cumsum(lengths) - lengths, lengths, begins, model)
    want_counts, want_moves, want_first, want_total = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for text, begin in zip(texts, begins, strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(text)):
            p = (model.start if begin else model.spread)[path[0]]
            for i, (s, x) in enumerate(zip(path, text, strict=True)):
                p *= model.emit[x, s] * (model.move[path[i - 1], s] if i else 1)
            paths[path] = p
        all_ = sum(paths.values())
        want_total += math.log(all_)
        for path, p in paths.items():
            for i, (s, x) in enumerate(zip(path, text, strict=True)):
                want_counts[x, s] += p / all_
                if i:
                    want_moves[path[i - 1], s] += p / all_
            if begin:
                want_first[path[0]] += p / all_
    assert np.allclose(counts, want_counts) and np.allclose(moves, want_moves) and np.allclose(first, want_first) and total == pytest.approx(want_total)


def test_rounds_raise_the_likelihood_and_shares_sum_to_one():
    rng = np.random.default_rng(3)
    truth = random_model(3, 40, 9)
    texts = []
    for _ in range(200):
        s, text = rng.choice(3, p=truth.start), []
        for _ in range(rng.integers(1, 60)):
            text.append(rng.choice(40, p=truth.emit[:, s]))
            s = rng.choice(3, p=truth.move[s])
        texts.append(np.array(text, np.uint16))
    usual = np.bincount(np.concatenate(texts), minlength=40) + 0.5
    usual /= usual.sum()
    model, seen = H._start(3, usual), []
    for _ in range(12):
        sums = H._round(texts, model)
        seen.append(sums[-1])
        model = H._refitted(sums, 3, usual)
        assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and model.start.sum() == pytest.approx(1)
    assert seen[-1] > seen[1] > seen[0]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_rows(docs, folds, held_out):
    """With one state the model emits columns as they are counted, so its scores have a plain form."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == held_out for i, _ in docs]
    train = Counter(w for (_, t), h in zip(docs, held, strict=True) if not h for w in tokens(t))
    ends = held.count(False)
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    column = lambda w: int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "big", signed=True) % H.CLASSES
    of_class, kinds = Counter(), Counter()
    for w, c in train.items():
        of_class[column(w)] += c
        kinds[column(w)] += 1
    size = {"end": ends + 0.5} | {g: of_class[g] + 0.5 for g in range(H.CLASSES)}
    total = sum(size.values())
    emit = {k: s / total for k, s in size.items()}
    out = []
    for (i, t), h in zip(docs, held, strict=True):
        ws = tokens(t)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        score = math.log10(emit["end"])
        for w in ws:
            inside = (train[w] + 0.5) / (of_class[column(w)] + 0.5 * (kinds[column(w)] + 1))
            score += math.log10(emit[column(w)] * inside)
        out.append((-1 if i is None else i, h, len(ws) + 1, sum(train[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [H.PART_BYTES, 20_000])
def test_rows_equal_plain_counting(spark, odd_docs, monkeypatch, part_bytes):
    monkeypatch.setattr(H, "PART_BYTES", part_bytes)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for folds, held_out in ((5, 1), (1, 0)):  # the second leaves no training text
        got = sorted((-1 if r.id is None else r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in H.hmm_scores(odd_docs, folds, held_out, states=1).collect())
        for g, w in zip(got, plain_rows(docs, folds, held_out), strict=True):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_empty_table(spark, no_docs):
    assert H.hmm_scores(no_docs).count() == 0


def test_query_beats_single_words_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_hmm_scores"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_rows(docs, 5, 1)
    for r, w in zip(sorted(rows), want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
    held = [r for r in rows if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.1


def test_every_round_takes_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_TOKENS", 500)  # several tasks
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 60)) % 50 + 50 * (i % 2))) for i in range(2500)]
    docs.append((9001, "tail " * (H.LONG + 5)))  # longer than any text that a start of short ones would take
    column = lambda w: int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "big", signed=True) % H.CLASSES + 1
    texts = {i: np.array([*map(column, t.split()), 0], np.uint16) for i, t in docs}
    train = [x for i, x in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    usual = np.bincount(np.concatenate(train), minlength=H.CLASSES + 1) + 0.5
    usual /= usual.sum()
    model = H._start(6, usual)
    for _ in range(4):
        model = H._refitted(H._round(train, model), 6, usual)
    words = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    n, v = Counter(), Counter()
    for w, c in words.items():
        n[column(w)] += c
        v[column(w)] += 1
    inside = lambda w: math.log10((words[w] + 0.5) / (n[column(w)] + 0.5 * (v[column(w)] + 1)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.id: r.score for r in H.hmm_scores(df, rounds=4).collect()}
    assert len(got) == len(docs)
    for i, t in docs[::50] + docs[-1:]:
        want = plain_log(texts[i], model) / math.log(10) + sum(map(inside, t.split()))
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)
