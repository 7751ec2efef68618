from zlib import crc32

import numpy as np

from narrata.llm import quality as Q
from narrata.llm import queries
from narrata.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def accuracy(rows, truth, folds, fold):
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth and crc32(str(r.doc_id).encode()) % folds == fold]
    return sum(a == b for a, b in seen) / len(seen)


def test_quality_on_held_out_labels(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert accuracy(rows, truth, 4, 2) > 0.95


def test_toxicity_on_held_out_labels(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, truth, 3, 1) > 0.93


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = Q.quality_scores(odd_docs, lab).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        rows = T.score_toxicity(odd_docs, T.train_toxicity(odd_docs, lab)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.quality_scores(no_docs, labels).count() == 0 and T.score_toxicity(no_docs, None).count() == 0
    assert np.isfinite([Q.statistics(t) for t in ("", " ", "a", "\n\n", "é" * 9999)]).all()


def test_chain_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    chain = T.Chain(rng.normal(size=(2, 2)))
    evidence, sentence = rng.normal(size=7), np.array([0, 0, 0, 0, 1, 1, 2])
    got = chain.marginals(evidence, sentence)
    for s in (0, 1, 2):
        at = np.flatnonzero(sentence == s)
        weight = {y: np.exp(sum(evidence[at[i]] for i in range(len(y)) if y[i]) + sum(chain.transitions[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=len(at))}
        for i, place in enumerate(at):
            assert abs(got[place] - sum(w for y, w in weight.items() if y[i]) / sum(weight.values())) < 1e-12


def test_spans_are_offsets_of_words(spark):
    docs = [(i, f"The {'nasty brute' if i % 2 else 'kind friend'} number{i} came home. All was well with tree{i % 7}.") for i in range(200)]
    model = T.fit([t for _, t in docs], [i % 2 == 1 for i, _ in docs])
    rows = T.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    text = dict(docs)
    assert all((r.score > 0.5) == (r.id % 2 == 1) for r in rows)
    assert {text[r.id][s.start : s.end] for r in rows for s in r.spans} <= {"nasty brute", "nasty", "brute"}


def test_isotonic_is_the_nearest_rising_fit():
    x, y = Q.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and y[0] == 0 and abs(np.interp(1.5, x, y) - 0.5) < 1e-12
