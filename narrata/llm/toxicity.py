"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import SLICE_BYTES, Recent, hashed_fold, releasing, slices, texts_of

WORD = re.compile(r"[^\W\d_]+|[.!?\n]+")
#: Hashed feature weights, and the lengths of the word beginnings that are features besides the word itself.
DIMENSIONS, PREFIXES = 1 << 18, (3, 4, 5, 6, 7)
#: Scores of words kept by a worker, and the text bytes that it handles at once.
KEPT_WORDS, TEXT_BYTES = 100_000, SLICE_BYTES // 2


def checksums(word: str) -> list[int]:
    """Checksums of the word and of its beginnings, 0 for beginnings longer than the word."""
    return [crc32(f"={word}".encode()), *(crc32(f"{n}{word[:n]}".encode()) if len(word) >= n else 0 for n in PREFIXES)]


def features(word: str) -> list[int]:
    """Places of a word's features in the weight vector."""
    return [x % DIMENSIONS for x in checksums(word)]


def folded(text: str) -> str:
    """The text in lower case, at the same length: letters whose lower case is longer stay as they are."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join([low if len(low := c.lower()) == 1 else c for c in text])


def sequences(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-case words of all texts, each word's text number and its sentence number."""
    words: list[str] = []
    owner, sentence = [], []
    s = 0
    for i, text in enumerate(texts):
        s += 1
        for w in WORD.findall(folded(text)):
            if w[0] in ".!?\n":
                s += 1
            else:
                words.append(w)
                owner.append(i)
                sentence.append(s)
    return words, np.array(owner, np.int64), np.array(sentence, np.int64)


@dataclass
class Chain:
    """Two labels: transitions[i, j] from label i to j; a word's evidence is its score for label 1 less that for 0."""

    transitions: np.ndarray

    def ratios(self, evidence: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios of the forward and backward messages for every word; all sentences step side by side."""
        n = len(evidence)
        forward, backward = evidence.copy(), np.zeros(n)
        if not n:
            return forward, backward
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        sizes = np.diff(np.r_[starts, n])
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        (a00, a01), (a10, a11) = self.transitions
        for j in range(1, sizes[0]):
            at = starts[: live[j]] + j
            r = forward[at - 1]
            forward[at] += np.logaddexp(a01, a11 + r) - np.logaddexp(a00, a10 + r)
        last = starts + sizes - 1
        for j in range(1, sizes[0]):
            at = last[: live[j]] - j
            x = evidence[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(a10, a11 + x) - np.logaddexp(a00, a01 + x)
        return forward, backward

    def marginals(self, evidence: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        forward, backward = self.ratios(evidence, sentence)
        return sigmoid(forward + backward)

    def pairs(self, forward: np.ndarray, backward: np.ndarray, evidence: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Expected counts of the label pairs at the words `inner`, which follow another of their sentence."""
        r, x = forward[inner - 1], evidence[inner] + backward[inner]
        a = self.transitions
        logs = np.stack([np.full_like(r, a[0, 0]), a[0, 1] + x, a[1, 0] + r, a[1, 1] + r + x])
        p = np.exp(logs - logs.max(axis=0))
        return (p / p.sum(axis=0)).sum(axis=1).reshape(2, 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    chain: Chain
    centre: np.ndarray
    spread: np.ndarray
    document: np.ndarray

    def evidence(self, word: str) -> float:
        return self.bias + float(self.weights[features(word)].sum())


def token_labels(words: list[str], owner: np.ndarray, toxic: np.ndarray, least: int = 4, ratio: float = 4.0, surprise: float = 12.0) -> np.ndarray:
    """Labels of words, taken from labelled documents.

    A word of a toxic document is labelled if it, or a beginning of it, stands in toxic documents at `ratio` times
    its rate in clean ones or more, in at least `least` different toxic texts, and the log-likelihood ratio of the two
    rates is at least `surprise`.
    """
    if not words:
        return np.zeros(0, bool)
    distinct, codes = np.unique(np.array(words, dtype=object), return_inverse=True)
    dirty = toxic[owner]
    clean, foul = (np.bincount(codes[dirty == k], minlength=len(distinct)) for k in (False, True))
    totals = max(1, int(clean.sum())), max(1, int(foul.sum()))
    texts = np.bincount(np.unique(codes[dirty].astype(np.int64) * len(toxic) + owner[dirty]) // len(toxic), minlength=len(distinct))
    keys = np.array([checksums(w) for w in distinct], np.int64)
    _, at = np.unique(keys, return_inverse=True)
    at = at.reshape(keys.shape)
    c, d, t = (np.bincount(at.ravel(), np.repeat(x, keys.shape[1])) for x in (clean, foul, texts))
    p = (c + d) / sum(totals)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(d > 0, d * np.log(d / totals[1] / p), 0) + np.where(c > 0, c * np.log(c / totals[0] / p), 0))
    marked = (t >= least) & (d / totals[1] >= ratio * (c + 0.5) / totals[0]) & (gain >= surprise)
    hit = (marked[at] & (keys > 0)).any(axis=1)
    return hit[codes] & dirty


def document_features(marginals: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per document: expected toxic words (log), their share of the words (log), and the largest marginal."""
    total = np.bincount(owner, marginals, n) if len(owner) else np.zeros(n)
    words = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n)
    most = np.zeros(n)
    np.maximum.at(most, owner, marginals)
    return np.column_stack([np.log1p(total), np.log((total + 0.1) / (words + 20)), most])


def fit(texts: list[str], toxic: list[bool], rounds: int = 30, step: float = 0.5, decay: float = 1e-6) -> ToxicityModel:
    """The model from labelled texts: labelled words train the chain by its log-likelihood, documents the last layer."""
    truth = np.array(toxic, bool)
    words, owner, sentence = sequences(texts)
    labels = token_labels(words, owner, truth).astype(float)
    distinct, codes = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (np.array([], object), np.array([], int))
    rows = np.array([features(w) for w in distinct], np.int64).reshape(len(distinct), 1 + len(PREFIXES))
    weights, bias = np.zeros(DIMENSIONS), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    chain = Chain(np.zeros((2, 2)))
    seen, seen_pairs, seen_bias = np.full(DIMENSIONS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    inner = np.flatnonzero(np.r_[False, sentence[1:] == sentence[:-1]]) if len(sentence) else np.array([], int)
    observed = np.bincount((2 * labels[inner - 1] + labels[inner]).astype(int), minlength=4).reshape(2, 2) if len(inner) else np.zeros((2, 2))
    for _ in range(rounds if labels.any() else 0):
        evidence = (bias + weights[rows].sum(axis=1))[codes]
        forward, backward = chain.ratios(evidence, sentence)
        miss = labels - sigmoid(forward + backward)
        per_word = np.bincount(codes, miss, len(distinct))
        slope = np.bincount(rows.ravel(), np.repeat(per_word, rows.shape[1]), DIMENSIONS) / np.sqrt(len(words)) - decay * weights
        pair_slope = (observed - chain.pairs(forward, backward, evidence, inner)) / np.sqrt(len(words))
        seen += slope**2
        seen_pairs += pair_slope**2
        bias_slope = miss.sum() / np.sqrt(len(words))
        seen_bias += bias_slope**2
        weights += step * slope / np.sqrt(seen)
        bias += step * bias_slope / np.sqrt(seen_bias)
        chain = Chain(chain.transitions + step * pair_slope / np.sqrt(seen_pairs))
    evidence = (bias + weights[rows].sum(axis=1))[codes] if len(codes) else np.zeros(0)
    stats = document_features(chain.marginals(evidence, sentence), owner, len(texts))
    centre, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(stats)), (stats - centre) / spread])
    beta = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a small ridge
        p = sigmoid(x @ beta)
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta)), x.T @ (truth - p) - 0.1 * beta)
    return ToxicityModel(weights.astype(np.float32), bias, chain, centre, spread, beta)


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most: int, most_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[bool]]:
    """Texts and labels of at most `most` documents and most_bytes of each class, those of the smallest hashed ids outside the
    fold; documents of over a thirtieth of most_bytes aren't taken."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.where(hashed_fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    of_label = [chosen.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most) for label in (0, 1)]
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    met = named.where(F.col("size") <= most_bytes // 30).join(F.broadcast(of_label[0].union(of_label[1])), "id")  # 2 * most ids are broadcast
    in_order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "size", "text").rowsBetween(Window.unboundedPreceding, 0)  # as many rows, but for repeated ids
    within = met.withColumn("n", F.count("*").over(in_order)).withColumn("bytes", F.sum("size").over(in_order))
    rows = within.where((F.col("n") <= most) & (F.col("bytes") <= most_bytes)).select("text", "label").collect()  # 2 * most_bytes
    rows.sort(key=lambda r: r.label)
    return [r.text for r in rows], [bool(r.label) for r in rows]


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = 1000, most_bytes: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """A model fitted on at most `most` labelled documents of each class, of most_bytes in all, whose crc32(id) modulo folds isn't
    held_out; None without both classes."""
    texts, marks = labelled_sample(docs, labels, folds, held_out, most, most_bytes, id_col, text_col, label_col)
    return fit(texts, marks) if len(set(marks)) == 2 else None


def evidence_of(model: ToxicityModel) -> Recent:
    """word -> its evidence, with a bounded store of those met before."""
    weights, bias = memoryview(model.weights), model.bias
    return Recent(lambda word: bias + sum([weights[x] for x in features(word)]), KEPT_WORDS)


def spans_in(text: str, marginals: list[float], least: float) -> list[dict]:
    """Runs of words whose marginal is at least `least`, with their code-point offsets and largest marginal."""
    out: list[dict] = []
    k, joined = 0, False
    for m in WORD.finditer(folded(text)):
        if m[0][0] in ".!?\n":
            joined = False
            continue
        p = marginals[k]
        k += 1
        if p >= least:
            if joined:
                out[-1] |= {"end": m.end(), "marginal": max(out[-1]["marginal"], p)}
            else:
                out.append({"start": m.start(), "end": m.end(), "marginal": p})
        joined = p >= least
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, spans: bool = True) -> DataFrame:
    """(id, score, n_words, toxic_words, spans array<struct<start, end, marginal>>) per row, in one pass without a shuffle.

    score is the probability of the label toxic, from the forward-backward marginals of all words; spans are the
    offending runs of words in code points. Cases: a null text counts as an empty one, which is scored like others;
    without a model (no labels of both classes) all scores are 0 and no spans are found; rows that repeat each get a
    row; an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = evidence_of(model) if model else None
        for batch in slices(batches, "text", TEXT_BYTES):
            texts = texts_of(batch, "text")
            n = len(texts)
            found: list[list[dict]] = [[] for _ in texts]
            words, owner, sentence = sequences(texts)
            sizes = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, int)
            scores, total = np.zeros(n), np.zeros(n)
            if model:
                evidence.tidy()
                marginals = model.chain.marginals(np.fromiter(map(evidence.__getitem__, words), float, len(words)), sentence)
                stats = document_features(marginals, owner, n)
                scores = sigmoid(model.document[0] + ((stats - model.centre) / model.spread) @ model.document[1:])
                total = np.bincount(owner, marginals, n) if len(owner) else total
                if spans:
                    ends = np.cumsum(sizes)
                    for i in np.unique(owner[marginals >= least]).tolist() if len(owner) else []:
                        found[i] = spans_in(texts[i], marginals[ends[i] - sizes[i] : ends[i]].tolist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(sizes, pa.int64()), pa.array(total), pa.array(found, kind)], names=["id", "score", "n_words", "toxic_words", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, score double, n_words long, toxic_words double, spans array<struct<start:int,end:int,marginal:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below threshold, in one pass without a shuffle; all of them without a model.

    Cases: a null text scores as an empty one; rows that repeat stay or go alike; an empty table gives no rows; all columns stay as
    they are, whatever their names.
    """
    if model is None:
        return docs

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = evidence_of(model)
        for batch in slices(batches, text_col, TEXT_BYTES):
            evidence.tidy()
            words, owner, sentence = sequences(texts_of(batch, text_col))
            marginals = model.chain.marginals(np.fromiter(map(evidence.__getitem__, words), float, len(words)), sentence)
            stats = document_features(marginals, owner, len(batch))
            scores = sigmoid(model.document[0] + ((stats - model.centre) / model.spread) @ model.document[1:])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
