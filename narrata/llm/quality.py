"""Document quality: random Fourier features of text statistics, ridge scores and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SUMS, hashed_fold, partial_sum, releasing, slices, staged, texts_of, tree_sum

_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((lo <= _BYTES) & (hi >= _BYTES) for lo, hi in ((65, 90), (97, 122), (48, 57)))
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOPS = np.isin(_BYTES, list(b".,;:?'\"-()"))
_MARKS = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOPS
_LEAD = (_BYTES & 0xC0) != 0x80
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """Numbers that describe how a text is written; all finite for any text, the empty one too."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, w, k = max(1, int(counts[_LEAD].sum())), max(1, len(words)), max(1, len(lines))
    share = counts / max(1, len(data))
    used = share[share > 0]
    distinct = set(words)
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    short = data[:0] if not words else words[0]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        n / w,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_MARKS].sum() / n,
        counts[_STOPS].sum() / n,
        counts[33] / n,
        counts[124] / n,
        counts[_SPACE].sum() / n,
        counts[10] / w,
        float(-(used * np.log(used)).sum()) if len(used) else 0.0,
        len(distinct) / w,
        sum(map(len, distinct)) / max(1, len(distinct)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(set(lines)) / k,
        np.log1p(w / k),
        counts[46] / w,
        float(share.max()) if len(data) else 0.0,
        len(short) / 20,
    ]


@dataclass
class QualityModel:
    centre: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features whose inner products approximate a Gaussian kernel of the scaled statistics, and a constant."""
        z = np.clip((x - self.centre) / self.spread, -4, 4)
        return np.column_stack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) per row; a null text counts as an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "stats"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, STATISTICS)


def _summed(rows: DataFrame, part: object) -> np.ndarray:
    """Sum over all rows of part(statistics, labels), an array of a fixed size; each task adds up its rows first."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = part(_matrix(batch.column(0)), np.asarray(batch.column(1), np.float64)).ravel()
                total = x if total is None else total + x
        if total is not None:
            yield partial_sum(total)

    return tree_sum(rows.select("stats", "label").mapInArrow(run, SUMS))


def isotonic(position: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: ascending positions and the nearest non-decreasing levels."""
    blocks: list[list[float]] = []
    for p, m, w in zip(position, mean, weight, strict=True):
        blocks.append([p * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([p / w for p, _, w in blocks]), np.array([m / w for _, m, w in blocks])


def train_quality(stats: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, features: int = 256, ridge: float = 1e-3, bins: int = 1000, seed: int = 11, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel | None:
    """A model of all labelled rows whose crc32(id) modulo folds isn't held_out; None if there are none.

    Means, normal equations and the calibration's bins are sums over partitions of arrays of a fixed size. A repeated
    label row counts once, with the largest label; labels other than 0 and 1 and null ids are left out.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.where(hashed_fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    rows = staged(stats.join(chosen, "id").select("stats", "label"), "labelled")
    sums = _summed(rows, lambda x, y: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(y), y.sum()]]))
    if not len(sums):
        return None
    n = sums[-2]
    centre = sums[:STATISTICS] / n
    spread = np.sqrt(np.maximum(sums[STATISTICS : 2 * STATISTICS] / n - centre**2, 0)) + 1e-3
    random = np.random.default_rng(seed)
    model = QualityModel(centre, spread, random.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([sums[-1] / n]))
    size = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.fourier(x)
        return np.column_stack([f.T @ f, f.T @ y])

    equations = _summed(rows, normal).reshape(size, size + 1)
    penalty = ridge * n * np.eye(size)
    penalty[-1, -1] = 1e-9
    model.ridge = np.linalg.solve(equations[:, :size] + penalty, equations[:, size])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(model.raw(x), -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * bins).astype(int), bins - 1)
        return np.stack([np.bincount(at, v, bins) for v in (raw, y, np.ones(len(y)))])

    total, positive, weight = _summed(rows, binned).reshape(3, bins)
    used = weight > 0
    model.knots, model.levels = isotonic(total[used] / weight[used], positive[used] / weight[used], weight[used])
    return model


def score_quality(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """(id, score) per row of stats; without a model all scores are 0."""
    id_type = stats.schema["id"].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column(1))) if model and len(batch) else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return stats.select("id", "stats").mapInArrow(run, f"id {id_type}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) per row of docs: the calibrated probability of label 1, from statistics of the whole text alone.

    The statistics are computed once and written; texts are not read again. Cases: null and empty texts are scored like
    others; rows that repeat each get a row; an empty table gives no rows; without labels all scores are 0; other columns
    of docs are ignored.
    """
    stats = staged(statistics_table(docs, id_col, text_col), "statistics")
    return score_quality(stats, train_quality(stats, labels, folds, held_out, id_col=id_col, label_col=label_col))
