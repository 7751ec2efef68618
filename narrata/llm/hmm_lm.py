"""A hidden Markov language model: counts of all training words, Baum-Welch over all training texts, exact forward scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import discard, hashed_fold, partial_sum, releasing, slices, staged, tree_sum

#: States emit the end, which is column 0, or one of so many classes of words, which the words' hashes name.
CLASSES = (1 << 16) - 1
#: Text bytes whose words are numbered together, and words of one of their rows.
PART_BYTES = 32_000_000
WORDS_A_ROW = 1 << 16
#: Tokens of a training sequence; longer texts are cut, and a piece that doesn't begin its text starts as states are spread.
PIECE = 256
#: Longer texts are scored by pieces of PIECE tokens, each from all states, which are then composed.
LONG = 4096
#: Tokens that one step of the recursions works on.
AT_ONCE = 400_000
#: A task of a Baum-Welch round should have this many, so that its sums are small beside them.
TASK_TOKENS = 6_000_000
#: Tokens that, spread as states are, count beside a column's own, so that rare words don't settle in one state.
PRIOR = 4.0


@dataclass(frozen=True)
class Hmm:
    """Start, transition and emission probabilities; `emit` has a row for each column of symbols. spread: how often states are taken."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    spread: np.ndarray


def coded(docs: DataFrame, folds: int, held_out: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (part, id, held, codes) and of words (part, first, hi, lo, times).

    Each part is some PART_BYTES of texts whose distinct words are numbered; codes are those numbers (int32) in the order of
    the text. A row of words has 96 bits of the hashes of those from number `first` on, and how often training texts hold them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), (hashed_fold(F.col(id_col), folds) == held_out).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = f"part long, id {id_type}, held boolean, codes binary, first int, hi binary, lo binary, times binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def rows_of(part: int, ids: list[pa.Array], held: np.ndarray, lengths: np.ndarray, chunks: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array(chunks, pa.string()).dictionary_encode()
        dictionary = words.chunk(0).dictionary if words.num_chunks else pa.array([], pa.string())
        codes = np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.indices, np.int32) for c in words.chunks)])
        ends = np.cumsum(lengths)
        flat = [codes[e - n : e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
        m = len(lengths)
        ids = pa.concat_arrays(ids)
        no = pa.nulls(m, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), ids, pa.array(held), pa.array(flat, pa.binary()), pa.nulls(m, pa.int32()), no, no, no], names=names)
        times = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(dictionary)).astype(np.int32)
        for first in range(0, len(dictionary), WORDS_A_ROW):
            raw = b"".join([xxhash.xxh3_128_digest(w) for w in dictionary[first : first + WORDS_A_ROW].to_pylist()])
            both = np.frombuffer(raw, np.dtype([("hi", ">i8"), ("lo", ">i4"), ("rest", ">i4")]))
            some = [pa.array([x.tobytes()], pa.binary()) for x in (both["hi"].astype(np.int64), both["lo"].astype(np.int32), times[first : first + WORDS_A_ROW])]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([first], pa.int32()), *some], names=names)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 24, 0
        kept: tuple[list, list, list, list] = ([], [], [], [])
        for batch in slices(batches, "text"):
            text = batch.column(2)
            split = pc.ascii_split_whitespace(pc.ascii_lower(text))
            flat = split.flatten()
            full = pc.not_equal(flat, "")
            before = np.concatenate([[0], np.cumsum(np.asarray(full))])
            offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
            for one, value in zip(kept, (batch.column(0), np.asarray(batch.column(1)), np.diff(before[offsets]), flat.filter(full)), strict=True):
                one.append(value)
            size += text.nbytes
            if size >= PART_BYTES:
                yield from rows_of(part, kept[0], np.concatenate(kept[1]), np.concatenate(kept[2]), kept[3])
                part, size, kept = part + 1, 0, ([], [], [], [])
        if kept[0]:
            yield from rows_of(part, kept[0], np.concatenate(kept[1]), np.concatenate(kept[2]), kept[3])

    return given.mapInArrow(run, kinds)


def _word_rows(words: DataFrame) -> DataFrame:
    """(part, code, hi, lo, class, times), a row a word of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hi, lo, times = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int32, np.int32), strict=True))
                m = len(hi)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), pa.array(np.arange(first, first + m, dtype=np.int32)), pa.array(hi), pa.array(lo), pa.array((hi % CLASSES).astype(np.int32)), pa.array(times)], names=["part", "code", "hi", "lo", "class", "times"])

    return words.select("part", "first", "hi", "lo", "times").mapInArrow(run, "part long, code int, hi long, lo int, class int, times int")


# The recursions. Sequences are pieces of one flat array of columns, given by their starts and lengths, longest first, so that
# those which are still going on at a step are the first ones, and each step is a few products of matrices.


def _ordered(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return order, starts[order], lengths[order]


def _going_on(lengths: np.ndarray) -> np.ndarray:
    """How many of the sequences, longest first, have a token at each step."""
    return len(lengths) - np.cumsum(np.bincount(lengths, minlength=int(lengths[0]) + 1))[: int(lengths[0])]


def forward(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, model: Hmm, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the likelihoods of the sequences, and the states after them (sums of one).

    first has a row for each sequence: the states of its first token, or with `before` those of the token before it.
    """
    order, at, lengths = _ordered(starts, lengths)
    total, states = np.zeros(len(at)), first[order].copy()
    for t, m in enumerate(_going_on(lengths) if len(at) else []):
        a = states[:m] @ model.move if t or before else states[:m]
        a *= model.emit[flat[at[:m] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        states[:m] = a
        total[:m] += np.log(s)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return total[back], states[back]


def likelihoods(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Hmm) -> np.ndarray:
    """Natural logarithm of each sequence's likelihood by the scaled forward recursion; long ones by pieces, exactly.

    A piece is run from each state; what it makes of a state is a row of a matrix, and these are multiplied in order.
    """
    k = len(model.start)
    out = np.zeros(len(starts))
    short = lengths <= LONG
    out[short], _ = forward(flat, starts[short], lengths[short], np.broadcast_to(model.start, (int(short.sum()), k)), model, False)
    for i in np.flatnonzero(~short):
        cuts = np.arange(0, lengths[i], PIECE)
        sizes = np.minimum(PIECE, lengths[i] - cuts)
        total, v = forward(flat, starts[i : i + 1], sizes[:1], model.start[None, :], model, False)
        total, v = float(total[0]), v[0]
        for some in np.array_split(np.arange(1, len(cuts)), max(1, len(cuts) * PIECE * k // (4 * AT_ONCE))):
            logs, rows = forward(flat, np.repeat(starts[i] + cuts[some], k), np.repeat(sizes[some], k), np.tile(np.eye(k), (len(some), 1)), model, True)
            logs, rows = logs.reshape(-1, k), rows.reshape(-1, k, k)
            for log, row in zip(logs, rows, strict=True):
                top = log.max()
                v = (v * np.exp(log - top)) @ row
                s = v.sum()
                v, total = v / s, total + top + np.log(s)
        out[i] = total
    return out


def expected(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of one Baum-Welch round over the sequences: emissions (columns x states), moves, starts of texts, and the
    natural logarithm of the likelihood. begins: which sequences begin a text."""
    order, at, lengths = _ordered(starts, lengths)
    going, k = _going_on(lengths), len(model.start)
    places = np.cumsum(going) - going  # tokens lie step by step
    where = flat[np.concatenate([at[:m] + t for t, m in enumerate(going)])]
    emits = model.emit[where]
    alphas, sums, ones, back = np.empty_like(emits), np.empty(len(where)), np.ones(k), np.ascontiguousarray(model.move.T)
    for t, m in enumerate(going):
        now = slice(places[t], places[t] + m)
        a, e = alphas[now], emits[now]
        if t:
            np.matmul(alphas[places[t - 1] : places[t - 1] + m], model.move, out=a)
        else:
            a[:] = np.where(begins[order][:, None], model.start, model.spread)
        a *= e
        s = np.matmul(a, ones, out=sums[now])[:, None]
        a /= s
        e /= s
    moves, counts = np.zeros((k, k)), np.zeros((len(model.emit), k))
    beta = np.ones((0, k))  # of the sequences that go on; ones for the others
    for t in range(len(going) - 1, -1, -1):
        now = slice(places[t], places[t] + going[t])
        ahead = emits[now]
        ahead[: len(beta)] *= beta
        alphas[now][: len(beta)] *= beta  # from here on these are the shares of states
        if t:
            moves += alphas[places[t - 1] : places[t - 1] + going[t]].T @ ahead
            beta = ahead @ back
    for s in range(k):
        counts[:, s] = np.bincount(where, alphas[:, s], minlength=len(counts))
    return counts, moves * model.move, alphas[: going[0]][begins[order]].sum(axis=0), float(np.log(sums).sum())


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and whether they begin a text, of the pieces of texts that follow each other in one array."""
    n = -(-lengths // PIECE)
    text = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[text] + number * PIECE, np.minimum(PIECE, lengths[text] - number * PIECE), number == 0


def _round(texts: list[np.ndarray], model: Hmm) -> np.ndarray:
    """The expected counts of the texts as one array."""
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    starts, sizes, begins = _pieces(lengths)
    counts, moves, first, total = expected(flat, starts, sizes, begins, model)
    return np.concatenate([counts.ravel(), moves.ravel(), first, [total]])


def _refitted(sums: np.ndarray, k: int, usual: np.ndarray) -> Hmm:
    """The model whose probabilities are the expected counts' shares; each column is taken as often as usual, and its shares of
    states count PRIOR tokens that are spread as the states are."""
    columns = len(usual)
    counts, moves, first = sums[: columns * k].reshape(columns, k), sums[columns * k : columns * k + k * k].reshape(k, k), sums[-k - 1 : -1]
    spread = (counts.sum(axis=0) + 1) / (counts.sum() + k)
    emit = usual[:, None] * (counts + PRIOR * spread) / (counts.sum(axis=1, keepdims=True) + PRIOR)
    return Hmm((first + 1) / (first.sum() + k), (moves + 1) / (moves.sum(axis=1, keepdims=True) + k), emit / emit.sum(axis=0), spread)


def _grouped(texts: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
    """Texts' columns in groups of about AT_ONCE tokens."""
    group, size = [], 0
    for raw in texts:
        x = np.frombuffer(raw, np.uint16)
        group.append(x)
        size += len(x)
        if size >= AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def hmm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, states: int = 6, rounds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. Texts whose crc32(id) modulo folds isn't
    held_out train. base_score is that of single words, log10 of (c + 0.5) / (N + 0.5 (V + 1)). score is log10 of the
    likelihood under the hidden Markov model: a state emits the end or one of CLASSES classes of words, in which a word has the
    share (c + 0.5) / (N_class + 0.5 (V_class + 1)). Words meet their counts by parts of the corpus: a word has a row for each
    part that holds it, however often, so neither a vocabulary is held whole nor is a frequent word a large group.
    All `rounds` Baum-Welch rounds go over all training texts. Cases: null and empty texts are one end; a
    null id counts as the empty text in the fold; rows that repeat an id each get a row; without training texts all words
    are unknown alike; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = staged(coded(docs, folds, held_out, id_col, text_col), "coded")
    texts = parts.where("codes IS NOT NULL")
    ends = texts.where("NOT held").count()
    of_word = Window.partitionBy("hi", "lo")
    counted = _word_rows(parts.where("hi IS NOT NULL")).withColumn("c", F.sum("times").over(of_word)).withColumn("first", F.row_number().over(of_word.orderBy("part")) == 1)
    words = staged(counted.select("part", "code", "class", "c", "first"), "words")
    classes = words.where("first AND c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows at most
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_n[r["class"]], class_v[r["class"]] = r.n, r.v
    n, v = sum(r.n for r in classes) + ends, sum(r.v for r in classes) + (ends > 0)
    usual = np.concatenate([[ends], class_n]) + 0.5
    usual /= usual.sum()
    below, end_base = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(ends + 0.5))
    # the end is the only token of its column
    class_below = np.concatenate([[0.0], np.log10(class_n + 0.5 * (class_v + 1))])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        """The part's documents with the sums over their words, and the columns that the model sees."""
        code, c = np.asarray(right["code"]), np.asarray(right["c"])
        logs, column, known = np.zeros(len(code)), np.zeros(len(code), np.uint16), np.zeros(len(code), np.int64)
        logs[code], known[code], column[code] = np.log10(c + 0.5), c > 0, np.asarray(right["class"]) + 1
        rows: list[list] = [[], [], [], []]
        for raw in left["codes"]:
            x = np.frombuffer(raw.as_buffer(), np.int32)
            values = len(x) + 1, int(known[x].sum()) + (ends > 0), float(logs[x].sum()), np.append(column[x], np.uint16(0)).tobytes()
            for r, value in zip(rows, values, strict=True):
                r.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
        return pa.table([left["id"], left["held"], *(pa.array(r, t) for r, t in zip(rows, kinds, strict=True))], names=["id", "held", "n_tokens", "n_known", "logs", "columns"])

    held = texts.select("part", "id", "held", "codes").groupBy("part")
    rows = held.cogroup(words.select("part", "code", "class", "c").groupBy("part")).applyInArrow(met, f"id {id_type}, held boolean, n_tokens long, n_known long, logs double, columns binary")
    rows = staged(rows, "columns")
    discard(parts, words)

    train = rows.where("NOT held")
    model = _start(states, usual) if ends else Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(usual[:, None], states, axis=1), np.full(states, 1 / states))
    for _ in range(rounds if ends else 0):
        model = _refitted(_all_counts(train.select("columns").coalesce(-(-n // TASK_TOKENS)), model, len(usual) * states + states * states + states + 1), states, usual)

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, inner = [], []
            for group in _grouped(v.as_buffer() for v in batch.column(5)):
                lengths = np.array([len(x) for x in group])
                flat = np.concatenate(group)
                found.append(likelihoods(flat, np.cumsum(lengths) - lengths, lengths, model))
                inner.append(np.add.reduceat(class_below[flat], np.cumsum(lengths) - lengths))
            logs, tokens = np.asarray(batch.column(4)), np.asarray(batch.column(2))
            model_log, inner_log = (np.concatenate([np.zeros(0), *x]) for x in (found, inner))
            scores = pa.array(logs + end_base - tokens * below), pa.array(model_log / np.log(10) + logs - inner_log)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *scores], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = rows.mapInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _start(k: int, usual: np.ndarray) -> Hmm:
    """States that mostly stay and emit as usual, but for fixed noise that tells them apart; with more noise the first rounds
    gain less."""
    noise = np.exp(0.5 * np.random.default_rng(k).normal(size=(len(usual), k)))
    emit = usual[:, None] * noise
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    return Hmm(np.full(k, 1 / k), move, emit / emit.sum(axis=0), np.full(k, 1 / k))


def _all_counts(train: DataFrame, model: Hmm, width: int) -> np.ndarray:
    """Expected counts over all rows, summed by tasks and then by levels."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for group in _grouped(v.as_buffer() for v in batch.column(0)):
                total += _round(group, model)
        yield partial_sum(total, np.float32)

    return tree_sum(train.mapInArrow(run, "place long, block int, part binary"), kind=np.float32)
