"""Benchmark decontamination: latent semantic search for passages, and rare words of the items for what it dilutes, checked
by longest common subsequences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SLICE_BYTES, SUMS, new_name, partial_sum, releasing, slices, staged, texts_of, tree_sum

WORD = re.compile(r"[^\W_]+")
#: Words are hashed to this many columns of the term matrix.
TERMS = 1 << 15
#: A task that adds up passages should have this many words at least, so that its sum is small beside them.
TASK_WORDS = 6_000_000
#: A passage is two blocks of this many words, and starts at every block.
BLOCK = 16
#: Rows of a term that are added by a product of matrices if there are more.
FEW = 32
#: Numbers in a table of cosines whose candidates are checked together, and of those that are made at once.
COSINES, COSINES_IN_CACHE = 1 << 22, 1 << 18
#: Places in a table of which of the items' words some texts hold.
PRESENT = 1 << 25
#: Rows of candidates that are broadcast at most.
BROADCAST_ROWS = 100_000

#: Bytes that can belong to something else than a Latin letter, and ASCII without letters and digits as blanks.
_OTHER = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]")
_BLANKED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-case runs of letters and digits; texts of Latin letters alone take a shorter way to the same."""
    lower = text.lower()
    data = lower.encode("utf-8", "surrogatepass")
    if _OTHER.search(data):
        return [w.encode("utf-8", "surrogatepass") for w in WORD.findall(lower)]
    return data.translate(_BLANKED).split()


def column_of(word: bytes) -> int:
    return crc32(word) % TERMS


#: As _BLANKED with blanks as zeros, and capitals, of Latin letters beyond ASCII by their second bytes, as small letters.
_LOWERED = bytes((b + 32 if 0x80 <= b <= 0x9E or chr(b).isupper() and b < 128 else b) if b > 127 or chr(b).isalnum() else 0 for b in range(256))
_IS_OTHER = np.array([b == 0xC2 or b >= 0xC4 for b in range(256)])
#: Bytes of a word, from its end, whose shares of its CRC-32 are in tables.
HASHED = 64


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each pair of bytes and its place from a word's end their share of crc32 % TERMS, and for each length that of zeros:
    CRC-32 is linear but for a constant of the length."""
    zeros = np.array([crc32(bytes(n)) % TERMS for n in range(HASHED + 1)], np.int16)
    one = np.array([[crc32(bytes([b]) + bytes(k)) % TERMS for b in range(256)] for k in range(HASHED)], np.int16) ^ zeros[1:, None]
    return (one[::2, :, None] ^ one[1::2, None, :]).reshape(HASHED // 2, 1 << 16), zeros


_PAIRS, _ZEROS = _crc_tables()
#: What is left of the eight bytes before a word's end, of which the last is the highest, if so many are the word's.
_OWN = np.array([0, *((~0 << 8 * (8 - n)) & (1 << 64) - 1 for n in range(1, 9))], np.uint64)


def columns_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """column_of() for the words from starts to ends of data, which has eight bytes before the first word."""
    sizes = ends - starts
    out = _ZEROS[np.minimum(sizes, HASHED)]
    before = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    which, at, left = slice(None), ends, sizes
    for k in range(0, HASHED, 8):
        eight = (before[at - 8] & _OWN[np.minimum(left, 8)]).view(np.uint16).reshape(-1, 4)
        share = _PAIRS[k // 2][eight[:, 3]]
        for i in (1, 2, 3):
            share ^= _PAIRS[k // 2 + i][eight[:, 3 - i]]
        out[which] ^= share
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        which = more if k == 0 else which[more]
        at, left = at[more] - 8, left[more] - 8
    for i in np.flatnonzero(sizes > HASHED).tolist():
        out[i] = column_of(data[starts[i] : ends[i]])
    return out


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The columns of all words of the texts, one text after the other, and each text's number of words; as words_of(), but for
    all texts of Latin letters at once."""
    n = len(texts)
    raw = texts.fill_null("").cast(pa.large_binary())
    _, offsets, buffer = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + n + 1]
    data = bytes(8) + (buffer.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if buffer else b"")
    bounds = bounds - bounds[0] + 8
    given = np.frombuffer(data, np.uint8)
    other = _IS_OTHER[given]
    other[:-1] |= (given[:-1] == 0xC3) & ((given[1:] == 0x97) | (given[1:] == 0xB7))
    rows = np.unique(np.searchsorted(bounds, np.flatnonzero(other), side="right") - 1)
    data = data.translate(_LOWERED)
    inside = np.frombuffer(data, np.uint8) != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[:-1][np.diff(bounds) > 0]  # a text begins
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    flat, upto = columns_of(data, starts, ends), np.searchsorted(starts, bounds)
    sizes = np.diff(upto)
    if len(rows):
        parts, done = [], 0
        for i in rows.tolist():
            own = np.array([column_of(w) for w in words_of(texts[i].as_py())], np.int16)
            parts += [flat[done : upto[i]], own]
            done, sizes[i] = upto[i + 1], len(own)
        flat = np.concatenate([*parts, flat[done:]])
    return flat, sizes


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these numbers of words, one after the other: each word's block, each block's text, and whether the
    block after it is of the same text. A passage is a block and the next one of its text, if there is one."""
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    starts = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    of_word = np.repeat(np.cumsum(blocks) - blocks, sizes) + within // BLOCK
    return of_word, owner, np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.zeros(0, bool)


def block_terms(terms: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Each block's distinct terms, a row a block, with TERMS in the places that are left."""
    n = int(of_word[-1]) + 1 if len(of_word) else 0
    first = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]]) if n else np.zeros(0, int)
    table = np.full((n, BLOCK), TERMS, np.int32)
    table[of_word, np.arange(len(of_word)) - first[of_word]] = terms
    table.sort(axis=1)
    table[:, 1:][table[:, 1:] == table[:, :-1]] = TERMS
    return table


def block_sums(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums over each block of its terms' rows of values, whose last row is zero."""
    out = values[table[:, 0]]
    for k in range(1, BLOCK):
        out += values[table[:, k]]
    return out


def passage_sums(blocks: np.ndarray, paired: np.ndarray) -> np.ndarray:
    out = blocks.copy()
    i = np.flatnonzero(paired)
    out[i] += blocks[i + 1]
    return out


def term_sums(places: np.ndarray, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows `owner` of values by their places, a row a term."""
    n = np.bincount(places, minlength=TERMS)
    starts = np.cumsum(n) - n
    owner = owner[np.argsort(places.astype(np.int16), kind="stable")]
    out, ones = np.zeros((TERMS, values.shape[1]), np.float32), np.ones(int(n.max()), np.float32)
    for k in range(FEW):  # terms with few rows together
        t = np.flatnonzero((n > k) & (n <= FEW))
        out[t] += values[owner[starts[t] + k]]
    for t in np.flatnonzero(n > FEW).tolist():
        out[t] = ones[: n[t]] @ values[owner[starts[t] : starts[t] + n[t]]]
    return out


def padded(values: np.ndarray) -> np.ndarray:
    return np.vstack([values, np.zeros((1, values.shape[1]))]).astype(np.float32)


@dataclass
class LatentSpace:
    """idf of each column, and for each the coordinates of one occurrence in the space of the largest singular vectors."""

    idf: np.ndarray
    words: np.ndarray
    singular: np.ndarray

    def place(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of all passages of texts given by their terms; each passage's text and its block's number."""
        of_word, owner, paired = passages(sizes)
        z = passage_sums(block_sums(self.words, block_terms(terms, of_word)), paired)
        z /= np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        number = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        return z, owner, number


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a column of texts' terms, one text after the other, and each text's number of them."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(data, np.int16, len(data) // 2)[ends[0] : ends[-1]] if data and len(ends) else np.zeros(0, np.int16)
    return flat.astype(np.int64), np.diff(ends).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in pieces of about limit terms, one row at least."""
    for batch in batches:
        total = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(batch.schema.names.index(name))))) // 2
        start = 0
        while start < len(batch):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, text_hash) per row, null texts as empty ones."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def term_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n, terms) per row: the columns of the text's words in order, two bytes each, and their number."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            flat, sizes = terms_of(batch.column(1))
            offsets = (2 * np.r_[0, np.cumsum(sizes)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), packed], names=["id", "text_hash", "n", "terms"])

    return named_texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, text_hash long, n long, terms binary")


def _summed(terms: DataFrame, tasks: int, part: object) -> np.ndarray:
    """Sum over all rows of part(terms, sizes), an array of a fixed size; each of the tasks adds up its rows first."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _pieces(batches, "terms", 200_000):
            flat, sizes = _arrays(batch.column(0))
            if len(flat):
                x = part(flat, sizes).ravel()
                if total is None:
                    total = np.zeros(len(x))
                total += x
        if total is not None:
            yield partial_sum(total, np.float32)

    return tree_sum(terms.select("terms").coalesce(tasks).mapInArrow(run, SUMS), kind=np.float32)


def latent_space(terms: DataFrame, rank: int = 72, extra: int = 8, skip: int = 8, seed: int = 5) -> LatentSpace | None:
    """Randomised singular value decomposition of the TF-IDF matrix of all passages of all rows; None if there are none.

    With A the unit rows of the passages by terms and a random start W, one pass sums a'(aW) over the
    passages a. From this sketch Y of A'A the strongest right singular vectors and values follow by the Nystroem formula
    Y (W'Y)^-1 Y'. Each task adds up its passages to one matrix of terms by rank, so what is sent depends on neither
    rows nor words. Coordinates are divided by the singular values, and the first `skip` left out, so that what most
    passages share counts for little.
    """

    words = terms.agg(F.sum("n")).first()[0]
    if not words:
        return None
    tasks = -(-words // TASK_WORDS)

    def frequencies(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        table = block_terms(flat, passages(sizes)[0])
        return np.r_[np.bincount(table.ravel(), minlength=TERMS + 1)[:TERMS], len(table)].astype(np.float64)

    counts = _summed(terms, tasks, frequencies)
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1

    def product(start: np.ndarray) -> np.ndarray:
        weighted, squares = padded(start * idf[:, None]), padded((idf * idf)[:, None])

        def part(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            of_word, _, paired = passages(sizes)
            table = block_terms(flat, of_word)
            z = passage_sums(block_sums(weighted, table), paired)  # aW of the passage that starts at each block
            z /= np.maximum(passage_sums(block_sums(squares, table), paired), 1e-9)  # both factors a as unit rows
            i = np.flatnonzero(paired)
            around = z.copy()
            around[i + 1] += z[i]  # a block's words are in its own passage and in the one before
            owner, slot = np.nonzero(table < TERMS)
            return term_sums(table[owner, slot], owner, around)

        return _summed(terms, tasks, part).reshape(TERMS, -1) * idf[:, None]

    start = np.random.default_rng(seed).normal(size=(TERMS, rank + extra)) / np.sqrt(TERMS)
    sketch = product(start)
    middle = start.T @ sketch
    weights, axes = np.linalg.eigh((middle + middle.T) / 2)
    sound = weights > 1e-6 * weights.max()  # few different passages have a lower rank
    half = sketch @ (axes[:, sound] / np.sqrt(weights[sound]))
    values, turn = np.linalg.eigh(half.T @ half)
    best = np.argsort(-values)[:rank]
    singular = np.sqrt(np.maximum(values[best], 1e-9 * values.max()))
    vectors = half @ turn[:, best] / singular
    first = skip if len(singular) > 2 * skip else 0
    return LatentSpace(idf, padded((vectors * idf[:, None] * (singular[0] / singular))[:, first:]), singular)


def places_of(a: list) -> dict:
    """For each value of a an integer with a bit for each of its places."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_length(m: int, hits: list[int]) -> int:
    """Length of the longest common subsequence of m items and others, of which those that are among the m are given by
    their bits of places_of()."""
    row = full = (1 << m) - 1
    for h in hits:
        hit = row & h
        row = (row + hit | row - hit) & full
    return m - row.bit_count()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit of an integer for each item of a."""
    masks = places_of(a)
    return common_length(len(a), [masks[y] for y in b if y in masks])


@dataclass
class Item:
    """An item's words in order, as words or as their columns."""

    item_id: int
    terms: list

    def __post_init__(self) -> None:
        self.masks = places_of(self.terms)

    def found_in(self, region: list, least: float, answer_least: float) -> float:
        """The share of the item's words that the region has in order, or 0.

        `least` of all words must be there, and of its answer, the closing fifth of the item, `answer_least`; a short
        item needs all its words.
        """
        m, masks = len(self.terms), self.masks
        at = [i for i, y in enumerate(region) if y in masks]
        here = set([region[i] for i in at])
        if sum([masks[x].bit_count() for x in here]) < least * m:
            return 0.0
        hits = [masks[region[i]] for i in at]
        share = common_length(m, hits) / m
        if share < (least if m >= 8 else 1.0):
            return 0.0
        # the tightest stretch of a bit over the item's length, so that words strewn over the region don't count
        room = m + max(2, m // 8)
        starts = list(range(0, max(1, len(region) - room + 1), max(1, m // 8)))
        if len(region) > room:
            starts.append(len(region) - room)
        best, k = 0, 0
        for start in starts:
            low, high = bisect_left(at, start), bisect_left(at, start + room)
            if high - low > best and (got := common_length(m, hits[low:high])) > best:
                best, k = got, start
        if best / m < (least if m >= 8 else 1.0):
            return 0.0
        answer = self.terms[-max(3, m // 5) :]
        if common_subsequence(answer, region[k : k + room]) < answer_least * len(answer):
            return 0.0
        return best / m


def words_needed(m: int, least: float) -> int:
    """How many words of an item of m words must be there in order."""
    return m if m < 8 else next(n for n in range(m + 1) if n / m >= least)


class Hopeful:
    """Which pairs of a text and an item can count: without `least` of the item's words a text has no such subsequence."""

    def __init__(self, items: list[Item], least: float) -> None:
        self.n = np.array([len(i.terms) for i in items])
        self.first, self.needed = np.cumsum(self.n) - self.n, least * self.n
        columns, self.terms = np.unique(np.array([x for i in items for x in i.terms], np.int64), return_inverse=True)
        self.slot = np.full(TERMS, len(columns))
        self.slot[columns] = np.arange(len(columns))
        self.columns = len(columns)
        self.at_once = max(1, PRESENT // (self.columns + 1))

    def __call__(self, text: np.ndarray, item: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each pair, of which the texts are in order, whether it can count."""
        pairs, back = np.unique(text * len(self.n) + item, return_inverse=True)
        out, starts = np.zeros(len(pairs), bool), np.cumsum(sizes) - sizes
        for a in range(0, len(pairs), self.at_once):
            t, i = np.divmod(pairs[a : a + self.at_once], len(self.n))
            row = np.r_[0, np.cumsum(t[1:] != t[:-1])]
            own = np.full(t[-1] - t[0] + 1, -1)
            own[t - t[0]] = row
            word_row = np.repeat(own, sizes[t[0] : t[-1] + 1])
            words = np.flatnonzero(word_row >= 0)
            present = np.zeros((row[-1] + 1, self.columns + 1), bool)
            present[word_row[words], self.slot[flat[starts[t[0]] + words]]] = True
            n = self.n[i]
            upto = np.cumsum(n)
            held = present[np.repeat(row, n), self.terms[np.repeat(self.first[i] - (upto - n), n) + np.arange(upto[-1])]]
            out[a : a + len(t)] = np.add.reduceat(held, upto - n, dtype=np.int64) >= self.needed[i]
        return out[back]


class Anchors:
    """The rarer half of each item's words, by term: a stretch that has all but `missing` of an item's words has all but that
    many of these, so no stretch that counts is without them, however short the item is."""

    def __init__(self, items: list[Item], idf: np.ndarray, least: float) -> None:
        pairs = []
        self.needed, self.room = np.ones(len(items), np.int64), np.ones(len(items), np.int64)
        for i, item in enumerate(items):
            m = len(item.terms)
            missing = m - words_needed(m, least)
            rare = sorted(item.terms, key=lambda x: -idf[x])[: max(-(-m // 2), missing + 1)]
            self.needed[i], self.room[i] = len(rare) - missing, m + max(2, m // 8)
            pairs += [(x, i) for x in set(rare)]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items = table[:, 1]
        self.starts = np.searchsorted(table[:, 0], np.arange(TERMS + 1))

    def places(self, terms: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to) for the stretches of the texts that hold enough of an item's anchors closely enough, with
        an item's room around; the places count from the start of all texts."""
        n = np.diff(self.starts)[terms]
        at = np.repeat(np.arange(len(terms)), n)
        item = self.items[np.repeat(self.starts[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        text = np.repeat(np.arange(len(sizes)), sizes)[at]
        order = np.argsort(item, kind="stable")  # the places of an item stay in order, and so do its texts
        at, item, text = at[order], item[order], text[order]
        last = np.arange(len(at)) + self.needed[item] - 1
        fits = last < len(at)
        end = np.where(fits, last, 0)
        i = np.flatnonzero(fits & (item[end] == item) & (text[end] == text) & (at[end] - at < self.room[item]))
        if not len(i):
            return
        first, stop, item, text = at[i], at[end[i]], item[i], text[i]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (first[1:] - stop[:-1] > self.room[item[1:]])])
        close = np.r_[new[1:], len(i)] - 1
        ends = np.cumsum(sizes)
        room = self.room[item[new]]
        low = np.maximum(ends[text[new]] - sizes[text[new]], first[new] - room)
        high = np.minimum(ends[text[new]], stop[close] + room + 1)
        yield from zip(text[new].tolist(), item[new].tolist(), low.tolist(), high.tolist(), strict=True)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, least: float = 0.7, answer_least: float = 0.5, rank: int = 72, items_at_once: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, similarity, cosine) for each row of docs and benchmark item whose passage it holds.

    A latent space is fitted on all passages of all documents. Every passage is compared with every passage of the
    items there; pairs of a cosine of at least `cosine` are candidates. A passage of 32 words dilutes a short or changed
    item, so stretches with enough of an item's rarer words are candidates as well, whatever their cosine: `Anchors` leaves
    out none that can count. A candidate counts if the longest common subsequence has `least` of the item's words and
    `answer_least` of its closing words; similarity is that share. This is first checked on the words' columns, where it can
    only come out too high, as some words share one, and then on the words themselves of the texts that are left.
    Case, punctuation and marks around words don't matter. The items go in groups of items_at_once, so what a task and the
    driver hold of them is bounded, and a larger benchmark takes more passes over the terms.

    Cases: null and empty texts hold nothing; an item without words matches nothing; rows that repeat an id give their
    rows each; items with equal texts are each reported; empty tables give no rows; other columns are ignored.
    """
    return _leaks(docs, benchmark, cosine, least, answer_least, rank, items_at_once, id_col, text_col, item_col, item_text_col).select("id", "item_id", "similarity", "cosine")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, least: float = 0.7, answer_least: float = 0.5, rank: int = 72, items_at_once: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with all their columns.

    Rows are told apart by id and text, so a row that shares its id, or a missing one, with a row that goes stays.
    """
    found = staged(_leaks(docs, benchmark, cosine, least, answer_least, rank, items_at_once, id_col, text_col, item_col, item_text_col).select("id", "text_hash").distinct(), "leaked")
    digest = new_name(docs, "text_hash")
    named = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return named.join(found, named[id_col].eqNullSafe(found["id"]) & (named[digest] == found["text_hash"]), "left_anti").drop(digest)


def _leaks(docs: DataFrame, benchmark: DataFrame, cosine: float, least: float, answer_least: float, rank: int, items_at_once: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, text_hash long, item_id long, similarity double, cosine double"
    out = empty = docs.sparkSession.createDataFrame([], schema)
    terms = staged(term_table(docs, id_col, text_col), "terms")
    space = latent_space(terms, rank)
    if space is None:
        return empty
    wanted = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    groups = -(-max(1, wanted.count()) // items_at_once)
    wanted = wanted.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    texts = named_texts(docs, id_col, text_col)
    for group in range(groups):
        rows = wanted.where(F.col("group") == group).select("item_id", "text").collect()  # about items_at_once rows
        items = [i for r in rows if (i := Item(r.item_id, words_of(r.text))).terms]
        if not items:
            continue
        places = terms.select("id", "text_hash", "terms").mapInArrow(_search(space, items, cosine, least, answer_least), f"id {id_type}, text_hash long, {PLACES}")
        places = staged(places.dropDuplicates(["id", "text_hash"]).withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"}), "places")
        few = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        met = texts.join(few, texts["id"].eqNullSafe(places["of_id"]) & (texts["text_hash"] == places["of_hash"]))
        checked = met.select("id", "text_hash", "text", "places").mapInArrow(_check(items, least, answer_least), schema)
        out = out.union(checked if groups == 1 else staged(checked, "leaks"))
    return out


#: Stretches of a text, from word to word, that may hold an item, which is given by its place in its group.
PLACES = "places array<struct<item:int,low:int,high:int,cosine:double>>"


def _search(space: LatentSpace, items: list[Item], cosine: float, least: float, answer_least: float) -> Callable:
    by_column = [Item(i.item_id, [column_of(w) for w in i.terms]) for i in items]
    vectors, owner, _ = space.place(np.array([x for i in by_column for x in i.terms], np.int64), np.array([len(i.terms) for i in items], np.int64))
    transposed = np.ascontiguousarray(vectors.T)
    anchors, hopeful = Anchors(by_column, space.idf, least), Hopeful(by_column, least)
    of_item = np.searchsorted(owner, np.arange(len(items) + 1))
    rows_at_once, rows_in_cache = (max(16, n // len(vectors)) for n in (COSINES, COSINES_IN_CACHE))
    kind = pa.list_(pa.struct([("item", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("cosine", pa.float64())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "terms", 200_000):
            flat, sizes = _arrays(batch.column(2))
            z, text, number = space.place(flat, sizes)
            ends = np.cumsum(sizes)
            offered: dict[tuple[int, int, int, int], float] = {}  # text, item, from, to -> cosine
            for start in range(0, len(z), rows_at_once):
                places, values = [], []
                for low in range(start, min(len(z), start + rows_at_once), rows_in_cache):
                    near = (z[low : min(start + rows_at_once, low + rows_in_cache)] @ transposed).ravel()
                    places.append(np.flatnonzero(near >= cosine))
                    values.append(near[places[-1]])
                    places[-1] += (low - start) * len(vectors)
                at, col = np.divmod(np.concatenate(places), len(vectors))
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[col[1:]] != owner[col[:-1]])]) if len(at) else at
                passage, item, near = at[new] + start, owner[col[new]], np.concatenate(values)[new]
                can = np.flatnonzero(hopeful(text[passage], item, flat, sizes))
                for p, i, c in zip(passage[can].tolist(), item[can].tolist(), near[can].tolist(), strict=True):
                    t = int(text[p])
                    low, m = int(number[p]) * BLOCK, len(items[i].terms)
                    base = int(ends[t] - sizes[t])
                    offered[t, i, base + max(0, low - m), min(int(ends[t]), base + low + 2 * BLOCK + m)] = c
            first = np.searchsorted(text, np.arange(len(sizes)))
            for t, i, low, high in anchors.places(flat, sizes):
                if (t, i, low, high) not in offered:
                    base = ends[t] - sizes[t]
                    here = z[first[t] + (low - base) // BLOCK : first[t] + (high - 1 - base) // BLOCK + 1]
                    offered[t, i, low, high] = float((here @ vectors[of_item[i] : of_item[i + 1]].T).max())
            found: dict[int, list[dict]] = {}
            for (t, i, low, high), c in sorted(offered.items()):
                if by_column[i].found_in(flat[low:high].tolist(), least, answer_least):
                    base = int(ends[t] - sizes[t])
                    found.setdefault(t, []).append({"item": i, "low": low - base, "high": high - base, "cosine": c})
            which = pa.array(list(found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(list(found.values()), kind)], names=["id", "text_hash", "places"])

    return run


def _check(items: list[Item], least: float, answer_least: float) -> Callable:
    """The items that the places of a text hold, by the words themselves."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            rows, held, shares, cosines = [], [], [], []
            for row, (text, places) in enumerate(zip(texts_of(batch, "text"), batch.column(3).to_pylist(), strict=True)):
                words = words_of(text)
                best: dict[int, tuple[float, float]] = {}
                for p in places:
                    share = items[p["item"]].found_in(words[p["low"] : p["high"]], least, answer_least)
                    if share > best.get(p["item"], (0.0, 0.0))[0]:
                        best[p["item"]] = (share, p["cosine"])
                for i, (share, c) in sorted(best.items()):
                    rows.append(row)
                    held.append(items[i].item_id)
                    shares.append(share)
                    cosines.append(c)
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(held, pa.int64()), pa.array(shares, pa.float64()), pa.array(cosines, pa.float64())], names=["id", "text_hash", "item_id", "similarity", "cosine"])

    return run
