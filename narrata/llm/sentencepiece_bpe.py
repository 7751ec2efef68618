"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SLICE_BYTES, releasing, slices, texts_of

SPACE = "▁"
#: Words kept by a worker in each of two generations, and the longest one kept.
KEPT_WORDS, KEPT_LENGTH = 120_000, 32
#: Widths of the tables in which short segments are merged side by side.
WIDTHS = (6, 9, 12, 16, 24, 40)
NEVER = np.int32(2**31 - 1)


class PieceTokenizer:
    """Encodes as the sentencepiece library does with a BPE model with byte fallback, identity normalisation and a dummy prefix.

    A text gets a leading space mark and its spaces become marks. No piece of such a model has a mark behind another
    character (this is verified), so no merge crosses the start of a run of marks, and a text's ids are those of its
    segments (a run of marks and what follows) one after the other.
    """

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain) or self.library.normalize("  x ") != f"{SPACE}{SPACE}{SPACE}x{SPACE}":
            raise ValueError(f"{model_file}: merges can cross words, or white space is normalised")
        self.ids = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: -self.library.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.raw = {i: b for b, i in self.bytes.items()}
        self.shown = {i: pieces[i].replace(SPACE, " ") for i in plain}
        self.digits = [str(i) for i in range(n)]
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self._pair_table()

    def _pair_table(self) -> None:
        """All pairs of symbols that merge, as a sorted table: key -> place in the agenda's order, and the merged id."""
        order = {score: i for i, score in enumerate(sorted(set(self.rank.values())))}
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[self.rank[piece]], i)
        keys = sorted(pairs)
        self.pair_key = np.array([*keys, 1 << 62], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), NEVER], np.int32)
        self.pair_id = np.array([*(pairs[k][1] for k in keys), -1], np.int32)
        self.symbol = np.full(0x110000, -2, np.int32)  # -2: a character that needs several byte pieces
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        for b in range(128):
            if self.symbol[b] == -2 and b in self.bytes:
                self.symbol[b] = self.bytes[b]

    def words(self, text: str) -> list[str]:
        """The text's segments, each without the mark that it begins with."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [s[1:] for s in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: an agenda of adjacent pairs gives the best score first, and of equal ones the leftmost."""
        if segment in self.ids and len(segment) <= 2:
            return [self.ids[segment]]
        parts: list[str | None] = list(segment)
        n, rank = len(parts), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, a + b) for i, (a, b) in enumerate(zip(segment, segment[1:], strict=False)) if (r := rank.get(a + b)) is not None]
        heapify(agenda)
        while agenda:
            _, i, joined = heappop(agenda)
            left = parts[i]
            if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != len(joined) or left + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(joined + parts[k])) is not None:
                    heappush(agenda, (r, i, joined + parts[k]))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + joined)) is not None:
                heappush(agenda, (r, h, parts[h] + joined))
        out = []
        for part in parts:
            if part is not None:
                if (found := self.ids.get(part)) is not None:
                    out.append(found)
                else:
                    out += [self.bytes[b] for b in part.encode()]
        return out

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """merge() of each segment. Each row of a table is a segment's agenda: every round takes each row's best pair."""
        out: list[list[int] | None] = [None] * len(segments)
        sized = np.array([len(s) for s in segments], np.int32)
        low = 0
        for width in WIDTHS:
            chosen = np.nonzero((sized > low) & (sized <= width))[0]
            low = width
            for start in range(0, len(chosen), 16384):
                self._merge_table(segments, chosen[start : start + 16384], sized, width, out)
        return [self.merge(s) if ids is None else ids for s, ids in zip(segments, out, strict=True)]

    def _merge_table(self, segments: list[str], chosen: np.ndarray, sized: np.ndarray, width: int, out: list) -> None:
        lengths = sized[chosen]
        points = np.frombuffer("".join([segments[i] for i in chosen]).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((len(chosen), width), -1, np.int32)
        symbols[inside] = self.symbol[points]
        simple = ~(symbols == -2).any(axis=1)
        chosen, lengths, symbols = chosen[simple], lengths[simple], symbols[simple]
        final = np.empty_like(symbols)
        at = np.arange(len(chosen))
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), symbols.shape).copy()
        before = after - 2
        ranks, merged = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while True:
            best = ranks.argmin(axis=1)
            rows = np.arange(len(best))
            live = ranks[rows, best] < NEVER
            if not live.all():
                final[at[~live]] = symbols[~live]
                at, lengths, symbols, after, before, ranks, merged, best = (x[live] for x in (at, lengths, symbols, after, before, ranks, merged, best))
                rows = rows[: len(best)]
            if not len(best):
                break
            right = after[rows, best]
            symbols[rows, best] = merged[rows, best]
            symbols[rows, right] = -1
            in_table = right < width - 1
            ranks[rows[in_table], right[in_table]] = NEVER
            nxt = after[rows, right]
            after[rows, best] = nxt
            has = nxt < lengths
            before[rows[has], nxt[has]] = best[has]
            ranks[rows[~has], np.minimum(best[~has], width - 2)] = NEVER
            for r, i, j in ((rows[has], best[has], nxt[has]), self._left(rows, best, before)):
                ranks[r, i], merged[r, i] = self._pairs(symbols[r, i], symbols[r, j])
        strips = final >= 0
        ends = np.cumsum(strips.sum(axis=1))
        flat = final[strips].tolist()
        start = 0
        for i, end in zip(chosen.tolist(), ends.tolist(), strict=True):
            out[i] = flat[start:end]
            start = end

    @staticmethod
    def _left(rows: np.ndarray, best: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = before[rows, best]
        has = h >= 0
        return rows[has], h[has], best[has]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -1
        i = np.searchsorted(self.pair_key, key)
        i[self.pair_key[i] != key] = len(self.pair_key) - 1
        return self.pair_rank[i], self.pair_id[i]

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of the ids: byte pieces in a row are read as UTF-8, and the leading space of the dummy prefix goes."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.raw.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.shown.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if start and text.startswith(" ") else text

    def of_words(self, wanted: set[str], check: bool) -> tuple[dict[str, str], dict[str, str]]:
        """word -> its ids joined by commas, for the words wanted, and of those whose ids decode to something else than a
        space and the word, word -> what they decode to; check: hold new ones against the library.

        A worker keeps words in two generations: a word that is met again moves to the young one, which becomes the old one
        when it is full, so frequent words stay. Words of the second kind aren't kept.
        """
        known, young, old = {}, self.young, self.old
        new = []
        for w in wanted:
            ids = young.get(w)
            if ids is None and (ids := old.get(w)) is not None:
                young[w] = ids
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        odd: dict[str, str] = {}
        for start in range(0, len(new), 32768):
            some = new[start : start + 32768]
            made = self.merge_all([SPACE + w for w in some])
            if check:
                expected = self.library.encode([w.replace(SPACE, " ") for w in some], num_threads=1)
                for w, ids, other in zip(some, made, expected, strict=True):
                    if w and ids != other:
                        raise ValueError(f"word {w!r}: {ids} here, {other} by the library")
            for w, ids in zip(some, made, strict=True):
                known[w] = joined = ",".join([self.digits[i] for i in ids])
                try:
                    text = "".join([self.shown[i] for i in ids])
                except KeyError:  # byte pieces
                    text = self.decode(ids, start=False)
                if text[0] != " " or text[1:] != w:
                    odd[w] = text
                elif len(w) <= KEPT_LENGTH:
                    young[w] = joined
            if len(young) > KEPT_WORDS:
                self.old, self.young = young, {}
                young, old = self.young, self.old
        return known, odd

    def forget(self) -> None:
        self.young, self.old = {}, {}


@lru_cache(maxsize=2)
def tokenizer(model_file: str) -> PieceTokenizer:
    return PieceTokenizer(model_file)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, outputs: tuple[str, ...] = ("ids", "decoded", "digests")) -> DataFrame:
    """(id, n_tokens[, ids array][, decoded][, ids_sha256, decoded_sha256]) per row, in one pass without a shuffle.

    Texts are handled in slices of a megabyte of an Arrow batch. The distinct words of a slice are merged and decoded once,
    a worker keeps a bounded number of them, and with check each newly merged one is held against the library; one that
    differs ends the job with a ValueError, as ids that aren't the library's would be wrong everywhere.
    model_file is read on the executors, so it must be at the same place there. Cases: a null text counts as an empty
    one, which has no ids; rows that repeat each get a row; an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = {"ids": [("ids", pa.list_(pa.int32()), "array<int>")], "decoded": [("decoded", pa.string(), "string")], "digests": [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]}
    chosen = [f for o in outputs for f in fields[o]]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(model_file)
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            texts = texts_of(batch, "text")
            split = [tool.words(t) for t in texts]
            known, odd = tool.of_words(set().union(*split), check)
            columns: dict[str, list] = {"n_tokens": [], **{name: [] for name, _, _ in chosen}}
            for text, words in zip(texts, split, strict=True):
                joined = ",".join([known[w] for w in words])
                columns["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                if odd and not odd.keys().isdisjoint(words):
                    text = "".join([odd.get(w, " " + w) for w in words])[1:]
                if "ids" in columns:
                    columns["ids"].append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                if "decoded" in columns:
                    columns["decoded"].append(text)
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            del known, split
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns["n_tokens"], pa.int64()), *(pa.array(columns[n], kind) for n, kind, _ in chosen)], names=["id", "n_tokens", *(n for n, _, _ in chosen)])
        tool.forget()  # a worker may go on to other work

    schema = ", ".join([f"id {id_type}", "n_tokens long", *(f"{n} {sql}" for n, _, sql in chosen)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
