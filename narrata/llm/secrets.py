"""Secret scans by one minimal automaton of all rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.automaton import Dfa, Pattern, Scanner, compile_patterns, longest
from narrata.llm.common import releasing, slices, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match shorter than least is dropped; where head is given, what follows head is measured."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""
    ignore_case: bool = False


_ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The base kinds in their fixed order.
BASE_RULES = (
    Rule("assign", _ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", 6, _ASSIGN_HEAD, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further kinds by their public formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 24),
)
RULES = BASE_RULES + MORE_RULES


Walk = tuple[list[list[int]], list[int], int]


def _walk(dfa: Dfa) -> Walk:
    return dfa.by_byte(), dfa.accepts.tolist(), dfa.dead


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Scanner, Walk, list[Walk | None]]:
    """Built once in a worker: one automaton of all rules that finds where matches begin, one of all rules that tells from there
    how far they go, and those of the heads."""
    patterns = [Pattern(r.pattern, r.ignore_case) for r in rules]
    heads = [_walk(compile_patterns([Pattern(r.head, r.ignore_case)], anywhere=False)) if r.head else None for r in rules]
    return Scanner(compile_patterns(patterns, anywhere=True, reverse=True)), _walk(compile_patterns(patterns, anywhere=False)), heads


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, rule number, end) in code points, in order: leftmost-longest matches of each rule without
    overlap, short ones dropped.

    One pass of the combined automaton over the bytes gives all places where a match of any rule begins; only the bytes of
    the matches themselves are then read again to their ends.
    """
    scanner, whole, heads = compiled(rules)
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, (places, masks) in scanner.begins(coded).items():
        data, spans = coded[t], out[t]
        for k, rule in enumerate(rules):
            starts = places[masks >> k & 1 == 1]
            i = 0
            while i < len(starts):
                start = int(starts[i])
                end = longest(*whole, data, start, k)
                measured = longest(*heads[k], data, start) if heads[k] else start
                if end - measured >= rule.least:
                    spans.append((start, k, end))
                i = int(np.searchsorted(starts, end))
        if len(data) != len(texts[t]):
            leads = np.frombuffer(data, np.uint8) & 0xC0 != 0x80  # a code point has one byte that begins it
            at, before, count = {}, 0, 0
            for p in sorted({p for a, _, b in spans for p in (a, b)}):
                count += int(np.count_nonzero(leads[before:p]))
                at[p], before = count, p
            spans[:] = [(at[a], k, at[b]) for a, k, b in spans]
        spans.sort()
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) per row: all rules' matches by start, then in the rules' order.

    Starts and ends are code points, the end is exclusive. All rules are scanned in one pass over the bytes; only
    matches are then read again to their ends. Cases: a null text counts as an empty one; rows that repeat each
    get a row; an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in scan_texts(texts_of(batch, "text"), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each union of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the matches in the text masked; length_col, where given, gets the new length in code points.

    All rows and other columns stay as they are; texts without a match, null ones included, stay the same.
    """
    names = docs.columns

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            found = scan_texts(texts, rules)
            columns = dict(zip(names, batch.columns, strict=True))
            if any(found):
                old = columns[text_col].to_pylist()
                new = [masked(t, s, mask) if s else o for t, s, o in zip(texts, found, old, strict=True)]
                columns[text_col] = pa.array(new, pa.string())
                if length_col:
                    columns[length_col] = pa.array([len(n) if s else v for n, s, v in zip(new, found, columns[length_col].to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if length_col:
        typed = typed.withColumn(length_col, F.col(length_col).cast("long"))
    return typed.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in typed.schema]))
