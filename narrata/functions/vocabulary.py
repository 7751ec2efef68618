"""Token counts by a vocabulary: the longest entry at each place, as a measure for chunkers and for tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

END = ""


class Vocabulary:
    """A trie of entries. At each place of a text the longest entry that begins there is a token; a character that none begins
    with is a token of its own. Each place looks at no more characters than the longest entry has.

    The vocabulary goes to the tasks with the function that uses it, so its size is checked: `most` characters in all.
    """

    def __init__(self, entries: Iterable[str], most: int = 20_000_000):
        self.root: dict = {}
        size = 0
        for entry in entries:
            size += len(entry)
            if size > most:
                raise ValueError(f"the vocabulary has over {most} characters")
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            if entry:
                node[END] = True

    def ends(self, text: str) -> list[int]:
        """Where the tokens of the text end."""
        out, at, n = [], 0, len(text)
        while at < n:
            node, i, end = self.root, at, at + 1
            while i < n and (node := node.get(text[i])) is not None:
                i += 1
                if END in node:
                    end = i
            out.append(end)
            at = end
        return out

    def tokens(self, text: str) -> list[str]:
        ends = self.ends(text)
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def count(self, text: str) -> int:
        return len(self.ends(text))


def measured(text: Column, measure: Callable[[str], int]) -> Column:
    """The measure of each text in Arrow batches, that of an empty text for null; for example Vocabulary(...).count."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: measure(t or ""))

    return F.pandas_udf(run, LongType())(text)


def estimated_chunks(tokens: Column, limit: int) -> Column:
    """Chunks of up to `limit` tokens, one at least."""
    return F.greatest(F.lit(1), F.ceil(tokens / F.lit(limit))).cast("long")
