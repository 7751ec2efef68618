"""Cleaners that users plug in: Column functions and vectorised functions, named by each row in a chain of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from narrata.functions import text as X
from narrata.operators.batches import release_memory

#: Rows that vectorised cleaners get at once at most.
ROWS = 1000


class Cleaners:
    """Named cleaners. Those of the library's own chain are there from the start, under their functions' names.

    column() adds a function of a Column, which stays in the JVM; vectorised() one of a pandas Series of strings, which gets
    the rows that name it of up to ROWS at once. A name is taken once.
    """

    def __init__(self) -> None:
        own = (X.fix_spaced_capitals, X.fix_spaced_capitals_title, X.remove_footnote_markers, X.remove_footnotes, X.remove_footnotes_pdf, X.normalize_special_chars, X.normalize_special_chars_ext, X.remove_page_numbers, X.fix_hyphenation, X.collapse_spaces)
        self.in_jvm: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in own}
        self.in_python: dict[str, Callable[[pd.Series], pd.Series]] = {}

    def _free(self, name: str) -> None:
        if name in self.in_jvm or name in self.in_python:
            raise ValueError(f"there is a cleaner {name} already")

    def column(self, name: str, clean: Callable[[Column], Column]) -> Cleaners:
        self._free(name)
        self.in_jvm[name] = clean
        return self

    def vectorised(self, name: str, clean: Callable[[pd.Series], pd.Series]) -> Cleaners:
        self._free(name)
        self.in_python[name] = clean
        return self

    def _step(self, text: Column, name: Column) -> Column:
        """text cleaned by the JVM cleaner of the name; only that one is evaluated."""
        cases = reduce(lambda c, n: c.when(name == n, self.in_jvm[n](text)), self.in_jvm, F.when(F.lit(False), text))
        return cases.otherwise(F.raise_error(F.concat(F.lit("no such cleaner, or it stands between vectorised ones: "), F.coalesce(name, F.lit("null")))).cast("string"))

    def apply(self, text: Column, chain: Column) -> Column:
        """text after the cleaners that the row's chain (an array of names) lists, in order.

        A row goes to Python once at most, however many vectorised cleaners it names: those stand next to each other, with
        JVM cleaners before and after. Rows that name none send nothing to Python. A null chain or an empty one changes
        nothing; a null text stays null; a name that isn't known, null included, or vectorised cleaners apart are an error.
        """
        chain = F.coalesce(chain, F.array().cast("array<string>"))
        if not self.in_python:
            return F.aggregate(chain, text, lambda t, n: self._step(t, n))
        mine = list(self.in_python)
        marks = F.transform(chain, lambda n: F.coalesce(n.isin(mine), F.lit(False)))
        first = F.array_position(marks, F.lit(True))
        count = F.size(F.filter(marks, lambda m: m))
        ahead = F.when(first == 0, chain).otherwise(F.slice(chain, F.lit(1), F.greatest(first - 1, F.lit(0))))
        middle = F.when(first > 0, F.slice(chain, F.greatest(first, F.lit(1)), F.greatest(count, F.lit(0))))
        behind = F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(chain, F.greatest(first, F.lit(1)) + count, F.greatest(F.size(chain) - first - count + 1, F.lit(0))))
        before = F.aggregate(ahead, text, lambda t, n: self._step(t, n))
        passed = self._pass()(F.when(first > 0, before), middle)
        between = F.when(first > 0, passed).otherwise(before)
        return F.aggregate(behind, between, lambda t, n: self._step(t, n))

    def _pass(self) -> Callable[[Column, Column], Column]:
        """One vectorised function for all Python cleaners: each chain of a batch runs over its rows together."""
        cleaners = dict(self.in_python)

        def cleaned(texts: pd.Series, chains: pd.Series) -> pd.Series:
            out = texts.copy()
            named = chains.map(lambda c: () if c is None else tuple(c))
            for chain in named[texts.notna()].unique():
                unknown = [n for n in chain if n not in cleaners]
                if unknown:
                    raise ValueError(f"vectorised cleaners stand apart: {unknown[0]} is between them")
                rows = (named == chain) & texts.notna()
                out[rows] = reduce(lambda s, n: cleaners[n](s), chain, out[rows])
            return out

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, chains in parts:
                pieces = [cleaned(texts[i : i + ROWS], chains[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
                yield pd.concat(pieces) if pieces else texts
                del texts, chains, pieces
                release_memory()

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, StringType())
