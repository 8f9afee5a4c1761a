"""Similarity of symbol sequences by edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAX_SYMBOLS = 400


def edit_distance(a: list, b: list) -> int:
    """Unit-cost edit distance over whole symbols, a row of the table at a time."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    number = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([number[s] for s in a]), np.array([number[s] for s in b])
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, s in enumerate(x):
        low = np.minimum(row[1:] + 1, row[:-1] + (y != s))
        full = np.concatenate(([i + 1], low))
        # insertions run along the row: a running minimum of what is left of each place
        row = np.minimum.accumulate(full - steps) + steps
    return int(row[-1])


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - distance / longer length, over the first 400 symbols; 1 if both are empty, 0 if one is."""
    out = []
    for x, y in zip(a, b):
        x = [] if x is None else list(x[:MAX_SYMBOLS])
        y = [] if y is None else list(y[:MAX_SYMBOLS])
        top = max(len(x), len(y))
        out.append(1.0 if top == 0 else 1 - edit_distance(x, y) / top)
    return pd.Series(out)


def coded(seq: Column, symbols: list[str]) -> Column:
    """A sequence over a known, small set of symbols as a string, one code point for each symbol; null is a symbol too."""
    table = F.create_map(*[x for i, s in enumerate(symbols) if s is not None for x in (F.lit(s), F.lit(chr(0x4E00 + i)))])
    return F.array_join(F.transform(F.slice(seq, 1, MAX_SYMBOLS), lambda s: F.when(s.isNull(), chr(0x4DFF)).otherwise(table[s])), "")


def coded_similarity(a: Column, b: Column) -> Column:
    """The same similarity for coded sequences, on the JVM."""
    top = F.greatest(F.length(a), F.length(b))
    return F.when(top == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / top)
