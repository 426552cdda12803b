"""Global alignment of two residue sequences, one pair of strings per row."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: substitution scores, lower triangle in the order of LETTERS, and the gap
GAP = -10
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
UNKNOWN_SCORE = -1


def _scores() -> np.ndarray:
    table = np.full((len(LETTERS) + 1, len(LETTERS) + 1), UNKNOWN_SCORE, dtype=np.int64)
    for i, line in enumerate(BLOSUM62.strip().splitlines()):
        row = [int(v) for v in line.split()]
        table[i, : i + 1] = row
        table[: i + 1, i] = row
    return table


_TABLE = _scores()
_CODES = np.full(256, len(LETTERS), dtype=np.int64)
for _i, _letter in enumerate(LETTERS):
    _CODES[ord(_letter)] = _i


def match_positions(a: str, b: str) -> list[tuple[int, int]]:
    """Positions aligned with each other; end gaps are free, inner gaps cost GAP each.

    Rows of the score table are filled in order; along a row the best run of
    gaps is a running maximum, so each row is a few array operations. Only every
    root-of-n-th row is kept; on the way back the moves of one stretch of rows at a
    time are computed again, so memory grows with m times the root of n.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    ca = _CODES[np.frombuffer(a.encode("latin-1", "replace"), dtype=np.uint8)]
    cb = _CODES[np.frombuffer(b.encode("latin-1", "replace"), dtype=np.uint8)]
    height = isqrt(n) + 1
    kept = [np.zeros(m + 1, dtype=np.int64)]
    for low in range(0, n - height, height):
        kept.append(_rows(ca, cb, low, low + height, kept[-1], None))
    pairs = []
    i, j = n, m
    while i > 0 and j > 0:
        # the moves of the stretch of rows that holds row i, walked back to its start
        low = (i - 1) // height * height
        moves = np.zeros((i - low, m + 1), dtype=np.int8)
        _rows(ca, cb, low, i, kept[low // height], moves)
        while i > low and j > 0:
            move = moves[i - low - 1, j]
            if move == 1:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif move == 2:
                i -= 1
            else:
                j -= 1
    return pairs[::-1]


def _rows(ca: np.ndarray, cb: np.ndarray, low: int, high: int, best: np.ndarray, moves: np.ndarray | None) -> np.ndarray:
    """The score row after letters ``low`` to ``high`` of the first sequence, and how its cells were reached.

    Moves: 1 both, 2 skip a letter of the first sequence, 3 skip one of the second.
    """
    n, m = len(ca), len(cb)
    step = GAP * np.arange(m + 1)
    for i in range(low + 1, high + 1):
        both = best[:-1] + _TABLE[ca[i - 1], cb]
        down = best + GAP
        down[m] = best[m]  # free gap after the end of b
        row = down.copy()
        row[0] = 0
        row[1:] = np.maximum(row[1:], both)
        if i < n:
            swept = np.maximum.accumulate(row - step) + step
        else:  # free gap after the end of a
            swept = np.maximum.accumulate(row)
        if moves is not None:
            here = moves[i - low - 1]
            here[:] = 3
            here[swept == down] = 2
            here[1:][swept[1:] == both] = 1
            here[0] = 2
        best = swept
    return best


PAIRS = T.ArrayType(
    T.StructType([T.StructField("m", T.IntegerType()), T.StructField("t", T.IntegerType())])
)


@F.pandas_udf(PAIRS)
def _positions(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for mobile, target in batches:
        yield pd.Series(
            [[{"m": i, "t": j} for i, j in match_positions(a, b)] for a, b in zip(mobile, target)]
        )


def aligned_positions(mobile: str, target: str) -> Column:
    """Aligned positions of two sequence columns, as an array of (m, t)."""
    return _positions(mobile, target)
