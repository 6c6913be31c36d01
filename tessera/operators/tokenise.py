"""One tokeniser for documents and queries: words of all scripts, Han text cut by a dictionary or into pairs.

Without a dictionary it is a column expression. With one, cutting is sequential and runs as an Arrow
function over batches. ``words_of`` is the same for a single text, a query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.segment import fewest

_PIECE = re.compile(rf"[{T.HAN}]+|(?:(?![{T.HAN}])[^\W_])+[+#]*")
_PIECE_OR_MARK = re.compile(rf"{_PIECE.pattern}|[^\s]")
_IS_HAN = re.compile(f"[{T.HAN}]")


def words_of(text: str | None, words: set[str] = frozenset(), punctuation: bool = False) -> list[str]:
    """Lower-case tokens in order. Han runs are cut into the fewest words of the dictionary, or without one into overlapping pairs; punctuation marks are tokens if asked for."""
    longest = max(map(len, words), default=1)
    out: list[str] = []
    for piece in (_PIECE_OR_MARK if punctuation else _PIECE).findall((text or "").lower()):
        if not _IS_HAN.match(piece):
            out.append(piece)
        elif words:
            out += fewest(piece, words, longest)
        else:
            out += [piece[i : i + 2] for i in range(max(len(piece) - 1, 1))]
    return out


def tokens(text: Column, words: set[str] = frozenset(), least: int = 2, punctuation: bool = False) -> Column:
    """Token array of a text column, by the rules of words_of."""
    if not words and not punctuation:
        return T.tokens(text, least)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [w for w in words_of(t, words, punctuation) if len(w) >= least])

    return run(text)
