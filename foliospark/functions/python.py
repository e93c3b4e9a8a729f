"""Scalars that built-in expressions cannot say, as Arrow functions over batches."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from foliospark.functions.text import ENGLISH, FRENCH, LETTERS


SLICE = 256  # rows of a batch that are Python strings at a time


def _by_slices(texts: pa.Array, make: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    parts = [pa.array(make(texts.slice(at, SLICE).to_pylist()), kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _composed(texts: pa.Array) -> pa.Array:
    one = lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
    return _by_slices(texts, lambda part: [one(t) for t in part], pa.string())


def nfc(text: Column) -> Column:
    """Composed form (NFC); a null stays null. Only texts with a character from U+0300 on, before which nothing composes, go to Python, a slice of a batch at a time."""
    return F.coalesce(arrow_udf(_composed, StringType())(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


_SIGNAL, _EA = re.compile(f"[{LETTERS}']+"), str.maketrans("éèêà", "eeea")
_FR, _EN = frozenset(FRENCH), frozenset(ENGLISH)


def _signals(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> list[int]:
        found = _SIGNAL.findall(text if not text or text.isascii() else text.translate(_EA)) if text else []
        return [sum(map(_FR.__contains__, found)), sum(map(_EN.__contains__, found))]

    return _by_slices(texts, lambda part: [one(t) for t in part], pa.list_(pa.int32()))


def language_signals(text: Column) -> Column:
    """[French, English] signals() of lower-case texts."""
    return arrow_udf(_signals, ArrayType(IntegerType()))(text)  # made here, as workers have no session


@pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity: twice the characters in common blocks over all characters; two empty texts are alike."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)
