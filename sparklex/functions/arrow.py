"""Functions that no built-in expression can state, as Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} with its braces balanced; None without one or if it isn't closed."""
    head, keyword, tail = (text or "").rpartition("\\boxed")
    rest = tail.lstrip()
    if not keyword or not rest.startswith("{"):
        return None
    depth = 0
    for i, ch in enumerate(rest):
        depth += (ch == "{") - (ch == "}")
        if depth == 0:
            return rest[1:i].strip()
    return None


@F.pandas_udf(StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(last_boxed)


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of a and b, which isn't symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
