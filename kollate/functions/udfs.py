"""Vectorised functions for what Spark has no expression for."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T


def _each(function):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return run


def _ascii_title(text: str) -> str | None:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    words = "".join(c if c.isalnum() or c.isspace() else " " for c in plain).split()
    return " ".join(words) or None


unescape = _each(html.unescape)
ascii_title = _each(_ascii_title)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("nfc", "spaces", "other")]))
def fold(values: pd.Series) -> pd.DataFrame:
    """The text composed, then with blanks folded, then with all other compatibility signs folded."""
    def one(text):
        if text is None:
            return (None, None, None)
        nfc = unicodedata.normalize("NFC", text)
        spaces = "".join(unicodedata.normalize("NFKC", c) if unicodedata.category(c) == "Zs" else c for c in nfc)
        return nfc, spaces, unicodedata.normalize("NFKC", spaces)

    return pd.DataFrame([one(v) for v in values], columns=["nfc", "spaces", "other"])


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common start of up to four signs."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used = [False] * m
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    k = len(hits)
    if not k:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (b[j] for j in range(m) if used[j]))) // 2
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    start = 0
    while start < min(4, n, m) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_code_of(a: str, b: str) -> str | None:
    """K, B or R where one sign, added or left out, is all that sets two texts apart, by longest matching blocks."""
    if abs(len(a) - len(b)) != 1:
        return None
    steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
    if len(steps) != 1 or steps[0][0] == "replace":
        return None
    _, i, j, k, l = steps[0]
    sign = a[i:j] or b[k:l]
    if len(sign) != 1:
        return None
    return "K" if sign.isspace() else "B" if sign.isalnum() else "R"


@F.pandas_udf(T.StringType())
def indel_code_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_code_of(x, y) for x, y in zip(a, b)], dtype="object")
