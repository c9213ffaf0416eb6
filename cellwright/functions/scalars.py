"""Scalar functions that need more than one built-in."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal distribution; null stays null."""
    return pd.Series([None if v is None or np.isnan(v) else erfc(abs(v) / sqrt(2)) for v in z], dtype="float64")


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def median_of(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def significant(x: Column, digits: int = 3) -> Column:
    """Round to significant digits, half to even; zero and null stay."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def floor_percent(x: Column) -> Column:
    """Share as a whole percentage, never rounded up."""
    return F.floor(x * 100 + 1e-9).cast("int")


def clean(x: Column) -> Column:
    """NaN to null: missing is null everywhere inside the engine."""
    return F.when(~F.isnan(x), x)


def valid_or_null(x: Column, fills: tuple = (), tolerance: float = 0.0, negative_is_missing: bool = False) -> Column:
    """Null for fill values, non-finite and, if asked, negative values."""
    ok = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    for f in fills:
        ok &= F.abs(x - f) > tolerance
    if negative_is_missing:
        ok &= x >= 0
    return F.when(ok, x)


def clear_night(cloud_mask: Column) -> Column:
    """Bits 6-7 of the cloud mask at most 1 (clear), bit 0 unset (night)."""
    return (F.shiftright(cloud_mask, 6).bitwiseAND(3) <= 1) & (cloud_mask.bitwiseAND(1) == 0)


def set_hash(values: Column) -> Column:
    """SHA-256 of a set of texts, independent of order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


@F.udf(T.StringType(), useArrow=False)
def unescape_html(text: str | None) -> str | None:
    """Entities to characters, in batches of some rows: an Arrow batch holds up to 10 000 whole pages, several times over in Python."""
    import html

    return None if text is None else html.unescape(text)


@F.udf(T.StringType(), useArrow=False)
def unescape_closed(text: str | None) -> str | None:
    """As ``unescape_html``, but a name or number without its semicolon is text; of the ampersand the semicolon may be missing."""
    import html
    import re
    from html.entities import html5

    def char(m: re.Match) -> str:
        return html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])

    return None if text is None else re.sub(r"&(amp;?|[0-9A-Za-z]+;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)", char, text)


def html_to_text(page: Column, unclosed: bool = True) -> Column:
    """Plain text of a page: scripts, styles and tags out, entities decoded, white space squeezed.

    unclosed: entities without their semicolon, too, as browsers do; else of these ``&amp`` alone.
    """
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = (unescape_html if unclosed else unescape_closed)(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
