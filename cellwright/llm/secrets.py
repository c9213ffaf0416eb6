"""Secret scans by sliding-window entropy per character class.

Fixed patterns give the base spans: assignments, access keys and long
hexadecimal runs. The method looks at candidate strings, runs of the characters
that keys are written in: a window slides over a candidate and the Shannon
entropy of its characters, within the alphabet of their class (hexadecimal,
base-36, base-64), follows from counts that change by one character in and one
out. Windows have 20 characters, 16 in candidates of 16 to 19. Every window above
the high bound of its class opens a span, and the span goes on over neighbouring
windows above the low bound, so a dip cuts no key. No span opens in a window that
an allow-list pattern covers (words and short numbers joined by hyphens, slashes
and the like, dates, runs of one class of letters), nor in one that neither mixes
letters with digits nor holds many letters of either case; UUIDs divide candidates.

Defined cases: null text counts as empty; rows that repeat are scanned each;
an empty table gives no rows; candidates of any length cost time in proportion
to it. Positions are code points, ends exclusive. What base spans cover of a
method span is cut out of it; the rest stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

# The base kinds in their order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these is in every text with an assignment, once letters are lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Shorter runs fail as a whole, so only those of full length are looked for.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Window of a candidate, and of one that is shorter than that.
WINDOW, SHORT = 20, 16
#: Bits a character that open and that continue a span, by window: quantiles 0.005 and 0.00005 of
#: windows of random keys, of the narrowest alphabet of the class (16, 32, 64 characters).
BOUNDS = {
    WINDOW: {"hex": (2.82, 2.48), "base36": (3.28, 2.96), "base64": (3.6, 3.3)},
    SHORT: {"hex": (2.6, 2.18), "base36": (3.02, 2.65), "base64": (3.32, 2.98)},
}
#: Upper and lower case letters, of each, that a window without a digit needs to open a span.
MIXED = {WINDOW: 7, SHORT: 6}
#: A size (640x480), a word with two digits at most after it, or a short number: what slugs and paths are joined of.
SEGMENT = r"(?>[0-9]{1,5}x[0-9]{0,5}|x[0-9]{1,5}|[A-Z]?[a-z]+[0-9]{0,2}|[A-Z]+[0-9]{0,2}|[0-9]{1,8})"
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
ALLOWED = (
    re.compile(rf"[-_/+=]*{SEGMENT}(?:[-_/+=]+{SEGMENT})*[-_/+=]*"),
    re.compile(r"[a-z]+([-_/][a-z]+)+", re.I),
    re.compile(r"[a-z]+|[A-Z]+|[0-9]+"),
    re.compile(r"[0-9T:Z/_-]+"),
    re.compile(r"(.)\1+|[-=_+/]+"),
    re.compile(r"([A-Z][a-z]+){2,}|[a-z]+([A-Z][a-z]+)+"),
)
_PLOGP = [0.0] + [k * log2(k) for k in range(1, WINDOW + 2)]


def char_class(s: str) -> str:
    """Narrowest class whose alphabet holds the string."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "base36" if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", s) else "base64"


def window_of(s: str) -> int:
    """Window that slides over a candidate."""
    return WINDOW if len(s) >= WINDOW else SHORT


def window_entropies(s: str, size: int = WINDOW) -> list[float]:
    """Entropy of each window, by counts that change by one character in and one out."""
    counts: dict[str, int] = {}
    total, out, full = 0.0, [], log2(size)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _PLOGP[n + 1] - _PLOGP[n]
        counts[c] = n + 1
        if i >= size:
            old = s[i - size]
            n = counts[old]
            total += _PLOGP[n - 1] - _PLOGP[n]
            counts[old] = n - 1
        if i >= size - 1:
            out.append(full - total / size)
    return out


def _opens(w: str) -> bool:
    """Whether a window may be that of a key by what its characters are."""
    upper, lower = sum(c.isupper() for c in w), sum(c.islower() for c in w)
    if not (upper + lower and any(c.isdigit() for c in w)) and min(upper, lower) < MIXED[len(w)]:
        return False
    return not any(p.fullmatch(w) for p in ALLOWED)


def entropy_spans(s: str) -> list[tuple[int, int]]:
    """Starts and ends of all stretches with a window above the high bound and none below the low one."""
    if len(s) < SHORT or any(p.fullmatch(s) for p in ALLOWED):
        return []
    out, since, opened = [], None, False
    size = window_of(s)
    entropies = window_entropies(s, size)
    for i, e in enumerate([*entropies, 0.0]):
        w = s[i : i + size]
        high, low = BOUNDS[size][char_class(w)] if i < len(entropies) else (1.0, 1.0)
        if e >= low:
            since = i if since is None else since
            opened = opened or e >= high and _opens(w)
        elif since is not None:
            if opened:
                out.append((since, i - 1 + size))
            since, opened = None, False
    # stretches of windows may overlap where they are read as characters
    joined: list[tuple[int, int]] = []
    for a, b in out:
        if joined and a <= joined[-1][1]:
            a = joined.pop()[0]
        joined.append((a, b))
    return joined


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Start and characters of each run that keys are written in, divided by the UUIDs in it."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for u in UUID.finditer(m[0]):
            yield at, text[at : m.start() + u.start()]
            at = m.start() + u.end()
        yield at, text[at : m.end()]


def without(a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span beside the base spans, sorted by start."""
    out = []
    for x, y in base:
        if x < b and a < y:
            if a < x:
                out.append((a, x))
            a = max(a, y)
    return out + [(a, b)] if a < b else out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text, base spans and further ones, by start and kind."""
    text = text or ""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted((a, b) for a, b, _ in out)
    for at, s in candidates(text):
        for a, b in entropy_spans(s):
            rest = without(at + a, at + b, base)
            out += [(x, y, "entropy") for x, y in rest if text[x:y].strip("+/_=-")]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (start, end, kind) in code points."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["spans"] = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in pdf["body"]]
            yield pdf[["doc_id", "spans"]]

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("body"))
    kind = dict(df.dtypes)[id_col]
    return rows.mapInPandas(scanned, f"doc_id {kind}, spans array<struct<start:long,end:long,kind:string>>")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    got = secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    kinds = F.transform("spans", lambda s: s["kind"])

    def count(k: str):
        return F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return got.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
