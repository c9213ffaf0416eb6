"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND.

Test items are indexed, training passages are the queries. A passage is a
window of two cells of words, and a cell is at least twice as long as the item,
so an item lies whole in one passage even where as many foreign words stand
between its parts. Items are put into classes by length, each with its own cell.

Blocks are runs of ``BLOCK`` items, the same for all terms; the index holds the
greatest weight of each term in each block where it stands. Blocks in which the
maxima of a passage's terms do not reach the threshold are skipped, for all
passages of a text at once. In the others the passage has a cursor for each of
its terms: the pivot is the first item at which the maxima of the terms up to it
reach the threshold; it is scored once all of them stand there, and without a
pivot the block is left. Every item has its own threshold: its score against itself less the heaviest terms that a passage may lack and
still be verified. So everything that can be verified is retrieved. Verification
counts the item's word shingles that the passage holds: over the whole item, in
the question and in the answer (the second half of the item where it has no
answer of its own).

The index is made on Spark, one row for each group of at most about ``GROUP``
items of a class, and written to the shared folder. A task that scans texts
reads it from there, group by group, and keeps it while it is small; neither
items nor postings pass through the driver.

Defined cases: null and empty texts match nothing; an item without words is
left out, one of fewer words than a shingle is one shingle; rows that repeat
are examined each; empty tables give no rows; further columns of any name stay
as they are. Equality of shingles is that of 64-bit hashes.
"""

from __future__ import annotations

import io
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, shared_path, staged

SHINGLE = 5
OVERLAP, PART_OVERLAP = 0.8, 0.5
K1, B = 1.2, 0.75
#: Items of one index and of one block, least words of a cell.
GROUP, BLOCK, CELL = 20_000, 4, 64
#: Bytes of indexes that a task keeps; it reads further ones anew for each batch of texts.
KEPT = 256 << 20
_EPS = 1e-6


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(w: list[bytes], n: int = SHINGLE) -> list[bytes]:
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def hashes(parts: list[bytes]) -> np.ndarray:
    """Distinct hashes, sorted."""
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts)))


def cell_of(n: int) -> int:
    """Words of a cell for items of ``n`` words: a power of two of at least twice as many."""
    return max(CELL, 1 << (2 * n - 1).bit_length())


class Index:
    """Postings with block maxima for (id, text, answer or None) of one class of lengths."""

    def __init__(self, items: list[tuple[int, bytes, bytes | None]]):
        ids, terms, whole, question, answer, lost, widths = [], [], [], [], [], [], []
        for i, text, answer_ in items:
            w, a = words(text), words(answer_)
            if not w:
                continue
            both = w + a
            half = len(w) if a else (len(w) + 1) // 2
            s = shingles(both)
            ids.append(i)
            terms.append(both)
            widths.append(min(len(both), SHINGLE))
            whole.append(hashes(s))
            question.append(hashes(s[: max(1, half - SHINGLE + 1)]))
            answer.append(hashes(s[min(half, len(s) - 1) :]))
            lost.append(int((1 - OVERLAP) * len(whole[-1]) + 1e-9))
        n = len(ids)
        self.ids, self.width = np.array(ids, dtype=np.int64), np.array(widths, dtype=np.int64)
        self.cell = max([CELL, *(cell_of(len(w)) for w in terms)])
        self.parts = [(np.cumsum([0, *map(len, x)]), np.concatenate(x) if n else np.zeros(0, dtype=np.uint64)) for x in (whole, question, answer)]
        number: dict[bytes, int] = {}
        rows = [np.unique([number.setdefault(t, len(number)) for t in w], return_counts=True) for w in terms]
        df = np.zeros(len(number))
        for t, _ in rows:
            df[t] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = np.mean([len(w) for w in terms]) if n else 1
        weights = []
        for k, (t, tf) in enumerate(rows):
            v = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(terms[k]) / mean))
            need = v.sum() - np.sort(v)[::-1][: lost[k]].sum()
            # divided by the item's threshold, so that one is the threshold of all
            weights.append(v / max(need, 1e-9) + _EPS)
        term = np.concatenate([t for t, _ in rows]) if n else np.zeros(0, dtype=np.int64)
        item = np.repeat(np.arange(n), [len(t) for t, _ in rows])
        order = np.lexsort((item, term))
        self.item, self.weight = item[order].astype(np.int64), np.concatenate(weights)[order] if n else np.zeros(0)
        self.first = np.concatenate(([0], np.cumsum(df.astype(np.int64))))
        self.terms = list(number)
        self._ready()

    def _ready(self) -> None:
        """What follows from the arrays: numbers of terms, and the maxima of their blocks."""
        self.number = {t: k for k, t in enumerate(self.terms)}
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        starts = np.flatnonzero(np.diff(term * (len(self.ids) + 1) + self.item // BLOCK, prepend=-1))
        self.block = self.item[starts] // BLOCK
        self.block_max = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.block_start = np.append(starts, len(self.item))
        self.block_first = np.searchsorted(term[starts], np.arange(len(self.terms) + 1))
        self.blocks = -(-len(self.ids) // BLOCK)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{k}{i}": x for i, pair in enumerate(self.parts) for k, x in zip(("at", "of"), pair)}
        lengths = np.array([len(t) for t in self.terms], dtype=np.int64)
        np.savez(out, ids=self.ids, width=self.width, cell=self.cell, item=self.item, weight=self.weight, first=self.first, lengths=lengths, terms=np.frombuffer(b"".join(self.terms), dtype=np.uint8), **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Index:
        self, z = cls.__new__(cls), np.load(io.BytesIO(blob))
        self.ids, self.width, self.cell, self.item, self.weight, self.first = (z[k] for k in ("ids", "width", "cell", "item", "weight", "first"))
        self.cell = int(self.cell)
        self.parts = [(z[f"at{i}"], z[f"of{i}"]) for i in range(3)]
        raw, ends = z["terms"].tobytes(), np.cumsum(z["lengths"]).tolist()
        self.terms = [raw[a:b] for a, b in zip([0, *ends], ends)]
        self._ready()
        return self

    def _bounds(self, place: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place and block as one key, sorted; sum of the maxima there) of terms at places."""
        n = self.block_first[term + 1] - self.block_first[term]
        at = np.repeat(self.block_first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, inverse = np.unique(np.repeat(place, n) * self.blocks + self.block[at], return_inverse=True)
        return key, np.bincount(inverse, weights=self.block_max[at], minlength=len(key))

    def _in_block(self, terms: np.ndarray, block: int) -> list[int]:
        """Items of a block that a passage of these distinct terms scores at one or more."""
        cursors = []
        for t in terms.tolist():
            a, b = self.block_first[t], self.block_first[t + 1]
            k = a + np.searchsorted(self.block[a:b], block)
            if k < b and self.block[k] == block:
                own = slice(self.block_start[k], self.block_start[k + 1])
                cursors.append([0, self.item[own].tolist(), self.weight[own].tolist(), float(self.block_max[k])])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= 1 - _EPS:
                    pivot = c[1][c[0]]
                    break
            if pivot is None:
                break
            if cursors[0][1][cursors[0][0]] == pivot:
                here = [c for c in cursors if c[1][c[0]] == pivot]
                if sum(c[2][c[0]] for c in here) >= 1 - _EPS:
                    out.append(pivot)
                to = pivot + 1
            else:
                to = pivot
            for c in cursors:
                if c[1][c[0]] < to:
                    c[0] = bisect_left(c[1], to, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """Items that a passage of these distinct terms scores at one or more."""
        block, bound = self._bounds(np.zeros(len(terms), dtype=np.int64), terms)
        return [k for b in block[bound >= 1 - _EPS].tolist() for k in self._in_block(terms, b)]

    def candidates(self, w: list[bytes]) -> list[tuple[int, int]]:
        """(first word of the passage, item) for all passages of a text that reach the item's threshold."""
        get, none = self.number.get, len(self.number)
        ids = np.fromiter((get(x, none) for x in w), dtype=np.int64, count=len(w))
        at = np.flatnonzero(ids != none)
        if not len(at):
            return []
        # a passage is a cell and the next; one that begins in the last cell adds nothing unless it is the only one
        last, cell = max(1, (len(w) - 1) // self.cell), at // self.cell
        own = np.unique(np.concatenate((cell[cell < last] * none + ids[at[cell < last]], (cell[cell > 0] - 1) * none + ids[at[cell > 0]])))
        passage, term = np.divmod(own, none)
        key, bound = self._bounds(passage, term)
        out = []
        for x in key[bound >= 1 - _EPS].tolist():
            p, b = divmod(x, self.blocks)
            lo, hi = np.searchsorted(passage, [p, p + 1])
            out += [(p * self.cell, k) for k in self._in_block(term[lo:hi], b)]
        return out

    def matches(self, text: bytes | None) -> list[dict]:
        """Verified items of a text with their best overlaps."""
        w = words(text)
        found: dict[int, list[float]] = {}
        held: dict[tuple[int, int], np.ndarray] = {}
        for p, k in self.candidates(w):
            if (key := (p, int(self.width[k]))) not in held:
                held[key] = hashes(shingles(w[p : p + 2 * self.cell], key[1]))
            shares = []
            for at, of in self.parts:
                part = of[at[k] : at[k + 1]]
                shares.append(np.isin(part, held[key], assume_unique=True).sum() / len(part))
            if shares[0] >= OVERLAP and min(shares[1:]) >= PART_OVERLAP:
                found[k] = [float(max(x)) for x in zip(found.get(k, [0, 0, 0]), shares)]
        return [{"item_id": int(self.ids[k]), "overlap": o, "question_overlap": q, "answer_overlap": a} for k, (o, q, a) in sorted(found.items())]


MATCHES = "array<struct<item_id:long,overlap:double,question_overlap:double,answer_overlap:double>>"


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """The written index: one row (blob) for each group of items of like length."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t"), (F.col(answer) if answer else F.lit(None)).cast("binary").alias("a"))

    @F.pandas_udf("int")
    def cells(t: pd.Series, a: pd.Series) -> pd.Series:
        sizes = [len(words(x)) and len(words(x)) + len(words(y)) for x, y in zip(t, a)]
        return pd.Series([cell_of(n) if n else 0 for n in sizes], dtype="int32")

    rows = staged(rows.withColumn("cell", cells("t", "a")).where("cell > 0"), "benchmark-items")
    groups = rows.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("groups"))  # a class is a power of two: few rows
    dealt = rows.join(F.broadcast(groups), "cell").withColumn("g", F.pmod(F.xxhash64("i", "t"), "groups"))

    def built(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "t"])
        return pd.DataFrame({"blob": [Index(list(zip(pdf["i"], pdf["t"], pdf["a"]))).to_bytes()]})

    return staged(dealt.groupBy("cell", "g").applyInPandas(built, "blob binary"), "benchmark-index")


_READ: dict[str, list[Index]] = {}


def _written(path: str) -> Iterator[Index]:
    """Indexes under a path, one at a time; the process keeps them while they are small."""
    if path in _READ:
        yield from _READ[path]
        return
    from pyarrow import dataset, fs

    place, root = fs.FileSystem.from_uri(path)
    kept, size = [], 0
    for batch in dataset.dataset(root, filesystem=place, format="parquet").to_batches(columns=["blob"], batch_size=1, batch_readahead=1, fragment_readahead=1):
        for blob in batch["blob"]:
            index = Index.from_bytes(blob.as_py())
            size += blob.as_buffer().size
            kept = [*kept, index] if size <= KEPT else []
            yield index
    if size <= KEPT:
        _READ.clear()  # of an earlier table
        _READ[path] = kept


def with_matches(df: DataFrame, index: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
    """Add the verified items of each text, by a written index."""
    path = shared_path(index)

    @F.pandas_udf(MATCHES)
    def found(col: pd.Series) -> pd.Series:
        got: list[list[dict]] = [[] for _ in col]
        for ix in _written(path):
            for have, t in zip(got, col):
                have += ix.matches(t)
        return pd.Series(got)

    return df.withColumn(out, found(F.col(text).cast("binary")))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap, question_overlap, answer_overlap) of all verified pairs."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("body"))
    return with_matches(rows, indexes(items), "body", "found").select("doc_id", F.inline("found"))


def drop_contaminated(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds no item, columns unchanged."""
    return with_matches(df, indexes(items), text, "__cellwright_matches").where(F.size("__cellwright_matches") == 0).select(*df.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SH = f"case when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else [array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})] end"
ORACLE = f"""
with b as (select item_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') w from benchmark),
i as (select item_id, len(w) n, {_SH} s from b where len(w) > 0),
k as (select item_id, greatest({CELL}, pow(2, ceil(log2(2 * n))))::bigint cell, (n + 1) // 2 half, len(s) m, unnest(s) g, unnest(range(len(s))) j from i),
ik as (select item_id, cell, g, bool_or(j < greatest(1, half - {SHINGLE - 1})) q, bool_or(j >= least(half, m - 1)) a from k group by item_id, cell, g),
n as (select item_id, count(*) nw, count(*) filter (q) nq, count(*) filter (a) na from ik group by item_id),
d as (select row_number() over () uid, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') w from documents),
x as (select uid, doc_id, len(w) lw, unnest({_SH}) g, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) j from d where len(w) > 0),
h as (select uid, doc_id, lw, j, ik.* from x join ik using (g)),
p as (select distinct uid, doc_id, item_id, g, q, a, unnest([j // cell, j // cell - 1]) p, j, lw, cell from h),
v as (select uid, doc_id, item_id, p, count(distinct g) w, count(distinct g) filter (q) wq, count(distinct g) filter (a) wa from p
    where p >= 0 and p < greatest(1, (lw - 1) // cell) and j + {SHINGLE} <= greatest({SHINGLE}, least(lw, (p + 2) * cell)) group by all)
select doc_id, item_id, max(w / nw) overlap, max(wq / nq) question_overlap, max(wa / na) answer_overlap
from v join n using (item_id) where w / nw >= {OVERLAP} and wq / nq >= {PART_OVERLAP} and wa / na >= {PART_OVERLAP} group by uid, doc_id, item_id"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": ORACLE}
