"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt into
tiles by their number of set bits; two tiles meet in one task only if those
numbers can differ by no more than the radius, since each differing bit moves
the number by one. Inside a meeting the same bound, taken byte by byte over
blocks, skips further; what remains is compared with exclusive-or and bit
counts. A meeting returns a spanning forest of its links, never all pairs, so a
group of thousands of copies gives thousands of rows. The links are contracted
to components by alternating star steps on written tables.

Defined cases: null or empty text has fingerprint zero and links like any
other; repeated rows are kept, one result row each; a null id never becomes a
component id unless the whole component has none; an empty table gives no rows.
Texts of any length are read in slices, so memory does not grow with a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, passed_on, staged

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Mean fingerprints of a tile, at least and at most, and of the block that one comparison holds.
TILE, MOST_TILE = 1 << 15, 1 << 20
BLOCK = 512
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: majority of the bits of its word shingles."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, SLICE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE])], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def prints(col: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in col], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, prints(F.col(text).cast("binary")))


def _byte_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint8).reshape(len(x), -1))


class _Forest:
    """Smallest-root union of nodes given as index pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of rows; a row is one fingerprint of one or more 64-bit lanes."""
    return sum(np.bitwise_count(left[:, None, k] ^ right[None, :, k]) for k in range(left.shape[1]))


def near_blocks(left: np.ndarray, right: np.ndarray, radius: int, same: bool, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left, rows of right, distances) within the radius, block by block.

    Blocks of like bit counts per byte are formed first; two blocks whose counts
    differ by more than the radius hold no pair. In one tile a pair comes once.
    """
    sides = []
    for part in (left, right):
        counts = _byte_counts(part)
        order = np.lexsort(counts.T[::-1])
        cuts = range(0, len(part), block)
        counts = counts[order]
        low, high = (np.array([f(counts[k : k + block], axis=0) for k in cuts], dtype=np.int16) for f in (np.min, np.max))
        sides.append((part[order], order, cuts, low, high))
    (lx, li, lcuts, llow, lhigh), (rx, ri, rcuts, rlow, rhigh) = sides
    for i, a in enumerate(lcuts):
        gap = np.maximum(0, np.maximum(llow[i] - rhigh, rlow - lhigh[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            b = rcuts[j]
            far = distances(lx[a : a + block], rx[b : b + block])
            near = far <= radius
            if same and j == i:
                near &= np.tri(len(near), k=-1, dtype=bool)
            if near.any():
                p, q = np.nonzero(near)
                yield li[a + p], ri[b + q], far[p, q]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, same: bool = False) -> np.ndarray:
    """Spanning forest of the links between two tiles, as rows (fingerprint, root)."""
    if not len(left) or not len(right):
        return np.zeros((0, 2), dtype=np.uint64)
    nodes = left if same else np.concatenate((left, right))
    forest = _Forest(len(nodes))
    for p, q, _ in near_blocks(left[:, None], right[:, None], radius, same):
        forest.link(p, q if same else q + len(left))
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return np.stack((nodes[moved], nodes[forest.root[moved]]), axis=1)


def tile_size(n: int) -> int:
    """Fingerprints of a tile: they grow with the root of all, so that what tiles that meet send stays below n ** 1.5."""
    return min(MOST_TILE, max(TILE, math.isqrt(n) * 32))


def meetings(prints: DataFrame, band: str, value: str, reach: int, tile: int, weight: Column | None = None) -> DataFrame:
    """(left, right, tile, rows): both tiles of each pair that can hold links, ``rows`` a flat list of ``value``.

    ``band`` is a small number per row, and bands further apart than ``reach``
    hold no link. The number of tiles of a band follows the rows there, or their
    weights, of which a tile holds about ``tile``. Tiles
    are numbered by band, so those that a tile can meet have consecutive
    numbers; only the counts of the bands come to the driver.
    """
    tiles = {r[band]: -(-r["n"] // tile) for r in prints.groupBy(band).agg(F.count("*").alias("n") if weight is None else F.sum(weight).alias("n")).collect()}

    def before(p: int) -> int:
        return sum(n for q, n in tiles.items() if q < p)

    plan = [(p, before(p), n, before(p - reach), before(p + reach + 1) - 1) for p, n in tiles.items()]
    plan = prints.sparkSession.createDataFrame(plan, f"{band} int, first long, n long, low long, high long")
    dealt = prints.join(F.broadcast(plan), band).withColumn("tile", F.col("first") + F.pmod(F.xxhash64(value), "n"))
    packed = dealt.groupBy("tile").agg(F.any_value("low").alias("low"), F.any_value("high").alias("high"), F.collect_list(value).alias("rows"))
    if dict(prints.dtypes)[value].startswith("array"):
        packed = packed.withColumn("rows", F.flatten("rows"))
    met = packed.select("tile", "rows", F.explode(F.sequence("low", "high")).alias("other"))
    return met.select("tile", "rows", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))


def links(prints: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever lies within the radius.

    ``prints`` holds one row per distinct fingerprint in column ``fp``; their
    bands are the numbers of set bits.
    """
    counted = prints.select("fp", F.bit_count("fp").alias("ones"))
    met = meetings(counted, "ones", "fp", radius, tile or tile_size(prints.count()))

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = {t: np.asarray(x, dtype=np.int64).view(np.uint64) for t, x in zip(pdf["tile"], pdf["rows"])}
        none = np.zeros(0, dtype=np.uint64)  # for a tile that the hash left empty
        found = tile_links(got.get(key[0], none), got.get(key[1], none), radius, same=key[0] == key[1]).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return met.groupBy("left", "right").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for each node of the edges (a, b), root the smallest node.

    Alternates large-star and small-star steps; each step is written to the
    shared folder. Ends when a round changes no edge.
    """
    edges = staged(edges.where("a <> b").distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, name)
        old = edges
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = staged(small, name)
        discard(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return passed_on(edges, edges.withColumnsRenamed({"a": "node", "b": "root"}))
        seen = now


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: id, ``fp`` (signed 64-bit) and ``component_id``, the smallest id reachable."""
    rows = staged(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", "fp").select("id", "fp"), "prints")
    prints = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints")
    roots = components(links(prints.select("fp"), radius))
    member = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(member.join(whole, "root").select("fp", "component_id"), "members")
    discard(prints, roots)
    return rows.join(named, "fp").select("id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash_components(docs)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
