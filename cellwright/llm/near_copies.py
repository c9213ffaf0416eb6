"""SimHash near-dedup of texts whose five-word shingles have a Jaccard share of 0.8 or more.

The tiled comparison of ``simhash`` finds the candidates, on fingerprints of
192 bits over the distinct shingles of a text. Sets that share 0.8 differ by 29
of them, with a deviation of 5; texts that share nothing by 96, with one of 7.
``RADIUS`` lies between, so next to no link is missed (none of 80 000 drawn at
exactly 0.8 with ten shingles and more, 0.2 % between texts of four and five
shingles) and next to no pair is looked at in vain. Tiles are dealt by the
number of shingles: sets that share 0.8 differ by a quarter at most, so only
neighbouring bands meet.

Candidate links, a spanning forest per meeting, make candidate groups; no
verified link leaves one. Texts of a group meet again with their whole shingle
sets: small groups share a bucket, sent once, and only a group larger than a
tile is dealt into tiles that meet each other. Each candidate is verified there
unless its texts are joined already, and a meeting returns a spanning forest of
its verified links. So a group of thousands of near copies never gives all its
pairs, and none of them is left out.

Texts are compared once each, in lower case and with single spaces, so copies
of equal words cost nothing.

Defined cases: null text counts as empty, empty texts are copies of each other;
a text of fewer words than a shingle is one shingle; repeated rows are copies;
an empty table gives no rows; further columns of any name and type stay as they
are. Equality of texts and shingles is that of 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, discard, lookup, numbered, staged
from .simhash import SEED, SLICE, _Forest, components, meetings, near_blocks, tile_size
from .token_shards import _mixed

SHINGLE = 5
#: Least share of two sets, as numerator and denominator.
SHARE = (4, 5)
LANES, RADIUS = 3, 52
#: Shingles of a tile of whole sets, and the most to which the tiles of a large group grow.
HASHES, MOST_HASHES = 1 << 18, 1 << 21


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> tuple[int, np.ndarray]:
    """Hash of the words of a text, and the hashes of its distinct shingles, sorted."""
    import xxhash

    words = (text or b"").lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        found = [digest(line, SEED)] if words else []
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        found = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return digest(line, 0), np.unique(np.array(found, dtype=np.uint64))


def lanes(hashes: np.ndarray) -> list[int]:
    """Majority of the bits of the hashes, and of the same hashes mixed anew for each further lane."""
    out = []
    for k in range(LANES):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), SLICE):
            h = hashes[at : at + SLICE] if k == 0 else _mixed(hashes[at : at + SLICE], k)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def signed(text: Column) -> Column:
    """Hash of the words, number of distinct shingles and fingerprint of a text."""

    @F.pandas_udf("text_id long, size int, lanes array<long>")
    def made(col: pd.Series) -> pd.DataFrame:
        ids, sizes, prints = np.zeros(len(col), dtype=np.uint64), [], []
        for i, t in enumerate(col):
            ids[i], found = shingle_hashes(t)
            sizes.append(len(found))
            prints.append(lanes(found))
        return pd.DataFrame({"text_id": ids.view(np.int64), "size": sizes, "lanes": prints})

    return made(text)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can share enough."""
    return SHARE[1] * np.minimum(a, b) >= SHARE[0] * np.maximum(a, b)


def _band(size: Column) -> Column:
    """Number of the band of sizes; sets that share enough lie in one band or two neighbours."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / math.log(SHARE[1] / SHARE[0]))).otherwise(-2).cast("int")


def candidates(texts: DataFrame, tile: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever texts (text_id, size, lanes) are candidates of each other."""
    row = F.concat(F.array("text_id", F.col("size").cast("long")), "lanes")
    met = meetings(texts.select(_band(F.col("size")).alias("band"), row.alias("row")), "band", "row", 1, tile or tile_size(texts.count()))

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = {t: np.asarray(x, dtype=np.int64).reshape(-1, 2 + LANES) for t, x in zip(pdf["tile"], pdf["rows"])}
        none = np.zeros((0, 2 + LANES), dtype=np.int64)  # for a tile that the hash left empty
        left, right = (got.get(k, none) for k in key)
        same = key[0] == key[1]
        rows, shift = (left, 0) if same else (np.concatenate((left, right)), len(left))
        prints = [np.ascontiguousarray(x[:, 2:]).view(np.uint64) for x in (left, right)]
        forest = _Forest(len(rows))
        for p, q, _ in near_blocks(*prints, RADIUS, same) if len(left) and len(right) else ():
            fits = _fits(left[p, 1], right[q, 1])
            forest.link(p[fits], q[fits] + shift)
        moved = np.flatnonzero(forest.root != np.arange(len(rows)))
        return pd.DataFrame({"a": rows[moved, 0], "b": rows[forest.root[moved], 0]})

    return met.groupBy("left", "right").applyInPandas(compare, "a long, b long")


class Sets:
    """A tile of whole sets, from a flat list: text, size, lanes and shingles of each."""

    def __init__(self, flat: np.ndarray):
        at, starts = 0, []
        while at < len(flat):
            starts.append(at)
            at += 2 + LANES + int(flat[at + 1])
        first = np.array(starts, dtype=np.int64)
        self.ids, self.size = flat[first], flat[first + 1]
        self.prints = np.stack([flat[first + 2 + k] for k in range(LANES)], axis=1).view(np.uint64) if starts else np.zeros((0, LANES), dtype=np.uint64)
        self.flat, self.first = flat, first + 2 + LANES

    def joined(self, rows: np.ndarray) -> np.ndarray:
        """Places of the shingles of several rows, one row after the other."""
        n = self.size[rows]
        return np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


def verified(left: Sets, right: Sets, same: bool) -> np.ndarray:
    """Spanning forest of the links between two tiles of whole sets, as rows (text, text)."""
    shift, out = 0 if same else len(left.ids), []
    forest = _Forest(len(left.ids) + (0 if same else len(right.ids)))
    # shingles as small numbers, so that one set is a row of marks
    kinds, number = np.unique(np.concatenate((left.flat, right.flat)), return_inverse=True)
    lnumber, rnumber = number[: len(left.flat)], number[len(left.flat) :]
    mark = np.zeros(len(kinds), dtype=bool)
    for p, q, far in near_blocks(left.prints, right.prints, RADIUS, same):
        fits = _fits(left.size[p], right.size[q])
        order = np.lexsort((far[fits], p[fits]))
        p, q = p[fits][order], q[fits][order]
        cuts = np.flatnonzero(np.diff(p, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(p))):
            one, others = p[a], q[a:b]
            others = others[forest.root[others + shift] != forest.root[one]]
            if not len(others):
                continue
            own = lnumber[left.joined(np.array([one]))]
            mark[own] = True
            shared = np.add.reduceat(mark[rnumber[right.joined(others)]].astype(np.int64), np.cumsum(right.size[others]) - right.size[others])
            mark[own] = False
            near = SHARE[1] * shared >= SHARE[0] * (left.size[one] + right.size[others] - shared)
            _, new = np.unique(forest.root[others[near] + shift], return_index=True)  # one link for each component
            new = others[near][new]
            if len(new):
                forest.link(np.full(len(new), one), new + shift)
                out.append(np.stack((np.full(len(new), left.ids[one]), right.ids[new]), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def _plan(groups: DataFrame, hashes: int) -> DataFrame:
    """Tiles of each band of the groups that outgrow a tile (root, mass, band, size): first, n, low, high.

    Tiles of a group are numbered by band, so those that a tile can meet have
    consecutive numbers. They grow with the root of the group, up to ``MOST_HASHES``.
    """
    tile = F.least(F.lit(max(MOST_HASHES, hashes)), F.sqrt(F.lit(float(hashes)) * F.col("mass")))
    counts = groups.where(F.col("mass") > hashes).groupBy("root", "mass", "band").agg(F.ceil(F.sum("size") / tile).alias("n"))
    by_band = Window.partitionBy("root").orderBy("band")

    def upto(last: int) -> Column:
        return F.coalesce(F.sum("n").over(by_band.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))

    return counts.select("root", "band", "n", upto(-1).alias("first"), upto(-2).alias("low"), (upto(1) - 1).alias("high"))


def near_links(sets: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Links (a, b) that connect whatever is near among the texts (text_id, size, lanes, held, root, mass).

    ``root`` is the candidate group and ``mass`` the number of its shingles.
    """
    rows = sets.where("size > 0").withColumn("band", _band(F.col("size")))
    plan = staged(_plan(rows.select("root", "mass", "band", "size"), hashes), "near-plan")
    dealt = lookup(rows, ["root", "band"], small=plan)
    small = rows.where(F.col("mass") <= hashes).agg(F.sum("size")).first()[0] or 0
    large = F.col("mass") > hashes
    row = F.concat(F.array("text_id", F.col("size").cast("long")), "lanes", "held")
    tile = F.when(large, F.col("first") + F.pmod(F.xxhash64("text_id"), "n")).otherwise(0)
    others = F.when(large, F.sequence("low", "high")).otherwise(F.array(F.lit(0).cast("long")))
    bucket = F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(-(-small // hashes) or 1)))
    met = dealt.select(large.alias("large"), bucket.alias("bucket"), tile.cast("long").alias("tile"), row.alias("row"), F.explode(others).alias("other"))
    met = met.select("large", "bucket", "tile", "row", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = {t: Sets(np.concatenate(x.to_list())) for t, x in pdf.groupby("tile")["row"]}
        one, other = key[-2:]
        found = verified(got[one], got[other], one == other) if one in got and other in got else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return met.groupBy("large", "bucket", "left", "right").applyInPandas(compare, "a long, b long")


def near_roots(texts: DataFrame, keyed: DataFrame, tile: int | None = None, hashes: int = HASHES) -> DataFrame:
    """(node, root) of every text (text_id, row, size, lanes) that has a near copy; ``keyed`` holds ROW and body."""

    @F.pandas_udf("array<long>")
    def sets(col: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t)[1].view(np.int64) for t in col], dtype=object)

    groups = components(candidates(texts.select("text_id", "size", "lanes"), tile), "candidate-stars")
    all_nodes = groups.union(groups.select("root", "root").distinct())
    members = staged(lookup(texts, F.col("text_id") == F.col("node"), "inner", small=all_nodes).select("text_id", "size", "lanes", F.col("row").alias(ROW), "root"), "near-members")
    mass = members.groupBy("root").agg(F.sum("size").alias("mass"))
    asked = staged(lookup(members, "root", "inner", small=mass), "near-asked")
    held = staged(lookup(keyed, ROW, "inner", small=asked).select("text_id", "size", "lanes", "root", "mass", sets("body").alias("held")), "near-sets")
    roots = components(near_links(held, hashes))
    discard(groups, members, asked, held)
    return roots


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each component: that of its smallest id, nulls last, columns unchanged."""
    keyed = numbered(df)
    body = F.col(text_col).cast("binary")
    found = staged(keyed.select(ROW, F.col(id_col).alias("id"), signed(body).alias("s")).select(ROW, "id", "s.*"), "signed")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.col(ROW).alias("row")))
    texts = staged(found.groupBy("text_id").agg(least.alias("least"), F.any_value("size").alias("size"), F.any_value("lanes").alias("lanes")), "distinct-texts")
    roots = near_roots(texts.withColumn("row", F.col("least.row")), keyed.select(ROW, body.alias("body")))
    member = texts.join(roots, texts["text_id"] == roots["node"], "left").select("least", F.coalesce("root", "text_id").alias("root"))
    kept = member.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(ROW))
    gone = staged(found.select(ROW).join(kept, ROW, "left_anti"), "near-copies")
    discard(found, texts, roots)
    return lookup(keyed, ROW, "left_anti", small=gone).select(*df.columns)
