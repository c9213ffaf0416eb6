"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its word n-grams, hashed into ``1 << BITS`` buckets: words
and word pairs in lower case, and one to three neighbouring word shapes (runs of
small letters, capitals and digits become one sign each, other characters stay),
a pair of equal words, and the pairs that the text has had before. A bucket's
value is log(1 + count), the vector has length one.

Training is follow-the-regularised-leader with the proximal step: a coordinate
keeps the sum z of its shifted gradients and the sum n of their squares, and its
weight follows from both in closed form, zero while abs(z) is within ``L1``. A
bounded sample of about ``SAMPLE`` labelled rows is learned from, dealt into
``SHARDS`` shards by hash of the id. In each pass every shard runs through its
rows in hash order, starting from the same (z, n); the driver averages the changes
of each coordinate over the shards that moved it, and holds the model and those
changes only, 24 bytes a bucket and shard. Shards, order and buckets depend on ids and texts
alone, so every cluster learns the same model.

A score is one sparse dot product a text, computed where the text lies.

Defined cases: null and empty texts and texts of white space have no n-grams
and get the score of the constant; a row that repeats is scored each time; an id
with several texts or labels is learned from once, with its least text and its
greatest label; null ids and null labels are never learned from; without labels
every score is one half; with one class the constant moves towards it; an empty
table scores no rows. Texts are read in slices, so the memory of one text is
bounded by its distinct buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read, staged

#: Labelled rows that are learned from, about: ids are taken by hash, at SAMPLE in the number of labelled rows.
SAMPLE = 20_000
#: Buckets of the hash, as a power of two; the constant has one more.
BITS = 18
#: Shards that learn side by side, and passes over the sample.
SHARDS, PASSES = 4, 5
#: Rate, its offset, and the two penalties of the proximal step.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Characters that are read at once, and on to the end of the word.
SLICE = 1_000_000
#: Distinct words whose hashes are remembered at a time.
REMEMBERED = 100_000

_WORD, _SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # golden ratio, an odd multiplier that spreads neighbouring values


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other characters once a run."""
    if word.isalpha():  # most words
        if word.islower():
            return "a"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    out: list[str] = []
    for c in word:
        sign = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


class Words(dict):
    """Hashes of words and of their shapes, in the halves of one number, remembered for words that come again."""

    def __missing__(self, word: str) -> int:
        got = zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"), 1)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def _stretches(text: str) -> Iterator[list[str]]:
    """The words of a text, some SLICE characters at a time; no word is cut."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + SLICE)
        stop = end.start() if end else len(text)
        if found := _WORD.findall(text, at, stop):
            yield found
        at = stop


def _bucket(*parts: np.ndarray | int) -> np.ndarray:
    """Bucket of each n-gram, from a number for its kind and the hashes of its words."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, dtype=np.uint64)) * _MIX
            h = h ^ (h >> np.uint64(29))
    return h & _MASK


def _grams(word: np.ndarray, form: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that end after the first ``lead`` words; the word pairs among them come apart."""
    pairs = _bucket(2, word[:-1], word[1:])[max(lead - 1, 0) :]
    rest = [_bucket(1, word)[lead:], _bucket(3, form)[lead:], _bucket(4, form[:-1], form[1:])[max(lead - 1, 0) :], _bucket(5, form[:-2], form[1:-1], form[2:])[max(lead - 2, 0) :]]
    same = int((word[1:] == word[:-1])[max(lead - 1, 0) :].sum())
    return pairs, np.concatenate([*rest, np.full(same, _bucket(6))])


def sparse(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text; the constant is not among them."""
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    before = np.zeros(0, dtype=np.uint64)
    pairs = before, np.zeros(0, dtype=np.int64)
    for found in _stretches(text or ""):
        both = np.concatenate([before, words.of(found)])
        two, rest = _grams(both >> np.uint64(32), both & np.uint64(0xFFFFFFFF), len(before))
        pairs = _merged([pairs[0], two], [pairs[1], np.ones(len(two), dtype=np.int64)])
        i, n = _merged([rest], [np.ones(len(rest), dtype=np.int64)])
        ids.append(i)
        counts.append(n)
        before = both[-2:]
    again = int((pairs[1] - 1).sum())
    ids.append(pairs[0])
    counts.append(pairs[1])
    if again:
        ids.append(np.atleast_1d(_bucket(7)))
        counts.append(np.array([again]))
    index, count = _merged(ids, counts)
    value = np.log1p(count)
    return index.astype(np.int32), (value / max(np.sqrt((value**2).sum()), 1e-9)).astype(np.float32)


def _merged(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    index, at = np.unique(np.concatenate([i.astype(np.uint64) for i in ids]), return_inverse=True)
    return index, np.bincount(at, weights=np.concatenate(counts), minlength=len(index)).astype(np.int64)


class Leader:
    """(z, n) of every bucket and, last, of the constant."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((1 << BITS) + 1) if z is None else z
        self.n = np.zeros((1 << BITS) + 1) if n is None else n

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """The leader's weights: the closed form of the proximal step."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        """One row: gradient of the log loss at its coordinates."""
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - y) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def _with_constant(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(index, 1 << BITS), np.append(value, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, body, y): about ``rows`` labelled ids that ``may`` allows, by hash, each once."""
    marked = labels.where(may & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    share = min(1.0, rows / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    found = docs.where(may).select("doc_id", F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("body").alias("body"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may=None, rows: int = SAMPLE) -> np.ndarray:
    """Weights of all buckets and the constant."""
    may = F.lit(True) if may is None else may
    sample = labelled_sample(docs, labels, label, may & F.col("doc_id").isNotNull(), rows)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            got = [sparse(t.as_py(), words) for t in b["body"]]
            cols = {"shard": b["shard"], "turn": b["turn"], "y": b["y"]}
            cols |= {"index": pa.array([i for i, _ in got], pa.list_(pa.int32())), "value": pa.array([v for _, v in got], pa.list_(pa.float32()))}
            yield pa.RecordBatch.from_pydict(cols)

    turn = F.xxhash64("doc_id", F.lit(17))
    keyed = sample.select("body", "y", F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn"))
    table = staged(keyed.mapInArrow(measured, "shard int, turn long, y int, index array<int>, value array<float>"), "features")
    model = Leader()
    for _ in range(PASSES):
        model = one_pass(table, model)
    discard(table)
    return model.weights(slice(None))


def one_pass(table: DataFrame, model: Leader) -> Leader:
    """Every shard learns from its rows in turn; changes are averaged over the shards that moved a coordinate."""
    z, n = model.z, model.n

    def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Leader] = {}  # shards that share this task
        for b in batches:
            for shard, y, index, value in zip(b["shard"].to_pylist(), b["y"].to_pylist(), b["index"], b["value"]):
                if shard not in own:
                    own[shard] = Leader(z.copy(), n.copy())
                own[shard].learn(*_with_constant(index.values.to_numpy(), value.values.to_numpy()), y)
        for shard, one in own.items():
            moved = np.flatnonzero((one.z != z) | (one.n != n))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "at": [moved], "dz": [one.z[moved] - z[moved]], "dn": [one.n[moved] - n[moved]]})

    dealt = table.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn")
    # bounded: one row a shard, of 24 bytes for each bucket that moved
    moves = dealt.mapInArrow(learned, "shard int, at array<long>, dz array<double>, dn array<double>").toArrow().sort_by("shard")
    out, movers = Leader(np.zeros_like(z), np.zeros_like(n)), np.zeros_like(z)
    for at, dz, dn in zip(*(moves[c] for c in ("at", "dz", "dn"))):
        at = at.values.to_numpy()
        out.z[at] += dz.values.to_numpy()
        out.n[at] += dn.values.to_numpy()
        movers[at] += 1
    return Leader(z + out.z / np.maximum(movers, 1), n + out.n / np.maximum(movers, 1))


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def scored(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in col:
            logits = np.zeros(len(texts))
            for k, t in enumerate(texts):
                index, value = sparse(t, words)
                logits[k] = weights[index] @ value.astype(np.float64) + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return df.withColumn(out, scored(F.col(text)))


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    got = score(docs.select("doc_id", "text"), train(docs, labels, "quality", ~held))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op13_quality_classifier": op13_quality_classifier}
ORACLES: dict[str, str] = {}
