"""Token-ID output in training order: keyed Feistel slots, fixed-stride shards.

Texts become token ids of a given byte-level vocabulary. Each task strings its
texts together, every text closed by the end token, and cuts the string into
sequences of one length; only a task's last sequence is padded. The sequences
are written once to the shared folder, so the counts per task fix a dense
number for each of them. A Feistel network over the next even power of two,
walked along its cycle until the value lies below the number of sequences,
permutes these numbers; the result is the sequence's slot in training order.

Shards hold a fixed number of slots of a fixed width, so slot s lies in shard
s // slots at byte (s % slots) * stride, and a reader can begin anywhere. Slots
name the tasks that write them, sorted there; a task streams its rows into files and renames each when it is whole, so a repeated task replaces
the same bytes. The shuffle runs in waves over ranges of slots, and each wave's
shuffle files are removed when it ends.

Defined cases: null and empty texts give the end token alone; repeated rows are
written each time; null ids stay null in the list of a sequence's documents; an
empty table gives no sequence and no shard.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lookup, read, shared_dir, staged

# The published splitting pattern that belongs to the vocabulary, and its free id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Characters of white space (the pattern's class) that are encoded as a piece of their own.
LONG = 10_000
LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")

LENGTH = 1024
SLOTS = 8192
WAVES = 4
#: Tasks of a wave at most.
TASKS = 20_000
#: Tokens that a task gathers before it cuts them into sequences.
HELD = 1 << 20
KEY = 0x5EED_0F_0DE2
ROUNDS = 6
STRIDE = 2 * LENGTH

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Encoder of the vocabulary file, kept for the life of the process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encode_text(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of a text of any length.

    A very long run of white space overflows the pattern's backtracking. The
    pattern takes such a run as one piece, less its last character where
    something follows, so it is encoded as that piece, apart from the rest.
    """
    enc, out, at = encoder(path), [], 0
    for m in LONG_SPACE.finditer(text) if len(text) >= LONG else ():
        out += enc.encode_ordinary(text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        out += enc._encode_single_piece(text[m.start() : at])
    return out + enc.encode_ordinary(text[at:])


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Finaliser of a 64-bit hash, keyed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _subkeys(key: int) -> list[int]:
    return [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64), key % 2**64)]


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0 .. n - 1 by a Feistel network with cycle-walking."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _subkeys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        return (left << half) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (out_of := np.flatnonzero(out >= n)).size:
        out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def sequences(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """(part, k, n_tokens, doc_ids, tokens): the k-th sequence of task ``part``; tokens are little-endian 16-bit ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        rest, owners = np.zeros(0, dtype="<u2"), []  # tokens not yet cut, and (end, id) of their texts

        def rows(full: int) -> pd.DataFrame:
            nonlocal rest, owners, k
            out, at = [], 0
            for s in range(full):
                a, b = s * length, min((s + 1) * length, len(rest))
                while owners[at][0] <= a:
                    at += 1
                to = at
                while owners[to][0] < b:
                    to += 1
                tokens = np.full(length, END, dtype="<u2")
                tokens[: b - a] = rest[a:b]
                out.append((part, k, b - a, [o[1] for o in owners[at : to + 1]], tokens.tobytes()))
                k += 1
            done = min(full * length, len(rest))
            rest = rest[done:]
            owners = [(e - done, i) for e, i in owners if e > done]
            return pd.DataFrame(out, columns=["part", "k", "n_tokens", "doc_ids", "tokens"])

        for pdf in batches:
            pieces, end = [rest], len(rest)
            for i, t in zip(pdf["doc_id"], pdf["body"]):
                ids = np.array(encode_text(t or "", vocabulary), dtype="<u2")
                pieces += [ids, np.array([END], dtype="<u2")]
                end += len(ids) + 1
                owners.append((end, None if pd.isna(i) else int(i)))
                if end >= HELD:
                    rest = np.concatenate(pieces)
                    yield rows(end // length)
                    pieces, end = [rest], len(rest)
            rest = np.concatenate(pieces)
        while len(rest) >= length:
            yield rows(len(rest) // length)
        if len(rest):
            yield rows(1)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInPandas(cut, "part int, k long, n_tokens int, doc_ids array<long>, tokens binary")


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Remove the shuffle files of each query as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, waves: int = WAVES) -> DataFrame:
    """Write all texts as shards under ``path`` and return one row per sequence.

    Columns: slot, shard, offset (byte in the shard), n_tokens, doc_ids, crc32
    of the bytes written, part and k (place before the permutation).
    """
    spark = df.sparkSession
    held = staged(sequences(df, id_col, text, vocabulary, length), "sequences")
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    starts = staged(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"), "n"), "starts")
    total = starts.agg(F.sum("n")).first()[0] or 0
    rows = starts.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(path)
        open_, shard, name = None, None, ""

        def close() -> None:
            if open_ is not None:
                open_.close()
                place.move(name, f"{root}/shard-{shard:08d}.bin")

        for pdf in batches:
            checks = []
            for s, tokens in zip(pdf["slot"], pdf["tokens"]):
                if s // slots != shard:
                    close()
                    shard, name = s // slots, f"{root}/_writing-{uuid.uuid4().hex}"
                    open_ = place.open_output_stream(name)
                open_.write(tokens)
                checks.append(zlib.crc32(tokens))
            out = pdf[["slot", "n_tokens", "doc_ids", "part", "k"]].copy()
            out["shard"], out["offset"], out["crc32"] = pdf["slot"] // slots, pdf["slot"] % slots * (2 * length), checks
            yield out[["slot", "shard", "offset", "n_tokens", "doc_ids", "crc32", "part", "k"]]
        close()

    placed = lookup(held, "part", "inner", rows=rows, small=starts).withColumn("slot", slot(F.col("first") + F.col("k")))
    shards = -(-total // slots)
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(path)
    place.create_dir(root, recursive=True)
    out = None
    with _shuffles_removed(spark):
        for w in range(min(waves, shards)):
            a, b = shards * w // waves * slots, shards * (w + 1) // waves * slots
            if waves > shards:
                a, b = w * slots, (w + 1) * slots
            part = placed.where((F.col("slot") >= a) & (F.col("slot") < b))
            # the slot names its task: whole shards, several for each beyond TASKS of them
            n = max(1, (b - a) // slots)
            task = F.floor((F.col("slot") - a) / (slots * -(-n // TASKS))).cast("int")
            dealt = part.repartitionById(min(n, TASKS), task).sortWithinPartitions("slot")
            done = staged(dealt.mapInPandas(write, "slot long, shard long, offset long, n_tokens int, doc_ids array<long>, crc32 long, part int, k long"), "written")
            out = done if out is None else out.unionAll(done)
    discard(held, starts)
    with place.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "shards": shards, "slots": slots, "length": length, "stride": 2 * length, "key": key, "end": END}).encode())
    if out is None:
        out = spark.createDataFrame([], "slot long, shard long, offset long, n_tokens int, doc_ids array<long>, crc32 long, part int, k long")
    return out


def read_slots(path: str, start: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, token ids) in training order from any slot on, by sequential reads."""
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(path)
    with place.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if count is None else min(m["sequences"], start + count)
    while start < stop:
        shard, skip = divmod(start, m["slots"])
        with place.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(skip * m["stride"])
            for start in range(start, min(stop, (shard + 1) * m["slots"])):
                yield start, np.frombuffer(f.read(m["stride"]), dtype="<u2")
        start += 1


def shard_folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared folder, as a URI."""
    root = shared_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/shards-{uuid.uuid4().hex[:12]}"


def op5_token_shards(spark, sf_dir: str) -> DataFrame:
    return write_shards(read(spark, sf_dir, "documents"), shard_folder(spark))


QUERIES = {"op5_token_shards": op5_token_shards}
ORACLES: dict[str, str] = {}
