"""LM scoring with a Katz backoff model of word trigrams.

Counts are discounted by Good-Turing up to ``KEEP`` (Katz's formula), and what
the discount leaves of a history is given to the words unseen after it in
proportion to their probability after the shorter history, so every history sums
to one. Unigrams are discounted in the same way; what that leaves is the
probability of a word outside the vocabulary. A token is scored by the trigram
if it was seen, else by the backoff weight of its history (one, if that was
never seen) times the score by the bigram, and so on down to the unigram.

Work is cut so that no table of the whole vocabulary meets in one task. Texts
are written once as chunks of local word numbers. A chunk's own words are joined
to the vocabulary table and come back as that chunk's dictionary. Trigrams are
counted per chunk, packed by bucket of the last word before, added up per bucket
and stored as partitioned tables beside that of the backoff weights: bigrams,
trigrams and the histories of both that share this word lie in one bucket. So
scoring sends each chunk's distinct trigrams there once, with the texts they
stand in, and gets one sum per text back; the task that answers reads its
bucket's folder of the tables. Buckets of frequent words answer in several tasks.

Defined cases: null text counts as empty and is the end token alone; a text
without id is learned from (its hash is not 2) and keeps a null id; repeated
rows count and are scored each; an empty table gives no rows; without training
texts every token is unknown, and the unknown word has all probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lookup, passed_on, read, shared_path, staged
from .token_shards import _shuffles_removed

#: Counts up to this are discounted.
KEEP = 5
#: Tokens after which a chunk is closed; tokens that a bucket should hold; buckets at least.
CHUNK, BUCKET, MIN_BUCKETS = 4_000_000, 2_000_000, 16
#: Bytes of texts that are split into words at once.
PIECE = 1 << 20
#: From this many buckets on, buckets grow to this many tokens before there are more of them.
MANY_BUCKETS, LARGE_BUCKET = 256, 32_000_000
#: Trigrams of a bucket that are held before equal ones are added up.
HELD = 4_000_000
#: Word numbers: outside the vocabulary, begin of a text (a history only); words follow.
UNKNOWN, BEGIN, FIRST = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers as byte planes, compressed."""
    import zstandard

    parts = [np.array([len(arrays)], dtype="<u8").tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
        parts += [np.array([len(a), width], dtype="<u8").tobytes(), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        n, width = map(int, np.frombuffer(raw, "<u8", 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 16 + n * width
    return out


def _split(body: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in lower case, an empty one before and after white space at either end, and how many of them each text has."""
    text = pc.fill_null(body.cast(pa.binary()).view(pa.string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(text))
    return words.flatten(), pc.list_value_length(words).to_numpy().astype(np.int64)


def _slices(body: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``PIECE`` bytes together, or of one text."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(body).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield at, to
        at = to


def _chunk(ids: pa.Array, held: pa.Array, pieces: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """Texts as local word numbers; the empty word is the end token."""
    coded = pa.chunked_array([p[0] for p in pieces]).dictionary_encode()
    number = coded.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    end = pc.index(number, "").as_py()
    if end < 0:
        end, number = len(number), pa.concat_arrays([number, pa.array([""])])
    text = np.repeat(np.arange(len(ids)), np.concatenate([p[1] for p in pieces]))
    full = codes != end
    lens = np.bincount(text[full], minlength=len(ids)) + 1
    tokens = np.full(int(lens.sum()), end, dtype="<u4")
    last = np.zeros(len(tokens), dtype=bool)
    last[np.cumsum(lens) - 1] = True
    tokens[~last] = codes[full]
    n = np.bincount(tokens[np.repeat(~held.to_numpy(zero_copy_only=False), lens)], minlength=len(number))

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    row = {"doc_ids": listed(ids), "held": listed(held), "lens": pa.array([lens.astype("<i4").tobytes()]), "codes": pa.array([pack(tokens)]), "words": listed(number.view(pa.binary())), "n": listed(pa.array(n, pa.int64()))}
    return pa.RecordBatch.from_pydict(row)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held, body = batch.column("doc_id"), batch.column("held"), batch.column("body")
        start, pieces, size = 0, [], 0
        for at, to in _slices(body):
            pieces.append(_split(body.slice(at, to - at)))
            size += len(pieces[-1][0]) + to - at
            if size >= CHUNK or to == len(body):
                yield _chunk(ids.slice(start, to - start), held.slice(start, to - start), pieces)
                start, pieces, size = to, [], 0
        # the worker goes on with other stages
        pa.default_memory_pool().release_unused()


def chunks(df: DataFrame, held: F.Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts as written chunks: uid, doc_ids, held, lens, codes, words, n (counts in training texts)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).cast("binary").alias("body"))
    cut = rows.mapInArrow(_chunks, "doc_ids array<long>, held array<boolean>, lens binary, codes binary, words array<binary>, n array<long>")
    return staged(cut.withColumn("uid", F.monotonically_increasing_id()), "chunks")


def vocabulary(chunk: DataFrame) -> DataFrame:
    """(word, c, id) of all words of training texts, numbered from ``FIRST`` without gaps, frequent ones first.

    So the numbers of most tokens are small, and a word's count follows from its number.
    """
    seen = chunk.select(F.explode(F.arrays_zip("words", "n")).alias("x")).where("x.n > 0")
    counted = staged(seen.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.n").alias("c")), "word-counts")
    written = staged(counted.orderBy(F.desc("c"), "word").withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    discard(counted)
    table = written.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("row", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = table.groupBy("part").agg(F.count("*").alias("n"))
    # one row per task that wrote the table
    starts = staged(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + FIRST).alias("first")), "vocabulary-starts")
    numbered = lookup(table, "part", "inner", small=starts)
    return passed_on(written, numbered.select("word", "c", (F.col("first") + F.col("row")).cast("long").alias("id")))


def coded(chunk: DataFrame, vocab: DataFrame) -> DataFrame:
    """Chunks with the numbers of their own words: uid, doc_ids, held, lens, codes, own (packed)."""
    own = chunk.select("uid", F.posexplode("words").alias("i", "word")).join(vocab, "word").select("uid", "i", "id")

    def gathered(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"uid": [key[0]], "own": [pack(*(pdf[c].to_numpy(np.int64) for c in ("i", "id")))]})

    words = own.groupBy("uid").applyInPandas(gathered, "uid long, own binary")
    return staged(chunk.drop("words", "n").join(words, "uid", "left"), "coded")


def _tokens(row) -> tuple[np.ndarray, ...]:
    """Word before last, last word, word and text of each token of a chunk, and the words' numbers.

    Words are places in the sorted numbers of the chunk's own words: small, so
    several of them fit into one sort key.
    """
    codes, = unpack(row.codes)
    lens = np.frombuffer(row.lens, dtype="<i4")
    ids = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    if row.own is not None:
        i, number = unpack(row.own)
        ids[i] = number
    ids, place = np.unique(np.concatenate(([UNKNOWN, BEGIN], ids)), return_inverse=True)
    word = place[2:].astype(np.int32)[codes]
    del codes
    starts = np.cumsum(lens) - lens
    last = np.concatenate((word[:1], word[:-1]))
    last[starts] = BEGIN
    before = np.concatenate((last[:1], last[:-1]))
    before[starts] = BEGIN
    return before, last, word, np.repeat(np.arange(len(lens), dtype=np.int32), lens), ids


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, equal ones as they come, and the sorted keys; the array given is used up.

    Keys and places are sorted as one number where that holds both.
    """
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits < 64:
        key <<= bits
        key |= np.arange(len(key), dtype=np.int64)
        key.sort()
        order = (key & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
        key >>= bits
        return order, key
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each run of equal keys."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    number = np.cumsum(new, dtype=np.int32 if len(key) < 1 << 31 else np.int64)
    number -= 1
    return np.flatnonzero(new), number


def _grouped(h2: np.ndarray, h1: np.ndarray, w: np.ndarray, ids: np.ndarray, buckets: int):
    """Distinct bigrams and trigrams, bucket by bucket of the last word before.

    Returns the order of the tokens by trigram, the first token of each bigram,
    the first token and the bigram of each trigram, and the trigram of each token
    in that order.
    """
    place = np.empty(len(ids), dtype=np.int64)
    place[np.lexsort((ids, ids % buckets))] = np.arange(len(ids))
    key = place[h1]
    key *= len(ids)
    key += w
    order, key = _sorted(key)
    pair_first, pair = _numbered(key)
    key[:] = pair
    key *= len(ids)
    key += h2[order]
    again, key = _sorted(key)
    order, pair = order[again], pair[again]
    first, gram = _numbered(key)
    return order, order[pair_first], order[first], pair[first], gram


def _cut(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted bucket column."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, slice(edges[b], edges[b + 1])


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _counted(batches, buckets: int):
    """Per chunk and bucket: training bigrams, and trigrams with their counts."""
    for pdf in batches:
        for row in pdf.itertuples():
            h2, h1, w, doc, ids = _tokens(row)
            train = ~np.array(row.held, dtype=bool)[doc]
            h2, h1, w = h2[train], h1[train], w[train]
            _, pf, first, pair, gram = _grouped(h2, h1, w, ids, buckets)
            n = np.bincount(gram, minlength=len(first))
            of_pair, of_gram, w, h2 = ids[h1[pf]], ids[h1[first]], ids[w[pf]], ids[h2[first]]
            pairs = dict(_cut(of_pair % buckets, buckets))
            out = []
            for b, t in _cut(of_gram % buckets, buckets):
                p = pairs[b]
                out.append((b, pack(_steps(of_pair[p] // buckets), w[p], _steps(pair[t] - p.start), h2[t], n[t])))
            if out:
                yield pd.DataFrame(out, columns=["bucket", "blob"])


def _summed_up(rows: list[np.ndarray]) -> np.ndarray:
    """Columns h1, h2, w, n with the n of equal trigrams added, sorted."""
    x = np.concatenate(rows, axis=1)
    _, b2, b3 = (int(c.max()).bit_length() for c in x[:3])
    if int(x[0].max()).bit_length() + b2 + b3 < 64:
        key = (x[0] << (b2 + b3)) | (x[1] << b3) | x[2]
        order, key = _sorted(key)
        first, _ = _numbered(key)
    else:
        order = np.lexsort((x[2], x[1], x[0]))
        y = x[:3, order]
        first = np.flatnonzero(np.append(True, (y[:, 1:] != y[:, :-1]).any(axis=0)))
    out = x[:, order[first]]
    out[3] = np.add.reduceat(x[3][order], first)
    return out


def _grams(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The bucket's tables of bigrams and trigrams, and the counts of counts of both."""
    held, size = [], 0
    for blob in pdf["blob"]:
        h1, w, pair, h2, n = unpack(blob)
        h1, pair = np.cumsum(h1), np.cumsum(pair)
        held.append(np.stack((h1[pair], h2, w[pair], n)))
        size += len(n)
        if size > HELD:
            held = [_summed_up(held)]
            size = 0
    h1, h2, w, n = _summed_up(held)
    order, pair = _sorted((h1 << 32) | w)
    first, _ = _numbered(pair)
    c = np.add.reduceat(n[order], first)
    first = order[first]
    times = [np.bincount(np.minimum(x, KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2].tolist() for x in (c, n)]
    table = pack(_steps(h1[first]), w[first], c), pack(_steps(h1), h2, w, n)
    return pd.DataFrame({"bucket": [key[0]], "pairs": [table[0]], "triples": [table[1]], "times2": times[:1], "times3": times[1:]})


def discounts(times: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 .. KEEP + 1, the last for all greater ones.

    ``times[r - 1]`` is how many events have count r. Where the counts of counts
    give no factor between zero and one, as in small samples, half a count is
    taken off instead.
    """
    t = [0.0, *map(float, times)]
    d = np.ones(KEEP + 2)
    rest = (KEEP + 1) * t[KEEP + 1] / t[1] if t[1] else 1.0
    for r in range(1, KEEP + 1):
        got = ((r + 1) * t[r + 1] / (r * t[r]) - rest) / (1 - rest) if t[r] and rest < 1 else 0.0
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.minimum(c, KEEP + 1)]


class Unigrams:
    """Discounted unigram probabilities by count, and that of an unknown word."""

    def __init__(self, tokens: int, words: int, times: list[int], firsts: np.ndarray, counts: np.ndarray):
        self.tokens, self.words, self.d = tokens, words, discounts(times)
        self.firsts, self.counts = firsts, counts
        if not tokens:
            self.scale, self.unknown = 1.0, 1.0
            return
        # mass of seen words: all counts less what the discount takes from the small ones
        taken = sum(n * r * (1 - self.d[r]) for r, n in enumerate(times[:KEEP], 1))
        free, least = taken / tokens, 1 / (tokens + 1)
        self.scale = 1.0 if free >= least else (1 - least) / (1 - free)
        self.unknown = max(free, least)

    def count(self, word: np.ndarray) -> np.ndarray:
        """Count of each word by its number: numbers run from the most frequent word down."""
        return np.where(word >= FIRST, self.counts[np.searchsorted(self.firsts, word, side="right") - 1], 0) if self.tokens else np.zeros(len(word), dtype=np.int64)

    def of(self, word: np.ndarray) -> np.ndarray:
        return self.p(self.count(word))

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, self.scale * _discounted(c, self.d) / self.tokens, self.unknown)


def _order(total_of: np.ndarray, c: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each history, p of each row, backoff weight of each history) for rows sorted by history.

    ``lower`` is the probability of each row's word after the shorter history.
    """
    first = np.flatnonzero(np.diff(total_of, prepend=-1))
    size = np.diff(np.append(first, len(c)))
    total = np.add.reduceat(c, first)
    p = _discounted(c, d) / np.repeat(total, size)
    full = np.add.reduceat(p, first)
    # a history without small counts leaves nothing: it gives up one count's share
    keep = np.where(1 - full < 1e-12, total / (total + 1), 1.0)
    p, full = p * np.repeat(keep, size), full * keep
    seen = np.add.reduceat(lower, first)
    return first, p, (1 - full) / np.maximum(1 - seen, 1e-300)


class Bucket:
    """A bucket's n-grams with their probabilities; all orders of a token lie in the bucket of its last word before.

    That word is numbered within the bucket: by its number divided by the buckets.
    """

    def __init__(self, pairs: bytes, triples: bytes | None, uni: Unigrams, d2: np.ndarray, d3: np.ndarray):
        h, w, c = unpack(pairs)
        h = np.cumsum(h)
        self.pair = (h << 32) | w
        p1 = uni.of(w)
        first, p2, self.alpha2 = _order(h, c, p1, d2)
        self.h1 = h[first]
        self.gain2 = np.log10(p2) - np.log10(p1)
        if triples is None:
            return
        h1, h2, w, n = unpack(triples)
        h1 = np.cumsum(h1)
        history = (h1 << 32) | h2
        low = p2[np.searchsorted(self.pair, (h1 << 32) | w)]
        first, p3, alpha3 = _order(history, n, low, d3)
        self.alpha3 = np.log10(alpha3)
        self.history = history[first]
        self.triple = (np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n)))) << 32) | w
        self.gain3 = np.log10(p3) - np.log10(low)

    def gains(self, h1: np.ndarray, w: np.ndarray, pair: np.ndarray, h2: np.ndarray, alpha2: np.ndarray) -> np.ndarray:
        """What each trigram (its bigram's number, h2) adds to the unigram score; ``alpha2`` holds logarithms."""

        def at(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.minimum(np.searchsorted(table, key), len(table) - 1)
            return k, table[k] == key

        k, seen = at(self.pair, (h1 << 32) | w)
        j, known = at(self.h1, h1)
        gain = np.where(seen, self.gain2[k], np.where(known, alpha2[j], 0.0))[pair]
        j, known = at(self.history, (h1[pair] << 32) | h2)
        k, seen = at(self.triple, (j << 32) | w[pair])
        return gain + np.where(known, np.where(seen, self.gain3[k], self.alpha3[j]), 0.0)


def _weights(batches, uni: Unigrams, d2: np.ndarray, d3: np.ndarray):
    """The backoff table: per bucket the logarithms of the weights of the bigrams' histories.

    Those of the trigrams' histories, as many as bigrams, follow in the task that
    asks for them from the bucket's tables, which spares a copy of that size.
    """
    for pdf in batches:
        out = [(row.bucket, np.log10(Bucket(row.pairs, None, uni, d2, d3).alpha2).tobytes()) for row in pdf.itertuples()]
        yield pd.DataFrame(out, columns=["bucket", "alpha2"])


class Model:
    """A trained model: its tables, and the few numbers that go with every task."""

    def __init__(self, grams: DataFrame, weights: DataFrame, salts: np.ndarray, uni: Unigrams, d2: np.ndarray, d3: np.ndarray):
        self.grams, self.weights, self.salts, self.uni, self.d2, self.d3 = grams, weights, salts, uni, d2, d3


def _counts_of_counts(vocab: DataFrame) -> tuple[int, int, list[int]]:
    times = [F.count_if(F.col("c") == r) for r in range(1, KEEP + 2)]
    tokens, words, *t = vocab.agg(F.sum("c"), F.count("*"), *times).first()
    return tokens or 0, words, t


def train(chunk: DataFrame, vocab: DataFrame) -> Model:
    """N-gram and backoff tables of the training texts in coded chunks; words are numbered below 2**31."""
    tokens, words, times = _counts_of_counts(vocab)
    # the different counts: fewer than the root of twice the tokens
    steps = np.array(vocab.groupBy("c").agg(F.min("id")).collect(), dtype=np.int64).reshape(-1, 2)
    steps = steps[np.argsort(steps[:, 1])]
    uni = Unigrams(tokens, words, times, steps[:, 1], steps[:, 0])
    buckets = max(MIN_BUCKETS, min(MANY_BUCKETS, -(-tokens // BUCKET)), -(-tokens // LARGE_BUCKET))
    # tokens after the words of each bucket; buckets of frequent words answer in several tasks.
    # Nothing follows the end of a text, but every text has a token after its begin.
    history = F.when(F.col("word") == F.lit(b""), F.lit(BEGIN)).otherwise(F.col("id"))
    sizes = vocab.groupBy(F.pmod(history, F.lit(buckets)).alias("b")).agg(F.sum("c").alias("c")).collect()
    salts = np.ones(buckets, dtype=np.int64)
    for r in sizes:
        salts[r["b"]] = -(-r["c"] // (2 * max(BUCKET, tokens // buckets)))
    counted = chunk.mapInPandas(partial(_counted, buckets=buckets), "bucket long, blob binary")
    grams = staged(counted.groupBy("bucket").applyInPandas(_grams, "bucket long, pairs binary, triples binary, times2 array<long>, times3 array<long>"), "grams", "bucket")
    got = grams.agg(*[F.sum(F.get(t, F.lit(r))) for t in ("times2", "times3") for r in range(KEEP + 1)]).first()
    d2, d3 = (discounts([n or 0 for n in part]) for part in (got[: KEEP + 1], got[KEEP + 1 :]))
    weights = staged(grams.mapInPandas(partial(_weights, uni=uni, d2=d2, d3=d3), "bucket long, alpha2 binary"), "backoff", "bucket")
    return Model(grams, weights, salts, uni, d2, d3)


def _salt(uid: int, bucket: int, salts: int) -> int:
    """Task of a chunk among those of a bucket; a chunk's number alone has its partition in the upper bits."""
    return zlib.crc32(b"%d:%d" % (uid, bucket)) % salts


def _asked(batches, salts: np.ndarray):
    """Per chunk and bucket: the distinct trigrams to score, and the texts that each stands in."""
    buckets = len(salts)
    for pdf in batches:
        for row in pdf.itertuples():
            h2, h1, w, doc, ids = _tokens(row)
            known = h1 != UNKNOWN
            h2, h1, w, doc = h2[known], h1[known], w[known], doc[known]
            order, pf, first, pair, gram = _grouped(h2, h1, w, ids, buckets)
            doc = doc[order]
            of_pair, of_gram, w, h2 = ids[h1[pf]], ids[h1[first]], ids[w[pf]], ids[h2[first]]
            pairs = dict(_cut(of_pair % buckets, buckets))
            out = []
            for b, t in _cut(of_gram % buckets, buckets):
                p, k = pairs[b], slice(*np.searchsorted(gram, (t.start, t.stop)))
                blob = pack(_steps(of_pair[p] // buckets), w[p], _steps(pair[t] - p.start), h2[t], _steps(gram[k] - t.start), doc[k])
                out.append((b, _salt(row.uid, b, int(salts[b])), row.uid, blob))
            if out:
                yield pd.DataFrame(out, columns=["bucket", "salt", "uid", "blob"])


def _stored(path: str, bucket: int, *columns: str) -> list[bytes]:
    """A bucket's row of a table that is partitioned by bucket."""
    from pyarrow import dataset, fs

    place, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/bucket={bucket}"
    if place.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    row = dataset.dataset(folder, filesystem=place, format="parquet").to_table(columns=list(columns)).to_pylist()[0]
    return [row[c] for c in columns]


def _answered(key, asked: pd.DataFrame, grams: str, weights: str, uni: Unigrams, d2: np.ndarray, d3: np.ndarray) -> pd.DataFrame:
    """What the bucket adds to the unigram score of each text of each chunk."""
    out = []
    if tables := _stored(grams, key[0], "pairs", "triples"):
        bucket = Bucket(*tables, uni, d2, d3)
        alpha2 = np.frombuffer(_stored(weights, key[0], "alpha2")[0])
        for row in asked.itertuples():
            h1, w, pair, h2, gram, doc = unpack(row.blob)
            gain = bucket.gains(np.cumsum(h1), w, np.cumsum(pair), h2, alpha2)
            texts, place = np.unique(doc, return_inverse=True)
            out.append((key[0], row.uid, pack(_steps(texts)), np.bincount(place, weights=gain[np.cumsum(gram)]).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "uid", "texts", "sums"])


def _alone(batches, uni: Unigrams):
    """What a chunk knows by itself: per text its numbers and unigram scores."""
    for pdf in batches:
        for row in pdf.itertuples():
            _, _, w, doc, ids = _tokens(row)
            c = uni.count(ids)
            n = len(row.doc_ids)
            base = np.log10((c + 1) / (uni.tokens + uni.words + 1))
            sums = [np.bincount(doc, weights=x[w], minlength=n) for x in (np.ones(len(ids)), c > 0, base, np.log10(uni.p(c)))]
            yield pd.DataFrame({"uid": row.uid, "pos": np.arange(n), "doc_id": pd.array(row.doc_ids, dtype="Int64"), "held_out": row.held, "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "alone": sums[3]})


def _summed(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket")
    texts = np.concatenate([np.cumsum(unpack(t)[0]) for t in pdf["texts"]])
    sums = np.bincount(texts, weights=np.concatenate([np.frombuffer(s) for s in pdf["sums"]]))
    return pd.DataFrame({"uid": key[0], "pos": np.arange(len(sums)), "more": sums})


def score(chunk: DataFrame, model: Model) -> DataFrame:
    """Per text of the coded chunks: doc_id, held_out, n_tokens, n_known, base_score, score."""
    asked = chunk.mapInPandas(partial(_asked, salts=model.salts), "bucket long, salt long, uid long, blob binary")
    answer = partial(_answered, grams=shared_path(model.grams), weights=shared_path(model.weights), uni=model.uni, d2=model.d2, d3=model.d3)

    def answered(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return answer(key, pdf)

    sums = asked.groupBy("bucket", "salt").applyInPandas(answered, "bucket long, uid long, texts binary, sums binary")
    more = sums.groupBy("uid").applyInPandas(_summed, "uid long, pos long, more double")
    alone = chunk.mapInPandas(partial(_alone, uni=model.uni), "uid long, pos long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, alone double")
    both = alone.join(more, ["uid", "pos"], "left")
    return both.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", (F.col("alone") + F.coalesce("more", F.lit(0.0))).alias("score"))


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2


def op3_katz(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with _shuffles_removed(spark):
        raw = chunks(docs, is_held_out())
        vocab = vocabulary(raw)
        chunk = coded(raw, vocab)
        discard(raw)
        model = train(chunk, vocab)
        discard(vocab)
        got = staged(score(chunk, model), "scores")
        discard(chunk, model.grams, model.weights)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.uni.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op3_katz": op3_katz}
ORACLES: dict[str, str] = {}
