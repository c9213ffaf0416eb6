import math
import random
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from cellwright.llm import katz as K


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


class Brute:
    """The model as plain dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip([None, *w[:-1]], w))
        self.n = sum(self.uni.values())
        self.d1 = K.discounts([sum(c == r for c in self.uni.values()) for r in range(1, 7)])
        self.d2 = K.discounts([sum(c == r for c in self.bi.values()) for r in range(1, 7)])
        raw = {w: c * self.d1[min(c, 6)] / self.n for w, c in self.uni.items()}
        free = 1 - sum(raw.values())
        least = 1 / (self.n + 1)
        scale = 1 if free >= least else (1 - least) / (1 - free)
        self.p1 = {w: p * scale for w, p in raw.items()}
        self.unknown = max(free, least)
        self.tri = Counter()
        for t in texts:
            w = tokens(t)
            self.tri.update(zip(zip([None, None, *w[:-2]], [None, *w[:-1]]), w))
        self.d3 = K.discounts([sum(c == r for c in self.tri.values()) for r in range(1, 7)])
        self.rows = {}
        for counts, d in ((Counter({((h,), w): c for (h, w), c in self.bi.items()}), self.d2), (self.tri, self.d3)):
            after = {}
            for (h, w), c in counts.items():
                after.setdefault(h, {})[w] = c
            done = {}
            for h, ws in after.items():
                total = sum(ws.values())
                p = {w: c * d[min(c, 6)] / total for w, c in ws.items()}
                if 1 - sum(p.values()) < 1e-12:
                    p = {w: x * total / (total + 1) for w, x in p.items()}
                done[h] = (p, (1 - sum(p.values())) / (1 - sum(self.p(h[1:], w) for w in ws)))
            self.rows |= done

    def p(self, h, w):
        if not h:
            return self.p1.get(w, self.unknown)
        if h not in self.rows:
            return self.p(h[1:], w)
        p, alpha = self.rows[h]
        return p[w] if w in p else alpha * self.p(h[1:], w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(h, x)) for h, x in zip(zip([None, None, *w[:-2]], [None, *w[:-1]]), w))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def compare(rows, docs):
    train = [t for i, t in docs if not held(i)]
    m = Brute(train)
    want = Counter()
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((m.uni[x] + 1) / (m.n + len(m.uni) + 1)) for x in w)
        want[(i, held(i), len(w), sum(m.uni[x] > 0 for x in w), m.n, round(base, 4), round(m.score(t), 4))] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in rows)
    assert got == want
    return m


def run(spark, docs, monkeypatch=None):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    raw = K.chunks(df, K.is_held_out())
    vocab = K.vocabulary(raw)
    chunk = K.coded(raw, vocab)
    model = K.train(chunk, vocab)
    return [r.asDict() | {"train_tokens": model.uni.tokens} for r in K.score(chunk, model).collect()]


def test_matches_brute_force(spark):
    r = random.Random(12)
    words = ["the", "The", "of", "a", "é", *[f"w{i}" for i in range(150)]]
    docs = [(i, " ".join(r.choice(words[: r.choice([5, 155])]) for _ in range(r.randrange(0, 120)))) for i in range(200)]
    docs += [(201, None), (None, "the of"), (5, "again again"), (5, "again again"), (2, "x" * 5000)]
    m = compare(run(spark, docs), docs)
    words = [*m.uni, b"never seen"]
    some = [None, *list(m.uni)[:30], b"unseen"]
    for h in [*((w,) for w in some), *list(m.rows)[:-40:-1], (None, None), *zip(some, some[1:])]:
        assert abs(sum(m.p(h, w) for w in words) - 1) < 1e-9


def test_frequent_words_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 50)
    monkeypatch.setattr(K, "CHUNK", 200)
    monkeypatch.setattr(K, "HELD", 60)
    r = random.Random(14)
    docs = [(i, " ".join("a" if r.random() < 0.5 else f"w{r.randrange(60)}" for _ in range(r.randrange(0, 60)))) for i in range(150)]
    m = compare(run(spark, docs), docs)
    assert m.uni[b"a"] > 4 * 50
    odd = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, uid long, held int, body string")
    chunk = K.coded(K.chunks(odd, K.is_held_out()), K.vocabulary(K.chunks(odd, K.is_held_out())))
    assert chunk.selectExpr("sum(size(doc_ids))").first()[0] == 150


def test_whole_table(spark):
    p = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in K.read(spark, p, "documents").collect()]
    compare([r.asDict() for r in K.op3_katz(spark, p).collect()], docs)


def test_held_out_gains(spark):
    rows = [r for r in K.op3_katz(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_packing():
    r = np.random.default_rng(13)
    a = [r.integers(0, top, n) for top, n in ((5, 10), (300, 7), (1 << 20, 1), (1 << 40, 100), (9, 0))]
    assert all((x == y).all() for x, y in zip(a, K.unpack(K.pack(*a))))


def test_edges(spark):
    assert run(spark, []) == []
    rows = run(spark, [(i, "nothing to learn") for i in range(2000) if held(i)][:3])
    assert len(rows) == 3 and all(r["n_known"] == 0 and r["score"] == 0 for r in rows)


def test_salts_follow_histories(spark, monkeypatch):
    """The begin of texts is a history of as many tokens as there are texts, their end of none; salts deal chunks evenly."""
    monkeypatch.setattr(K, "BUCKET", 500)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50).alias("text"))
    raw = K.chunks(docs, F.lit(False))
    vocab = K.vocabulary(raw)
    model = K.train(K.coded(raw, vocab), vocab)
    salts = model.salts
    n = len(salts)
    assert salts[K.BEGIN % n] >= 4
    for m in (2, 4, 8, 7):
        for b in (0, K.BEGIN % n):
            dealt = np.bincount([K._salt(p << 33, b, m) for p in range(800)], minlength=m)
            assert dealt.min() > 0.6 * 800 / m and dealt.max() < 1.5 * 800 / m


def chunk_rows(texts, held=None):
    import pyarrow as pa

    n = len(texts)
    batch = pa.record_batch({"doc_id": pa.array([None if i == 1 else i for i in range(n)], pa.int64()), "held": pa.array([bool(held and held[i]) for i in range(n)]), "body": pa.array(texts, pa.binary())})
    return pa.Table.from_batches(list(K._chunks(iter([batch])))).to_pandas()


def test_words_of_chunks(monkeypatch):
    monkeypatch.setattr(K, "PIECE", 40)
    monkeypatch.setattr(K, "CHUNK", 30)
    texts = [b"  A b\tC\x0b\x0cd\r\n e ", b"", None, b"x", b" \n", b"\xc3\x80\xff q\x1c\x85r \xe2\x80\x83Z", b"w " * 70, b"A a", "ÄÖ É".encode()] * 3
    got = []
    for row in chunk_rows(texts, [i % 2 for i in range(len(texts))]).itertuples():
        codes, = K.unpack(row.codes)
        ends = np.cumsum(np.frombuffer(row.lens, "<i4"))
        got += [[row.words[c] for c in codes[a:b]] for a, b in zip(np.append(0, ends), ends)]
        trained = [c for a, b, h in zip(np.append(0, ends), ends, row.held) if not h for c in codes[a:b]]
        assert list(row.n) == np.bincount(trained, minlength=len(row.words)).tolist() and len(set(row.words)) == len(row.words)
    assert got == [[*(t or b"").lower().split(), b""] for t in texts]


def test_memory_of_a_chunk():
    import tracemalloc

    r = np.random.default_rng(7)
    row = chunk_rows([b" ".join(b"w%d" % x for x in r.zipf(1.3, 2000) % 20000) for _ in range(200)])
    assert len(row) == 1
    words = len(row["words"][0])
    row["uid"], row["own"] = 0, [K.pack(np.arange(words), np.arange(words) + K.FIRST)]
    tracemalloc.start()
    assert len(next(K._asked(iter([row]), np.ones(16, dtype=np.int64)))) == 16
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * 200 * 2001
