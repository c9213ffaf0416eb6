import numpy as np
from pyspark.sql import functions as F

from cellwright.llm import classifier as C


def test_shapes():
    assert [C.shape(w) for w in ("the", "The", "THE!!", "the###", "a1b22", "|", "ÉTÉ", "x-ray", "日本")] == ["a", "Aa", "A!", "a#", "a0a0", "|", "A", "a-a", "a"]


def counts(text):
    """Buckets counted one n-gram at a time."""
    words = text.split()
    word = [int(C.Words()[w]) >> 32 for w in words]
    form = [int(C.Words()[w]) & 0xFFFFFFFF for w in words]
    out, seen = {}, set()

    def add(*parts):
        k = int(np.atleast_1d(C._bucket(*parts))[0])
        out[k] = out.get(k, 0) + 1
        return k

    for i in range(len(words)):
        add(1, word[i])
        add(3, form[i])
        if i >= 1:
            pair = add(2, word[i - 1], word[i])
            add(4, form[i - 1], form[i])
            if word[i - 1] == word[i]:
                add(6)
            if pair in seen:
                add(7)
            seen.add(pair)
        if i >= 2:
            add(5, form[i - 2], form[i - 1], form[i])
    return out


def test_features_match_counts(monkeypatch):
    texts = ["the The cat sat ### on the the mat", "one", "a b a b a b", "x " * 50, "Mixed 12 words, with-marks! and more words, 12"]
    for size in (1_000_000, 1, 7):  # a text read in slices has the same features
        monkeypatch.setattr(C, "SLICE", size)
        for t in texts:
            index, value = C.sparse(t, C.Words())
            want = counts(t)
            assert sorted(want) == index.tolist()
            logs = np.log1p([want[i] for i in index.tolist()])
            assert np.allclose(value, logs / np.linalg.norm(logs), atol=1e-6)
    assert len(C.sparse(None, C.Words())[0]) == len(C.sparse(" \n", C.Words())[0]) == 0


def test_updates_match_the_definition():
    """The closed form minimises the sum of linearised losses, proximal terms and penalties."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.normal(size=3), int(rng.integers(2))) for _ in range(40)]
    model = C.Leader()
    g_sum, sigma_w, squares = np.zeros(6), np.zeros(6), np.zeros(6)
    for index, x, y in rows:
        w = model.weights(slice(None))[:6]
        p = 1 / (1 + np.exp(-(w[index] @ x)))
        g = np.zeros(6)
        g[index] = (p - y) * x
        sigma = (np.sqrt(squares + g**2) - np.sqrt(squares)) / C.ALPHA
        g_sum, sigma_w, squares = g_sum + g, sigma_w + sigma * w, squares + g**2
        model.learn(index, x, y)
        # optimum of g.w + sum sigma/2 (w - w_s)^2 + L1 |w| + (L2 + BETA/ALPHA)/2 w^2
        slope = g_sum - sigma_w
        curve = np.sqrt(squares) / C.ALPHA + C.BETA / C.ALPHA + C.L2
        best = -np.sign(slope) * np.maximum(np.abs(slope) - C.L1, 0) / curve
        assert np.allclose(model.weights(slice(None))[:6], best)


def test_one_shard_equals_plain_passes(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARDS", 1)
    rng = np.random.default_rng(1)
    rows = [(0, i, int(i % 3 > 0), np.sort(rng.choice(50, 5, replace=False)).tolist(), rng.random(5).tolist()) for i in range(30)]
    table = spark.createDataFrame(rows, "shard int, turn long, y int, index array<int>, value array<float>")
    want = C.one_pass(table, C.Leader())
    plain = C.Leader()
    for _, _, y, i, v in rows:
        plain.learn(*C._with_constant(np.array(i), np.array(v, dtype=np.float32)), y)
    assert np.allclose(want.z, plain.z) and np.allclose(want.n, plain.n)


def test_held_out_accuracy(spark):
    p = "/root/testdata/sf0.01"
    labels = C.read(spark, p, "labels").select("doc_id", "quality")
    got = C.op13_quality_classifier(spark, p)
    assert got.count() == 1000
    rows = [r for r in got.join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows) > 80
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, None), (1, ""), (None, "### $$$ ### $$$"), (2, "fine words here"), (2, "fine words here"), (3, " " * 100_000), (4, "a" * 500_000), (5, "Good Words! " * 40_000)]
    docs = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], "doc_id long, text string, score double, shard int, y int")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    w = C.train(docs, empty)
    assert not w.any() and {r[0] for r in C.score(docs.select("doc_id", "text"), w).select("score").collect()} == {0.5}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (5, 0)], "doc_id long, quality int")
    w = C.train(docs, labels)
    got = [r["score"] for r in C.score(docs.drop("score"), w).orderBy("doc_id", "text").collect()]
    assert len(got) == 8 and got[1] == got[2] == got[5] == 1 / (1 + np.exp(-w[-1]))
    assert C.score(docs.limit(0).drop("score"), w).count() == 0


def test_sample_is_bounded_and_repeats_count_once(spark):
    docs = spark.range(4000).select((F.col("id") % 2000).alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = C.labelled_sample(docs, labels, "quality", F.lit(True), rows=500)
    rows = got.collect()
    assert 400 < len(rows) < 600 and len({r["doc_id"] for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in C.labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), rows=500).collect()}
