import os

import numpy as np
from pyspark.sql import functions as F

from cellwright.llm import token_shards as T


def test_permutation_is_keyed_and_invertible():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        y = T.permute(x, n)
        assert sorted(y) == list(x)
        assert (T.permute(y, n, inverse=True) == x).all()
    y = T.permute(np.arange(5000), 5000)
    assert (y != T.permute(np.arange(5000), 5000, key=7)).mean() > 0.99
    assert abs(np.corrcoef(np.arange(5000), y)[0, 1]) < 0.05


def texts(path, rows):
    """Texts of each task, read back from the shards through the inverse of the permutation."""
    got = {s: t for s, t in T.read_slots(path)}
    out = []
    decode = T.encoder(T.VOCABULARY).decode_bytes
    for part in sorted({r["part"] for r in rows}):
        own = sorted((r["k"], r["slot"], r["n_tokens"]) for r in rows if r["part"] == part)
        ids = np.concatenate([got[s][:n] for _, s, n in own]).tolist()
        while ids:
            end = ids.index(T.END)
            out.append(decode(ids[:end]).decode())
            ids = ids[end + 1 :]
    return out


def test_exact_round_trip(spark, tmp_path):
    docs = T.read(spark, "/root/testdata/sf0.001", "documents").repartition(3)
    path = f"file://{tmp_path}/s"
    rows = T.write_shards(docs, path, slots=16, length=64).collect()
    want = sorted(r["text"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).collect())
    assert sorted(texts(path, rows)) == want
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == r["slot"] % 16 * 128 and r["shard"] == r["slot"] // 16 for r in rows)
    n = len(rows)
    assert [s for s, _ in T.read_slots(path, n // 2, 40)] == list(range(n // 2, n // 2 + 40))
    assert {f for f in os.listdir(tmp_path / "s")} == {"manifest.json", *(f"shard-{k:08d}.bin" for k in range(-(-n // 16)))}
    assert {i for r in rows for i in r["doc_ids"]} == {r[0] for r in docs.select("doc_id").collect()}


def test_edges(spark, tmp_path):
    rows = [(1, None, "x"), (None, "", "x"), (2, "two two", "x"), (2, "two two", "x"), (3, "long " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").coalesce(1)
    path = f"file://{tmp_path}/a"
    got = T.write_shards(df, path, length=32, slots=8).collect()
    assert sorted(texts(path, got)) == sorted(t or "" for _, t, _ in rows)
    first = next(r for r in got if r["k"] == 0)
    assert first["doc_ids"][:4] == [1, None, 2, 2]
    assert T.write_shards(df.limit(0), f"file://{tmp_path}/b").count() == 0
    assert list(T.read_slots(f"file://{tmp_path}/b")) == []


def test_any_text_is_encoded(spark, tmp_path):
    plain = T.encoder(T.VOCABULARY).encode_ordinary
    for t in (" " * 20_000, "a" + " " * 20_000, " " * 20_000 + "b", "a" + "\t \n　" * 5000 + "b c", "x" + "\n" * 12_000 + " y" + " " * 30_000 + "z", "\x1c" * 12_000 + " q"):
        assert T.encode_text(t) == plain(t)
    long = [" " * 5_000_000, " " * 1_000_000 + "x", "a" * 5_000_000, "ab 1  \n" * 700_000, "word" + " \n" * 2_500_000 + "word"]
    path = f"file://{tmp_path}/long"
    rows = T.write_shards(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").coalesce(1), path).collect()
    assert sorted(texts(path, rows)) == sorted(long)
