from collections import Counter

import corpus_pipeline as P
from cellwright.llm import decontamination as D
from cellwright.llm import mixing as M
from cellwright.llm import token_shards as T
from cellwright.llm import toxicity as X
from cellwright.llm.common import read, staged

from .test_near_copies import brute

DIR = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir=DIR):
    out = [docs]
    for name, f in P.STAGES:
        out.append(staged(f(spark, out[-1], sf_dir), "test-stage"))
    return out


def test_stages_against_brute_force(spark):
    docs = read(spark, DIR, "documents")
    raw, clean, single, free, mixed, shards = stages(spark, docs)
    for df in (clean, single, free, mixed):
        assert df.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in raw.collect()}

    model = X.train(raw, read(spark, DIR, "labels"))
    ok = [d for d, p in X.score(raw, model).select("doc_id", "score").collect() if p < 0.5]
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(ok)

    kept = brute([(d, rows[d]) for d in ok])
    assert sorted(r[0] for r in single.select("doc_id").collect()) == kept

    items = [(r["item_id"], r["text"].encode()) for r in read(spark, DIR, "benchmark").collect()]
    cells = {D.cell_of(len(D.words(t))) for _, t in items}
    indexes = [D.Index([(i, t, None) for i, t in items if D.cell_of(len(D.words(t))) == c]) for c in cells]
    without = [d for d in kept if not any(ix.matches(rows[d].encode()) for ix in indexes)]
    held = [d for d in kept if any(t.lower().split() and b" ".join(t.lower().split()) in b" ".join(rows[d].encode().lower().split()) for _, t in items)]
    assert sorted(r[0] for r in free.select("doc_id").collect()) == without and not set(held) & set(without) and held

    copies = {r["doc_id"]: r["copies"] for r in M.mix(free).collect()}
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({d: n for d, n in copies.items() if n})

    seqs = shards.collect()
    assert sorted(r["slot"] for r in seqs) == list(range(len(seqs)))
    n = sum(len(T.encoder(T.VOCABULARY).encode_ordinary(rows[d])) + 1 for d in got.elements())
    assert sum(r["n_tokens"] for r in seqs) == n
    assert {d for r in seqs for d in r["doc_ids"]} == set(got)


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, DIR).count() > 0
    for t in ("documents", "labels", "benchmark"):
        read(spark, DIR, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text here", "en", "s", 14), (3, "some text here", "en", None, 14), (3, "some text here", "en", None, 14), (4, "word " * 4000, "en", "s", 20000)]
    rows += [(5, " " * 1_000_000, "en", "s", 1_000_000), (6, "spaced" + " " * 1_000_000 + "out", "en", "s", 1_000_009), (7, "a" * 1_000_000, "en", "s", 1_000_000)]
    docs = spark.createDataFrame([(*r, 1.0, 2, {"k": 3}) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, fp int, copies map<string,int>")
    raw, clean, single, free, mixed, shards = stages(spark, docs)
    assert single.count() == 5
    for df in (clean, single, free, mixed):
        assert df.columns == docs.columns
    assert shards.count() >= 1
