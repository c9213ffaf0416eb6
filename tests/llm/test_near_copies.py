import random

import numpy as np

import corpus_pipeline as P
from cellwright.llm import near_copies as N
from cellwright.llm import simhash as S
from cellwright.llm.common import read


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """Smallest id of each component."""
    sets = {i: grams(t) for i, t in rows}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    for _ in range(len(sets)):
        old = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if old == group:
            break
    return sorted(set(group.values()))


def texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    licence = " ".join(r.choice(words) for _ in range(30))
    out = [(-2, None), (-1, "  "), (0, "Two words"), (1, "two  words"), (2, "two other")]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randrange(20, 300))] + licence.split()
        for edits in (0, 0, 1, 2, 4, 8):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((len(out), " ".join(w[: len(w) - r.randrange(3)])))
    return out


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute(rows)


def test_stage_takes_copies_that_four_bits_lose(spark):
    rows = texts()
    far = [(a, b) for a in rows for b in rows if a[0] < b[0] and near(grams(a[1]), grams(b[1])) and (S.fingerprint((a[1] or "").encode()) ^ S.fingerprint((b[1] or "").encode())).bit_count() > 6]
    assert far
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in far[0]], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()] == [far[0][0][0]]


def test_tables_match_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in N.drop_near_copies(docs).collect()) == brute(rows)


def test_rounds_and_tiles(spark, monkeypatch):
    r = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(300):  # one large group of texts that all differ, and texts apart
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(f"t{r.randrange(900)}" for _ in range(r.randrange(5, 80)))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hashes in (700, 1 << 18):
        monkeypatch.setattr(N.near_roots, "__defaults__", (61, hashes))
        assert sorted(x["doc_id"] for x in N.drop_near_copies(df).collect()) == brute(rows)


def test_group_at_the_edge():
    r = random.Random(6)
    base = [f"b{k}" for k in range(100)]
    texts = []
    for i in range(120):  # shares of pairs lie on both sides of 0.8
        w = list(base)
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(100)] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    rows = []
    for i, t in enumerate(texts):
        h = N.shingle_hashes(t.encode())[1]
        rows += [i, len(h), *N.lanes(h), *h.view(np.int64).tolist()]
    tile = N.Sets(np.array(rows, dtype=np.int64))
    links = N.verified(tile, tile, True)
    group = list(range(len(texts)))
    for _ in group:
        for a, b in links.tolist():
            group[a] = group[b] = min(group[a], group[b])
    assert sorted(set(group)) == brute(list(enumerate(texts))) and len(links) == len(texts) - len(set(group))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", {"a": 1}, 5, "x"), (2, "ONE two", {"a": 2}, 6, "y"), (3, "three", None, 7, "z")], "doc_id long, text string, size map<string,int>, root int, lanes string")
    got = sorted(N.drop_near_copies(df).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["size"], r["root"], r["lanes"]) for r in got] == [(1, {"a": 1}, 5, "x"), (3, None, 7, "z")]


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "A b"), (3, "A b"), (4, None), (None, "")], "doc_id long, text string")
    got = N.drop_near_copies(df).collect()
    assert sorted(r["doc_id"] for r in got) == [3, 4]
    assert N.drop_near_copies(df.limit(0)).count() == 0
