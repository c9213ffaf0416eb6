import random

import numpy as np
import xxhash

from cellwright.llm import simhash as S


def brute_print(text):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    comp = {i: i for i in range(len(rows))}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                comp[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {(rows[i][0], f"{rows[i][1]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows))}


def texts():
    r = random.Random(1)
    out = [None, "", "  \t ", "One", "one two three", "ONE Two three four", "Äpfel ÄPFEL äpfel x y", "a b c d " * 5000]
    base = [" ".join(r.choice("the of a in tion es ing".split()) + str(r.randrange(9)) for _ in range(r.randrange(1, 300))) for _ in range(40)]
    for b in base:
        out += [b] * r.choice([1, 1, 3])
        w = b.split()
        for _ in range(6):
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    t = texts()
    rows = [(i if i % 17 else None, x, "e") for i, x in enumerate(t)] + [(3, "One", "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.simhash_components(df)
    got = {(r[0], f"{r[1] & (2**64 - 1):016x}", r[2]) for r in got.collect()}
    assert got == brute_components([(d, brute_print(x)) for d, x, _ in rows])


def test_tiles_and_chains(spark):
    r = np.random.default_rng(2)
    x = [int(r.integers(0, 2**63))]
    for _ in range(300):  # a chain, each link at most 4 bits
        y = x[-1]
        for b in r.choice(63, 4, replace=False):
            y ^= 1 << int(b)
        x.append(y)
    x = sorted(set(x) | {int(v) for v in r.integers(0, 2**63, 500)})
    df = spark.createDataFrame([(v,) for v in x], "fp long")
    roots = {a: b for a, b in S.components(S.links(df, tile=37)).collect()}
    want = brute_components([(v, v) for v in x])
    assert {(v, f"{v:016x}", roots.get(v, v)) for v in x} == want


def test_tiles_left_empty(spark):
    r = np.random.default_rng(3)
    x = [int(v) for v in r.integers(0, 2**63, 40)]
    x = sorted({*x, *(v ^ 5 for v in x[:20]), *(v ^ 1 << 40 for v in x[10:30])})
    df = spark.createDataFrame([(v,) for v in x], "fp long")
    roots = {a: b for a, b in S.components(S.links(df, tile=1)).collect()}
    assert {(v, f"{v:016x}", roots.get(v, v)) for v in x} == brute_components([(v, v) for v in x])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 50)
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000))
    rows = [(None, long, "a", 1, "b"), (7, long, "c", 2, "d"), (7, long, "c", 2, "d"), (None, None, "e", 3, "f"), (None, "", "g", 4, "h"), (8, "x y", "i", 5, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, id int, body string")
    got = sorted(((r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in S.simhash_components(df).collect()), key=repr)
    p = f"{brute_print(long):016x}"
    assert got == sorted([(None, p, 7), (7, p, 7), (7, p, 7), (None, "0" * 16, None), (None, "0" * 16, None), (8, f"{brute_print('x y'):016x}", 8)], key=repr)
