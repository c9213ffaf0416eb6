import re
from collections import Counter
from itertools import permutations

import pytest

from cellwright.llm import filter_audit as A

from .oracle import agree

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """All rows by applying every order to every document."""
    fails = []
    for d, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        same = [x for x, t, _ in docs if (t or "") == text and x is not None]
        fails.append("".join(c for c, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and d > min(same),
        )) if f))
    good = [any(x == d and d is not None and q == 1 for x, q, _ in labels) for d, _, _ in docs]
    toxic = [any(x == d and d is not None and t == 1 for x, _, t in labels) for d, _, _ in docs]
    out, shapley = {}, Counter()
    for part in {p or "" for _, _, p in docs}:
        own = [i for i, (_, _, p) in enumerate(docs) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                failing = {i for i in own if f in fails[i]}
                out[part, order, step] = [len(left - gone), len(gone), len(failing - left), sum(fails[i] == f for i in own), sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
                shapley[part, f] += len(gone)
                left -= gone
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_sql(spark):
    agree(A.op12_filter_audit(spark, DIR), A.ORACLES["op12_filter_audit"], DIR)


def test_against_brute_force_with_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(250))
    docs = [(1, words, "en"), (2, words, "en"), (3, words, "de"), (3, words, "de"), (None, words, "en"), (4, None, None), (5, "", ""), (6, "A B # A", "en"), (7, "a " * 300, "fr"), (None, None, "fr"), (0, words + " #", None)]
    docs += [(8, "x" * 200_000, "en"), (9, "Z y " * 150, "en"), (9, "Z y " * 150, "de")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (6, None, 1), (9, 1, 1), (77, 1, 1)]
    df = spark.createDataFrame([(*r, 5, {"m": 1}) for r in docs], "doc_id long, text string, lang string, n long, own map<string,int>")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(A.audit(df, lab))
    assert got == brute(docs, labels) and len(got) == 600 * 4


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(df, lab).count() == 0
    one = spark.createDataFrame([(1, "a", None)], df.schema)
    assert rows(A.audit(one, lab)) == brute([(1, "a", None)], [])


@pytest.mark.parametrize("filters", ["A", "AB", "ABC"])
def test_survivors_of_every_subset(spark, filters):
    masks = [(p, m, (m * 7 + len(p)) % 5, m % 3, m % 2) for p in ("x", "yy") for m in range(1 << len(filters)) if m % 4 != 2]
    got = {r["part"]: r for r in A.survivors(spark.createDataFrame(masks, "part string, mask int, n long, good long, toxic long"), filters).collect()}
    for p in ("x", "yy"):
        for s in range(1 << len(filters)):
            for k, kind in enumerate(A.KINDS, 2):
                assert got[p][kind][s] == sum(r[k] for r in masks if r[0] == p and not r[1] & s)
