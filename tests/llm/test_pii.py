import hashlib
import random
import re

from cellwright.llm import pii as P

# the kinds as a plain reading of their definition
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in re.finditer(r, text or "") if holds(k, m[0])]


def texts():
    r = random.Random(4)
    out = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5 256.1.1.1 0001.2.3.255", "4111 1111-1111 1111 41111111111111112", "+1 (234) 555-0000. +12 +1234567", "é 😀 a.b@c.de, ü 10.0.0.1", "9" * 20000 + "@x.y", "a" * 20000, "1-" * 20000 + "1", "x@y" + ".z" * 20000, "+1" + " (" * 3000]
    alphabet = ["a", "Z", "@", ".", "+", "-", " ", "1", "23", "4111111111111111", "10.2.3.4", "(", ")", "_", "%", "é", "\n", "b@c.d"]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(600)]


def test_seeds_match_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(t)], "doc_id long, text string, m string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["seed"]] for r in P.pii_spans(df).collect()}
    for i, x in enumerate(t):
        assert got[i] == brute(x), (i, x and x[:80])


def test_bootstrap_finds_unseen_numbers(spark):
    r = random.Random(5)
    seeds = [f"call me at +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} today" for _ in range(40)]
    mail = [f"write to u{r.randrange(999)}@mail.example.com please" for _ in range(60)]
    hidden = ["write to boss7@intranet please"]
    clean = [f"version {r.randrange(1, 9)} of the text" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(seeds + mail + hidden + clean)), "doc_id long, text string")
    got = {x["doc_id"]: [(s["kind"], s["value"], s["seed"]) for s in x["spans"]] for x in P.pii_spans(df).collect()}
    assert got[100] == [("email", "boss7@intranet", False)]
    assert all(len(got[i]) == 1 for i in range(100)) and all(not got[i] for i in range(101, 141))


def test_query_digest(spark):
    p = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in P.read(spark, p, "documents").collect()}
    for r in P.op4_pii(spark, p).collect():
        want = brute(docs[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in want) for k in RULES]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in P.pii_spans(df).collect()) == [0, 1, 1]
    assert P.pii_spans(df.limit(0)).count() == 0


def test_tokens_that_touch_seeds(spark):
    r = random.Random(15)
    seeds = [(u, "email", a, a + r.randrange(1, 12)) for u in range(6) for a in r.sample(range(200), 9)]
    tokens = [(u, a, a + r.randrange(1, 9), f"m{u}-{a}", "l", "r") for u in range(6) for a in r.sample(range(200), 40)]
    got = P._seeded(spark.createDataFrame(seeds, "uid long, kind string, start long, end long"), spark.createDataFrame(tokens, "uid long, start long, end long, m string, left string, right string"))
    want = {m: any(u == v and s < e and a < t for v, _, s, t in seeds) for u, a, e, m, _, _ in tokens}
    assert {x["m"]: x["kind"] is not None for x in got.collect()} == want
