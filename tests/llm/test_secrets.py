import hashlib
import random
import re
from collections import Counter
from math import log2

from cellwright.llm import secrets as S


def brute(text):
    t = text or ""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def texts():
    r = random.Random(6)
    out = [None, "", "password=abcdef", "PassWord : 'x+/=._-1", "toKen=abcdefgh", "token = \"" + "0a" * 20 + '"', "AKIA" + "A1" * 8, "a" * 50, "é" * 30 + " passwd=123456"]
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789ab", "\n", "é", "."]
    return out + ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(800)]


def test_base_matches_brute_force():
    for t in texts():
        assert [s for s in S.scan(t) if s[2] != "entropy"] == brute(t), t


def test_incremental_entropy():
    r = random.Random(7)
    s = "".join(r.choice("abcdef0123456789XYZ") for _ in range(200))
    for i, e in enumerate(S.window_entropies(s)):
        c = Counter(s[i : i + S.WINDOW])
        assert abs(e + sum(n / S.WINDOW * log2(n / S.WINDOW) for n in c.values())) < 1e-9


def test_entropy_finds_keys_and_spares_words():
    r = random.Random(8)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    assert [s[2] for s in S.scan(f"the key {key} here")] == ["entropy"]
    for t in ("internationalization-of-the-words", "src/main/java/org/example/project", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01/2024-12-31_00000", "=" * 40, "thisIsALongCamelCaseIdentifier", "zzzzzzzzzzzzzzzzzzzzzzzz1"):
        assert S.scan(t) == [], t


def test_keys_are_found_whole():
    r = random.Random(9)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"base32": upper + "234567", "base36": upper.lower() + digits, "base64": upper + upper.lower() + digits + "+/"}
    for name, alphabet in kinds.items():
        for n in (16, 18, 20, 40, 128):
            missed = 0
            for _ in range(1000):
                key = "".join(r.choice(alphabet) for _ in range(n))
                found = {i for a, b, k in S.scan(f"the key {key} here") for i in range(a, b)}
                missed += not found >= set(range(8, 8 + n))
            # letters of one case only, 3.6 % of 16 characters of base-32, are no key
            assert missed <= (40 if n >= 20 else 90), (name, n, missed)


def spans_by_windows(s):
    """Every window on its own, then stretches of windows, then their characters."""
    size = 20 if len(s) >= 20 else 16
    if len(s) < size or any(p.fullmatch(s) for p in S.ALLOWED):
        return set()
    state = []
    for i in range(len(s) - size + 1):
        w = s[i : i + size]
        e = -sum(n / size * log2(n / size) for n in Counter(w).values())
        kind = "hex" if set(w) <= set("0123456789abcdef") or set(w) <= set("0123456789ABCDEF") else "base36" if w.isalnum() and (w == w.lower() or w == w.upper()) else "base64"
        high, low = S.BOUNDS[size][kind]
        state.append((e >= low, e >= high and S._opens(w)))
    chars = set()
    for i, (_, opens) in enumerate(state):
        if opens:
            a = b = i
            while a > 0 and state[a - 1][0]:
                a -= 1
            while b + 1 < len(state) and state[b + 1][0]:
                b += 1
            chars |= set(range(a, b + size))
    return chars


def test_spans_match_all_windows():
    r = random.Random(11)
    alphabets = ["0123456789abcdef", "ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "aab1", "-_/"]
    found = 0
    for _ in range(3000):
        s = "".join("".join(r.choice(a) for _ in range(r.randrange(1, 25))) for a in r.choices(alphabets, k=r.randrange(1, 5)))
        spans = S.entropy_spans(s)
        assert {i for a, b in spans for i in range(a, b)} == spans_by_windows(s), s
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        found += bool(spans)
    assert 500 < found < 2900


def test_addresses_are_no_keys():
    key = "q7Xz0LpV9sKd3TfYb1Rw"
    for t in (
        "https://example.com/blog/2024/01/15/how-to-bake-bread-with-4-eggs-and-2-cups", "https://x.org/items/123e4567-e89b-12d3-a456-426614174000/page2/images_640x480",
        "photo_2021-05-17_at_10-22-33_copy2", "/static/js/main-v2/app3/vendor12/index", "internationalization1", "ISBN-978-3-16-148410-0",
    ):
        assert S.scan(t) == [], t
        assert [t2[2] for t2 in S.scan(f"{t} {key}")] == ["entropy"]
    assert [s[:2] for s in S.scan(f"/a/123e4567-e89b-12d3-a456-426614174000/{key}")] == [(39, 60)]
    assert S.scan("0123456789ABCDEF"[:15]) == []


def test_every_key_of_a_candidate():
    r = random.Random(10)
    one, two = ("".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40)) for _ in range(2))
    text = f"x {one}{'-' * 30}{two} and {'deadbeef' * 4}{two}"
    found = {i for a, b, k in S.scan(text) for i in range(a, b)}
    for at in (text.index(one), text.index(two), text.rindex(two)):
        assert found >= set(range(at, at + 40))
    spans = sorted((a, b) for a, b, _ in S.scan(text))
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    # letters alone, in mixed case
    assert [s[2] for s in S.scan("qWzKpLxTbNvRcJhGdFsYmAeU")] == ["entropy"]


def test_query(spark):
    p = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in S.read(spark, p, "documents").collect()}
    rows = S.op7_secrets(spark, p).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in want) for k in S.KINDS[:3])


def test_edges(spark):
    df = spark.createDataFrame([(1, "token=abcdef", "x"), (1, "token=abcdef", "x"), (None, None, None)], "doc_id long, text string, spans string")
    assert sorted(len(r["spans"]) for r in S.secret_spans(df).collect()) == [0, 1, 1]
    assert S.secret_spans(df.limit(0)).count() == 0


def test_long_candidates():
    key = "Q7xz0LpV9sKd3TfYb1Rw"
    slug = "ab-12/" * 30_000
    assert S.scan(slug) == [] and S.scan("=" * 200_000) == []
    (a, b, kind), = S.scan(slug + key)
    assert kind == "entropy" and a > len(slug) - 20 and b == len(slug) + 20
    whole = key * 10_000
    assert S.scan(whole) == [(0, len(whole), "entropy")]
