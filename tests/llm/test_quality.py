import random
import re

from cellwright.llm import quality as Q

from .oracle import agree


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    spans = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_counts_match_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t ", "a\na\n a\n\na", "x " * 40, "ä# ß* \x0b é|<>\x85b", "one two three four five six seven eight " * 3 + "tail"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(80))) + r.choice(["", "\n"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int").drop("n_words")
    got = {x["doc_id"]: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in Q.counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_sketches_merge_and_bound_error(spark):
    df = spark.createDataFrame([(g, i + 1, 100) for g in "ab" for i in range(200)], "g string, p int, q int")
    fine = Q.sketches(df, ["g"], {"r": ("p", "q")})
    whole = Q.sketches(df, [], {"r": ("p", "q")})
    assert sorted(Q.merge(fine, []).collect()) == sorted(whole.collect())
    for b, n in whole.select("bin", "n").collect():
        assert abs(2 * Q.GAMMA**b / (Q.GAMMA + 1) - Q.GAMMA ** (b - 0.5)) <= Q.ALPHA * Q.GAMMA**b and n >= 1


def test_oracle(spark):
    p = "/root/testdata/sf0.01"
    agree(Q.op2_quality(spark, p), Q.ORACLES["op2_quality"], p)


def test_labels(spark):
    p = "/root/testdata/sf0.01"
    rows = Q.op2_quality(spark, p).join(Q.read(spark, p, "labels"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["n_words"] >= 20]
    assert sum(good) >= 0.97 * len(good)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "w " * 30, "en", None)], "doc_id long, text string, lang string, source string")
    got = Q.quality_rules(df).collect()
    assert len(got) == 3 and all(r["base_failed"] for r in got)
    assert Q.quality_rules(df.limit(0)).count() == 0


def test_thresholds_follow_their_group(spark):
    r = random.Random(8)
    rows = []
    for i in range(4000):
        source, wide = ("wide", True) if i % 2 else ("narrow", False)
        n = r.randrange(100, 200)
        many = r.random() < 0.4
        chars = int(n * r.uniform(*((3, 9) if wide else (4.8, 5.2))))
        rows.append(("en", source, n, chars, r.randrange(60) if wide and many else 0, 20, r.randrange(10) if wide and many else 0, r.randrange(30) if wide and many else 0))
    rows += [("en", "tiny", 100, 500, 0, 20, 0, 0)]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {x["source"]: x for x in Q.thresholds(df).collect()}
    for m in Q.RATIOS:
        assert got["wide"][f"high_{m}"] > 1.2 * got["narrow"][f"high_{m}"]
        assert got["narrow"][f"high_{m}"] <= got["tiny"][f"high_{m}"] <= 1.05 * got["wide"][f"high_{m}"]


def test_long_text_and_clashing_columns(spark):
    t = "word " * 400_000 + "\n" * 1000 + "$" * 1000
    rows = [(i, t if i == 0 else f"some words of text {i} " * 3, "en", "s", 1, 2, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, rows int, metric int")
    got = {r["doc_id"]: r for r in Q.quality_rules(df).collect()}
    assert len(got) == 5 and got[0]["n_words"] == 400_001 and got[0]["n_symbols"] == 1000 and got[0]["base_failed"]


def test_symbol_limit_is_no_constant(spark):
    """On the documents, groups differ in every limit, and no limit is one fixed number."""
    df = Q.staged(Q.counts(Q.read(spark, "/root/testdata/sf0.01", "documents")).drop("text"), "counts")
    rows = Q.thresholds(df).collect()
    for m in Q.RATIOS:
        found = sorted({round(r[f"high_{m}"], 6) for r in rows})
        assert len(found) >= 4 and found[-1] > 1.15 * found[0], (m, len(rows), found)


def test_foot_of_the_part_above_zero(spark):
    rows = [("a", 100, 1000, 0)] * 95 + [("a", 100, 1000, n) for n in (200, 210, 220, 230, 240)] + [("b", 100, 1000, 0)] * 50
    df = spark.createDataFrame([("en", s, n, c, k, 20, 0, 0) for s, n, c, k in rows], "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {x["source"]: x for x in Q.thresholds(df).collect()}
    for s in "ab":
        assert abs(got[s]["high_symbol_share"] - 0.2 / Q.MULTIPLE) < 0.01
        assert got[s]["high_dup_line_share"] is None  # no such text anywhere
    kept = Q.judged(df, Q.thresholds(df))
    assert kept.where("kept").count() == 145
