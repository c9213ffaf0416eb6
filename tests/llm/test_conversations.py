import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from cellwright.llm import conversations as V

from .oracle import agree

DIR = "/root/testdata/sf0.01"
ROLE = {"u": "user", "a": "assistant"}


def cheapest(initials, must_go, extra):
    """(cost, audit) over every string of edits, by enumeration."""
    best = None
    n = len(initials)

    def go(i, roles, cost, audit, run):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if run < 3:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", run + 1)
        if i < n:
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if not must_go[i]:
                go(i + 1, roles + initials[i], cost + extra[i], audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + extra[i], audit + "R", 0)

    best = (4 * n, "D" * n)
    go(0, "", 0, "", 0)
    return best


def edits(initials, must_go, extra):
    codes = np.array([V.INITIALS.find(c) if c in V.INITIALS else V.OTHER for c in initials], dtype=np.int64)
    return V.Edits(codes, np.array(must_go, dtype=bool), np.array(extra, dtype=np.int64))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_conversation(n):
    for initials in product("suax", repeat=n):
        for kind in product((0, 1, 2), repeat=n):
            must, extra = [k == 1 for k in kind], [3 * (k == 2) for k in kind]
            e = edits(initials, must, extra)
            assert (e.cost, e.audit()) == cheapest(initials, must, extra), (initials, kind)


def test_random_longer_conversations():
    rng = np.random.default_rng(3)
    for _ in range(25):
        n = int(rng.integers(4, 6))
        initials = [str(c) for c in rng.choice(list("suaux"), n)]
        kind = rng.choice([0, 0, 0, 1, 2], n)
        e = edits(initials, kind == 1, 3 * (kind == 2))
        assert (e.cost, e.audit()) == cheapest(initials, kind == 1, 3 * (kind == 2))


def test_tight_arcs_are_those_of_the_cheapest_paths():
    """A node's forward and backward cost meet the optimum exactly on paths that enumeration finds."""
    e = edits("uu", [False, False], [0, 0])
    # U U: insert an assistant after each (6) or rerole the second (3)
    assert e.cost == 3 and e.audit() == "KR"
    tight = e.tight()
    assert tight[0, 0] == 1 << V.LETTERS.index("K") and tight[1, 2] == 1 << V.LETTERS.index("R") and tight[2, 3] == 0


def brute(rows):
    """Rows of the operator from (conv_id, turn, role, text), one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            p = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if p == 1:
                text = ""
            if p == 2:
                text = re.sub("[.!?]", "", text)
            own += [(turn, "user" if p == 4 else role, text)] * (0 if p == 0 else 2 if p == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit = cheapest([r[1][:1] or "x" for r in own], [f in ("blank", "duplicate") for f in faults], [3 * (f == "truncated") for f in faults])
        lines, left = [], iter(own)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            state = "".join(x[0] for x in lines)
            role = row[1] if letter == "K" else ROLE["a" if state.endswith("u") else "u"]
            lines.append((role[:1], f"{role}:{row[2] if row else ''}"))
        digest = hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in V.repair(V.damaged(df)).collect()}


def test_matches_sql(spark):
    agree(V.op11_conversation_repair(spark, DIR), V.ORACLES["op11_conversation_repair"], DIR)


def test_odd_rows_against_enumeration(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (2, None, None, None), (2, None, "user", "No end"), (2, 7, "user", "Fine!  \n")]
    rows += [(None, 3, "system", "Rules."), (None, 4, "user", "é ü."), (None, 9, "assistant", "ok.")]
    rows += [(k, t, r, x) for k in range(3, 60) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Why?"), ("user", "Why?"), ("assistant", "because")][: 1 + k % 4])]
    rows += [(100, -(2**62), "user", "a."), (100, 2**62, "assistant", "b."), (101, 5, "", ""), (102, 1, "tool", "x" * 300_000 + "."), (103, 1, "user", " \t\r\n")]
    df = spark.createDataFrame([(*r, 1, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, kind int, audit string, h1 int")
    have, want = got(df), brute(rows)
    assert set(have) == set(want)
    for k in want:
        assert have[k] == want[k], k
    text_ids = spark.createDataFrame([(str(r[0]), *r[1:]) for r in rows[:3]], "conv_id string, turn int, role string, text string")
    assert got(text_ids)["1"] == want[1]


def test_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert got(spark.createDataFrame([], schema)) == {}
    k = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(k, 0, "user", "Hi.")], schema)) == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_runs_cross_batches(spark):
    """Conversations longer than an Arrow batch are one run, in both streams."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for k in range(40) for t in range(1 + k % 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = got(df)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert got(df) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_very_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    r = V.repair(V.damaged(rows)).collect()
    assert len(r) == 1 and r[0]["gaps"] > 1000 and r[0]["audit"].count("K") > 20_000
