"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

Edits form a layered graph: a node is (rows consumed, state of the role grammar),
an arc is Keep, Rerole or Delete of the next row or Insert of an empty turn. The
grammar is ``(s?(ua)+)?`` over role initials. Forward and backward minimum costs
over the layers tell which arcs are tight, that is, lie on some cheapest path.
From the start a set of nodes moves along tight arcs, at each step along the
least letter that any of its nodes offers; it ends at the first final node. That
spells the cheapest edits that are least in ASCII order.

Two streams over rows sorted by conversation do the work. The first knows of each
row only its initial, its faults and two hashes, so a conversation of any length
takes some bytes a row there, no more than its own audit string and costs. The
second has the texts: a conversation's audit comes first, the repaired lines
follow and run through the digest one by one, so no conversation's texts are ever
held together. One digest over all of a conversation is sequential by definition;
nothing else is.

Faults, the first that holds counts: blank (no word), duplicate (role and text
equal an earlier row), truncated (the last character of a word is not ``[.!?]``).
Costs: Keep 0, Rerole 3, Delete 4 (the only edit for blank and duplicate rows),
Insert 3, and 3 more for a truncated row that stays.

Defined cases: null roles and texts count as one space; null turns come first;
rows of one turn come by role and then by hash of their text; a null conv_id is a
conversation of its own; a conversation without rows after damage gives zeros, an
empty audit and the digest of nothing; gaps are cut at the largest long; repeated
rows are duplicates; an empty table returns no rows; only the four columns named
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: Initials as numbers; any other initial is OTHER.
INITIALS, OTHER = "sua", 3
ROLES = {"u": "user", "a": "assistant"}
#: Grammar ``(s?(ua)+)?``. States: nothing yet, after s, after u, after a. -1: not allowed.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The role that Insert and Rerole write in each state, and the state after it.
WRITTEN, AFTER = "uuau", np.array([2, 2, 3, 2])
FINAL = np.array([True, False, False, True])
#: Cost of what is impossible.
NEVER = np.int64(1) << 40
#: Letters of the edits, as bits of tight arcs in ASCII order.
LETTERS = "DIKR"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage that crc32 of ``conv_id:turn`` picks; a dropped row stays, marked gone."""
    space = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    hurt = F.when(part == 1, "").when(part == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(part == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), (part == 0).alias("gone"), F.when(part == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def sort_keys() -> list[Column]:
    """Order of a conversation's rows."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def keyed(rows: DataFrame) -> DataFrame:
    """Add the hashes that rows of a turn are ordered by and duplicates are found by."""
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


def facts(rows: DataFrame) -> DataFrame:
    """Rows without their texts: initial, blank, truncated, hashes."""
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).cast("int") - 1
    initial = F.when((F.col("role") == "") | (initial < 0), OTHER).otherwise(initial)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    return rows.select("conv_id", "turn", "role", "h1", "h2", "gone", initial.cast("int").alias("initial"), blank.alias("blank"), cut.alias("cut"))


class Edits:
    """Minimum costs and tight arcs of one conversation.

    ``initial``: number of each row's role initial; ``must_go``: rows that only
    Delete may take; ``extra``: what a row costs beside its edit while it stays.
    """

    def __init__(self, initial: np.ndarray, must_go: np.ndarray, extra: np.ndarray):
        self.n = len(initial)
        stays = np.where(must_go, NEVER, extra)[:, None]
        self.keep_to = NEXT[:, initial].T.copy()  # state after Keep, by row and state
        self.keep = np.where(self.keep_to >= 0, stays + KEEP_COST, NEVER)
        self.rerole = np.broadcast_to(stays + REROLE_COST, (self.n, 4))
        self.forward = self._forward()
        self.backward = self._backward()
        self.cost = int(self.backward[0, 0])

    def _forward(self) -> np.ndarray:
        out = np.full((self.n + 1, 4), NEVER)
        now = [0, NEVER, NEVER, NEVER]
        keep_to, keep, rerole = self.keep_to.tolist(), self.keep.tolist(), self.rerole.tolist()
        after = AFTER.tolist()
        for i in range(self.n + 1):
            for _ in range(2):  # a cheapest path inserts two turns in a row at most
                for q in range(4):
                    now[after[q]] = min(now[after[q]], now[q] + INSERT_COST)
            out[i] = now
            if i == self.n:
                break
            then = [c + DELETE_COST for c in now]
            for q in range(4):
                if keep[i][q] < NEVER:
                    then[keep_to[i][q]] = min(then[keep_to[i][q]], now[q] + keep[i][q])
                then[after[q]] = min(then[after[q]], now[q] + rerole[i][q])
            now = [min(c, int(NEVER)) for c in then]
        return out

    def _backward(self) -> np.ndarray:
        out = np.full((self.n + 1, 4), NEVER)
        now = [0 if f else int(NEVER) for f in FINAL]
        keep_to, keep, rerole = self.keep_to.tolist(), self.keep.tolist(), self.rerole.tolist()
        after = AFTER.tolist()
        for i in range(self.n, -1, -1):
            if i < self.n:
                then = [min(now[q] + DELETE_COST, now[after[q]] + rerole[i][q], NEVER) for q in range(4)]
                for q in range(4):
                    if keep[i][q] < NEVER:
                        then[q] = min(then[q], now[keep_to[i][q]] + keep[i][q])
                now = then
            for _ in range(2):
                now = [min(now[q], now[after[q]] + INSERT_COST) for q in range(4)]
            out[i] = now
        return out

    def tight(self) -> np.ndarray:
        """Bits of the letters, by node: arcs on some cheapest path."""
        out = np.zeros((self.n + 1, 4), dtype=np.uint8)
        f, b = self.forward, self.backward
        out |= (f + INSERT_COST + b[:, AFTER] == self.cost).astype(np.uint8) << 1
        if self.n:
            f = f[:-1]
            out[:-1] |= (f + DELETE_COST + b[1:] == self.cost).astype(np.uint8)
            kept = np.take_along_axis(b[1:], np.maximum(self.keep_to, 0), axis=1)
            out[:-1] |= ((self.keep < NEVER) & (f + self.keep + kept == self.cost)).astype(np.uint8) << 2
            out[:-1] |= ((self.rerole < NEVER) & (f + self.rerole + b[1:][:, AFTER] == self.cost)).astype(np.uint8) << 3
        return out

    def target(self, i: int, q: int, letter: str) -> tuple[int, int]:
        if letter == "D":
            return i + 1, q
        if letter == "K":
            return i + 1, int(self.keep_to[i, q])
        return i + (letter == "R"), int(AFTER[q])

    def audit(self) -> str:
        """Least string of edits among the cheapest, by a set of nodes that moves along tight arcs."""
        tight, out = self.tight(), []
        layer, states = 0, {0}
        while not (layer == self.n and any(FINAL[q] for q in states)):
            offered = 0
            for q in states:
                offered |= int(tight[layer, q])
            least = (offered & -offered).bit_length() - 1
            targets = {self.target(layer, q, LETTERS[least]) for q in states if tight[layer, q] >> least & 1}
            layer, states = next(iter(targets))[0], {q for _, q in targets}
            out.append(LETTERS[least])
        return "".join(out)


def first_faults(blank: np.ndarray, cut: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(duplicate, truncated) of rows in order; a row's first fault counts."""
    seen = np.zeros(len(blank), dtype=bool)
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    seen[order[1:][same]] = True
    duplicate = seen & ~blank
    return duplicate, cut & ~blank & ~duplicate


def _judged(run: pa.Table) -> dict:
    """Counts, cost and audit of one conversation's rows."""
    run = run.filter(pa.compute.invert(run["gone"]))
    blank, cut = (run[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "cut"))
    initial = run["initial"].to_numpy().astype(np.int64)
    duplicate, truncated = first_faults(blank, cut, run["h1"].to_numpy(), run["h2"].to_numpy())
    turns = run["turn"].drop_null().to_numpy()
    gaps = int(turns[-1]) - int(turns[0]) + 1 - (1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else 0
    pair = initial[:-1] * 4 + initial[1:]
    edits = Edits(initial, blank | duplicate, np.where(truncated, TRUNCATED_COST, 0))
    counts = {"gaps": min(gaps, (1 << 63) - 1), "blank": int(blank.sum()), "duplicate": int(duplicate.sum()), "truncated": int(truncated.sum())}
    legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")]
    return counts | {"illegal": int((~np.isin(pair, legal)).sum()), "cost": edits.cost, "audit": edits.audit()}


def by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut into runs of one conv_id."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        codes = b["conv_id"].dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
        if held and held[-1]["conv_id"][-1].as_py() != b["conv_id"][0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(starts, starts[1:]):
            held.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost and audit."""
    source = facts(rows)
    conv = source.schema["conv_id"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = [], []

        def flush() -> pa.RecordBatch:
            cols = {"conv_id": pa.concat_arrays(ids)} | {c: pa.array([o[c] for o in out], pa.int64()) for c in NUMBERS} | {"audit": pa.array([o["audit"] for o in out], pa.string())}
            return pa.RecordBatch.from_pydict(cols)

        for run in by_conversation(batches):
            ids.append(run["conv_id"].chunk(0).slice(0, 1))
            out.append(_judged(run))
            if len(out) == 1000:
                yield flush()
                ids, out = [], []
        if out:
            yield flush()

    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", *sort_keys())
    return dealt.mapInArrow(judge, f"conv_id {conv}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: what ``audits`` finds, and the digest of the repaired conversation."""
    rows = keyed(rows)
    found = audits(rows)
    conv = found.schema["conv_id"].dataType.simpleString()
    # in each conversation the audit comes first, then its rows in order
    ahead = found.select("conv_id", F.lit(0).alias("kind"), *[F.col(c) for c in (*NUMBERS, "audit")])
    each = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text")
    both = ahead.unionByName(each, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *sort_keys())

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("kind", "audit", "role", "text")
        at: tuple[pa.RecordBatch, int] | None = None
        walk = None
        done: list[tuple[pa.RecordBatch, str]] = []

        def flush() -> pa.RecordBatch:
            names = ("conv_id", *NUMBERS, "audit")
            cols = {c: pa.concat_arrays([b.column(b.schema.get_field_index(c)) for b, _ in done]) for c in names}
            return pa.RecordBatch.from_pydict(cols | {"repaired_sha256": pa.array([h for _, h in done], pa.string())})

        def finish() -> None:
            walk.end()
            done.append((at[0].slice(at[1], 1), walk.sha.hexdigest()))

        for b in batches:
            for k, (kind, audit, role, text) in enumerate(zip(*(b[c].to_pylist() for c in columns))):
                if kind == 0:
                    if walk is not None:
                        finish()
                    at, walk = (b, k), Walk(audit)
                else:
                    walk.row(role, text)
            if len(done) >= 1000:
                yield flush()
                done = []
        if walk is not None:
            finish()
        if done:
            yield flush()

    schema = f"conv_id {conv}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string, repaired_sha256 string"
    return both.mapInArrow(digest, schema)


class Walk:
    """Replays an audit over rows that arrive one by one and keeps the digest of the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.sha = audit, 0, 0, False, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any = True
        self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def _written(self, text: str) -> None:
        self._line(ROLES[WRITTEN[self.state]], text)
        self.state = int(AFTER[self.state])

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._written("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._written(text)
        elif letter == "K":
            self._line(role, text)
            self.state = int(NEXT[self.state, INITIALS.index(role[:1])])

    def end(self) -> None:
        self._inserts()


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))


#: The twin tries every edit of every row and keeps the cheapest, least string for each state, row by row.
_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda v: list_reduce(list_concat([v], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step
), raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), hit as (
  select raw.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::int, 1))::bigint)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as p from raw, crc
), hurt as (
  select conv_id, turn, case when p = 4 then 'user' else role end as role,
    case when p = 1 then '' when p = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from hit, (values (1), (2)) c(copy) where p <> 0 and (copy = 1 or p = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') as cut from hurt
), faults as (
  select *, not blank and again > 1 as dup, cut and not blank and again = 1 as short, role || ':' || text as line from placed
), step_to(q, init, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
written(q, q2, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
added as (
  select q, q as q2, 0 as cost, '' as letters, []::varchar[] as lines from written
  union all select q, q2, 3, 'I', [role || ':'] from written
  union all select a.q, b.q2, 6, 'II', [a.role || ':', b.role || ':'] from written a join written b on a.q2 = b.q
), arcs as (
  select conv_id, i, w.q, w.q as q2, 4 as cost, 'D' as letter, []::varchar[] as lines from faults, written w
  union all select conv_id, i, t.q, t.q2, case when short then 3 else 0 end, 'K', [line] from faults join step_to t on t.init = left(faults.role, 1) where not blank and not dup
  union all select conv_id, i, w.q, w.q2, case when short then 6 else 3 end, 'R', [w.role || ':' || text] from faults, written w where not blank and not dup
), walk as (
  select conv_id, 0::bigint as i, 0 as q, 0 as cost, '' as audit, []::varchar[] as lines from (select distinct conv_id from conversations)
  union all
  select conv_id, i, q, cost, audit, lines from (
    select w.conv_id, a.i, a.q2 as q, w.cost + s.cost + a.cost as cost, w.audit || s.letters || a.letter as audit, list_concat(list_concat(w.lines, s.lines), a.lines) as lines,
      row_number() over (partition by w.conv_id, a.q2 order by w.cost + s.cost + a.cost, w.audit || s.letters || a.letter) as best
    from walk w join added s on s.q = w.q join arcs a on a.conv_id is not distinct from w.conv_id and a.i = w.i + 1 and a.q = s.q2
  ) where best = 1
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (short) as truncated,
    count(*) filter (i > 1 and coalesce(left(before, 1), '') || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(role) over (partition by conv_id order by i) as before from faults) group by conv_id
), ends as (
  select w.conv_id, w.cost + s.cost as cost, w.audit || s.letters as audit, list_concat(w.lines, s.lines) as lines,
    row_number() over (partition by w.conv_id order by w.cost + s.cost, w.audit || s.letters) as best
  from walk w join added s on s.q = w.q left join counts c on c.conv_id is not distinct from w.conv_id where w.i = coalesce(c.n, 0) and s.q2 in (0, 3)
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  e.cost::bigint as cost, e.audit, sha256(array_to_string(e.lines, chr(10))) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id where best = 1
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": _SQL}
