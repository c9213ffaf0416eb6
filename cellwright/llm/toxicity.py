"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Lexicon: a short list of seed terms, plus terms and stems learned from a bounded
sample of labelled rows. A learned entry is a word, or the shortest word
beginning that toxic rows share and clean rows lack (inflected languages repeat
stems, not words). All entries form one trie. Words of ``MIN_FUZZY`` letters and
more match within one edit, stems and short words exactly. The trie is
intersected with the edit automaton once, by subset construction, and the
resulting table runs over all words of an Arrow batch at once, so a text costs
a few array steps per letter.

Each hit is weighed by its context window: inside quotation marks it counts as
quoted, not as abuse; other hits in the window strengthen it. A ridge logistic
fit on the same bounded sample turns the sums into a score from 0 to 1.

Defined cases: null and empty texts get the score of a text without hits; rows
that repeat are scored each; a row without label is never learned from, nor is
one whose label is null; no labels at all leaves seeds with default weights.
Distances count UTF-8 bytes of lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

# Common insults that seed the lexicon.
SEEDS = ("clown", "disgusting", "dumb", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: Labelled rows of each class that are learned from, the first by hash of the id.
SAMPLE = 10_000
#: Rows of the toxic class that a learned entry needs, at least, and its least log odds.
MIN_ROWS, MIN_ODDS = 4, 3.0
#: Lengths of stems; letters from which one edit is allowed.
STEMS, MIN_FUZZY = range(4, 9), 5
#: Bytes that are read at once, whatever the batch or the length of a text.
SLICE = 1 << 21
#: Bytes on each side of a hit that its window holds.
WINDOW = 80
QUOTES = '"“”„«»'
#: Coefficients without labels: constant, plain, near, stem, quoted, strongest, crowded.
DEFAULT = np.array([-4.0, 1.0, 0.6, 0.8, 0.1, 0.8, 0.2])


def _letters() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    out[128:] = True
    return out


LETTER = _letters()


class Automaton:
    """Deterministic table of a lexicon's words within one edit and of its stems.

    ``hit[s]``: entry that state s accepts at the end of a word, -1 if none;
    ``far[s]``: its edits; ``stem[s]``: entry whose stem has just been read.
    State 0 is dead.
    """

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.weight = np.array([w for _, _, w in entries] or [0.0])
        trie: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        stems: list[int] = [-1]
        fuzzy = [False]
        for k, (term, is_stem, _) in enumerate(entries):
            at, raw = 0, term.encode()
            for c in raw:
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                    ends.append(-1)
                    stems.append(-1)
                    fuzzy.append(False)
                at = trie[at][c]
                fuzzy[at] |= not is_stem and len(raw) >= MIN_FUZZY
            (stems if is_stem else ends)[at] = k
        used = sorted({c for n in trie for c in n})
        self.classes = np.full(256, len(used) + 1, dtype=np.uint8)  # any other letter
        for i, c in enumerate(used):
            self.classes[c] = i + 1
        self.classes[~LETTER] = 0

        long_enough = [e >= 0 and len(entries[e][0].encode()) >= MIN_FUZZY for e in ends]

        def closed(states: set[tuple[int, int]]) -> frozenset:
            out = set(states)
            for n, e in states:
                if e == 0:  # a letter of the entry left out
                    out |= {(m, 1) for m in trie[n].values() if fuzzy[m]}
            return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

        def after(state: frozenset, c: int | None) -> frozenset:
            out = set()
            for n, e in state:
                if c in trie[n]:
                    m = trie[n][c]
                    if e == 0 or fuzzy[m]:
                        out.add((m, e))
                if e == 0:
                    if fuzzy[n] or n == 0:
                        out.add((n, 1))  # a letter more
                    out |= {(m, 1) for m in trie[n].values() if fuzzy[m]}  # another letter
            return closed(out)

        start = closed({(0, 0)})
        number, rows, todo = {frozenset(): 0, start: 1}, [[0] * (len(used) + 2), None], [start]
        while todo:
            state = todo.pop()
            row = [0] * (len(used) + 2)
            other = after(state, None)
            own = {c for n, _ in state for c in trie[n]}
            for i, c in [*enumerate(used, 1), (len(used) + 1, None)]:
                to = after(state, c) if c in own else other
                if to not in number:
                    number[to] = len(rows)
                    rows.append(None)
                    todo.append(to)
                row[i] = number[to]
            rows[number[state]] = row
        self.table = np.array(rows, dtype=np.int32)
        self.hit = np.full(len(rows), -1, dtype=np.int32)
        self.far = np.zeros(len(rows), dtype=np.int8)
        self.stem = np.full(len(rows), -1, dtype=np.int32)
        for state, s in number.items():
            best = min(((e, ends[n]) for n, e in state if ends[n] >= 0 and (e == 0 or long_enough[n])), default=None)
            if best:
                self.far[s], self.hit[s] = best
            self.stem[s] = max((stems[n] for n, e in state if e == 0), default=-1)

    def run(self, texts: list[bytes]) -> pd.DataFrame:
        """Hits: row of the text, start and end in the joined bytes, entry, kind (0 plain, 1 near, 2 stem)."""
        whole = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
        parts, at = [], 0
        while at < len(whole):
            end = min(at + SLICE, len(whole))
            while end < len(whole) and LETTER[whole[end - 1]]:  # never cut a word
                end += 1
            parts.append(self._slice(whole[at:end], at))
            at = end
        word, start, end, entry, kind = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int),) * 5
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return pd.DataFrame({"row": np.searchsorted(first, start, side="right") - 1, "start": start, "end": end, "entry": entry, "kind": kind})

    def _slice(self, buf: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
        """Hits of a stretch of whole words: word, start, end, entry, kind."""
        letter = LETTER[buf]
        for lead, second, size in ((0xE2, (0x80, 0x81), 3), (0xC2, range(0x80, 0xC0), 2)):  # typographic marks are no letters
            at = np.flatnonzero(buf[:-1] == lead)
            at = at[np.isin(buf[at + 1], list(second))]
            for k in range(size):
                letter[(at + k)[at + k < len(buf)]] = False
        edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=np.int8(0)))
        start, end = edge[0::2], edge[1::2]
        code = self.classes[buf]
        at, word, state = start.copy(), np.arange(len(start)), np.ones(len(start), dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            state = self.table[state, code[at]]
            at = at + 1
            live = state != 0
            at, word, state = at[live], word[live], state[live]
            stem = self.stem[state] >= 0
            last = at == end[word]
            whole = last & (self.hit[state] >= 0)
            found.append((word[whole], self.hit[state[whole]], self.far[state[whole]].astype(np.int64)))
            stem &= ~whole
            found.append((word[stem], self.stem[state[stem]], np.full(stem.sum(), 2)))
            on = ~last & ~stem
            at, word, state = at[on], word[on], state[on]
        word, entry, kind = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        order = np.argsort(word, kind="stable")
        word, entry, kind = word[order], entry[order], kind[order]
        return word, start[word] + offset, end[word] + offset, entry, kind


def _quoted(text: bytes, a: int, b: int) -> bool:
    """Whether a mark opens before a hit and closes after it, on its line, within the window."""
    before = text[max(0, a - WINDOW) : a].rpartition(b"\n")[2].decode("utf-8", "ignore")
    after = text[b : b + WINDOW].partition(b"\n")[0].decode("utf-8", "ignore")
    plain = before.count('"') % 2 == 1 and '"' in after
    typed = max(before.rfind(q) for q in "“„«") > max(before.rfind(q) for q in "”»") and any(q in after for q in "”»“")
    return plain or typed


def features(auto: Automaton, texts: list[bytes | None]) -> np.ndarray:
    """One row per text: constant, plain, near, stem, quoted, strongest, crowded."""
    texts = [t or b"" for t in texts]
    out = np.zeros((len(texts), 7))
    out[:, 0] = 1
    hits = auto.run(texts)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for row, group in hits.groupby("row", sort=False):
        text, base = texts[row], first[row]
        start, end = group["start"].to_numpy() - base, group["end"].to_numpy() - base
        w = auto.weight[group["entry"].to_numpy()]
        quoted = np.array([_quoted(text, a, b) for a, b in zip(start, end)])
        kind = group["kind"].to_numpy()
        near = np.searchsorted(start, end + WINDOW) - np.searchsorted(end, start - WINDOW) - 1
        for k in range(3):
            out[row, 1 + k] = np.log1p(w[(kind == k) & ~quoted].sum())
        out[row, 4] = np.log1p(w[quoted].sum())
        out[row, 5] = max(w[~quoted], default=0)
        out[row, 6] = np.log1p((near > 0)[~quoted].sum())
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression towards the default coefficients."""
    b = DEFAULT.copy()
    pull = np.full(len(b), ridge)
    pull[0] = 0.1 * ridge

    def loss(c):
        z = x @ c
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (pull * (c - DEFAULT) ** 2).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - pull * (b - DEFAULT)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(b)
        while size > 1e-6 and loss(b + size * step) > now:
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return b


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(body, toxic) of the labelled rows that may be learned from, at most ``rows`` of each class."""
    may = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    marked = labels.where(may & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for kind in (0, 1):
        part = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.union(part)
    found = docs.where(may).select("doc_id", F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(picked), "doc_id")
    # ids that repeat count once, with one of their texts and their greater label
    return found.groupBy("doc_id").agg(F.min("body").alias("body"), F.max("toxic").alias("toxic")).select("body", "toxic")


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Entries (term, is a stem, weight): seeds, then what toxic rows share and clean rows lack.

    Of each run of word beginnings the shortest that is telling enough stands
    for all longer ones; whole words are kept where no beginning is.
    """

    def count(batches):
        for pdf in batches:
            seen: dict[tuple[str, bool], list[int]] = {}
            for body, toxic in zip(pdf["body"], pdf["toxic"]):
                words = {w for w in re.findall(r"[^\W_]+", body.lower()) if len(w) >= 3}
                terms = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if n <= len(w)}
                for t in terms:
                    seen.setdefault(t, [0, 0])[1 - toxic] += 1
            yield pd.DataFrame([(*t, *n) for t, n in seen.items()], columns=["term", "stem", "bad", "good"])

    counts = sample.mapInPandas(count, "term string, stem boolean, bad long, good long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log(((F.col("bad") + 0.1) / (n_toxic + 0.2)) / ((F.col("good") + 0.1) / (n_clean + 0.2)))
    # by chance a word of few rows falls into toxic rows alone: its share must exceed a cautious bound
    telling = counts.withColumn("odds", odds).where((F.col("bad") >= MIN_ROWS) & (F.col("odds") >= MIN_ODDS) & (F.col("bad") >= 0.8 * (F.col("bad") + F.col("good"))))
    # bounded by the sample: an entry has MIN_ROWS of its rows
    rows = telling.orderBy(F.desc(F.col("bad") * F.col("odds")), "term", "stem").collect()
    stems_, out = {}, {s: (s, False, 4.0) for s in SEEDS}
    single: dict[str, int] = {}  # most rows of a word with this beginning
    for r in rows:
        if not r["stem"]:
            for k in STEMS:
                single[r["term"][:k]] = max(single.get(r["term"][:k], 0), r["bad"])
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: len(r["term"])):
        t = r["term"]
        inside = any(t[:k] in stems_ for k in STEMS if k < len(t))
        if not inside and r["bad"] > 1.2 * single.get(t, 0):
            stems_[t] = float(r["odds"])
    for r in rows:
        if not r["stem"] and not any(r["term"][:k] in stems_ for k in STEMS):
            out[r["term"]] = (r["term"], False, float(r["odds"]))
    return [*out.values(), *((t, True, w) for t, w in stems_.items())]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Automaton, np.ndarray]:
    """Lexicon automaton and coefficients from the bounded sample."""
    from .common import staged

    sample = staged(labelled_sample(docs, labels, rows), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    auto = Automaton(learn_lexicon(sample, bad, good) if bad else [(s, False, 4.0) for s in SEEDS])
    if not bad or not good:
        return auto, DEFAULT
    names = [f"f{i}" for i in range(7)]

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame(features(auto, pdf["body"].tolist()), columns=names).assign(toxic=pdf["toxic"])

    got = sample.select(F.col("body").cast("binary").alias("body"), "toxic").mapInPandas(measure, ", ".join(f"{c} double" for c in names) + ", toxic int").toPandas()
    return auto, fit(got[names].to_numpy(), got["toxic"].to_numpy(float))


def score(df: DataFrame, model: tuple[Automaton, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each text, 0 to 1."""
    auto, coef = model

    @F.pandas_udf("double")
    def scored(col: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(features(auto, col.tolist()) @ coef, -30, 30))))

    return df.withColumn(out, scored(F.col(text).cast("binary")))


def drop_toxic(df: DataFrame, model: tuple[Automaton, np.ndarray], text: str = "text") -> DataFrame:
    """Rows whose text scores under one half, columns unchanged."""
    return score(df, model, text, "__toxicity").where("__toxicity < 0.5").select(*df.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    got = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return got.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
