"""Personal data by bootstrapped contextual extraction, all in DataFrame functions.

Seeds are what fixed patterns find (mail and network addresses, payment cards,
phone numbers). Tokens with a digit or an at sign are candidates. A seed's left
word with its shape, its shape with its right word, and both words around it
are its lexical patterns. Pattern and instance form a bipartite graph whose
edges carry counts; scores pass back and forth over it: a pattern's score of a
kind is the mean confidence of its instances, an instance's confidence is the
chance that one of its patterns holds. Confident patterns take in unseen
instances, which count in the next round. Instances above ``ACCEPT`` become
spans wherever they occur outside seed spans; seed spans always stay.

Only texts with a candidate leave their row: matches are exploded with the
length of the text before them, and a running sum per text gives positions.

Defined cases: null text counts as empty; rows that repeat, also in their id,
are kept apart by a row number drawn before the first write; an empty table
gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, read, staged

# Kinds in their order, and what a match of each kind is. A start
# inside a run that has failed cannot succeed, so runs are tried from their
# beginning, or from where the last match ended, and never given back.
LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Condition that a text must meet to hold a match that counts.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: A candidate: a token with a digit or an at sign; edges that do not belong to it.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
EDGE = r"[\"'()\[\]{}<>,.;:!?*#$%&|]*"

#: Prior count of a pattern, support it needs, confidence that makes a span, share of all confidence that ends the rounds.
PRIOR, SUPPORT, ACCEPT, SETTLED = 2.0, 3, 0.9, 1e-4
#: Code points of context that are looked at on each side.
CONTEXT = 60


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (F.ascii(F.substring(digits, n - i + 1, 1)) - 48) * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d % 10 + F.when(d > 9, 1).otherwise(0)) % 10 == 0


def _holds(kind: Column, m: Column) -> Column:
    """Whether a match meets its kind's further condition."""
    d = _digits(m)
    card = F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", m.rlike(OCTETS)).when(kind == "card", card).when(kind == "phone", F.length(d).between(8, 15)).otherwise(False)


def _found(df: DataFrame) -> DataFrame:
    """uid, doc_id and ``found``: every raw match with what precedes and follows it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", t.alias("t"))
    body = F.col("t")
    guards = GUARDS | {"token": lambda t: t.rlike("[0-9@]")}
    patterns = KINDS | {"token": CANDIDATE}
    df = df.withColumns({f"m_{k}": F.when(guards[k](body), F.regexp_extract_all(body, F.lit(p), F.lit(0))) for k, p in patterns.items()})
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(body, p, -1)) for k, p in patterns.items()})

    def items(k: str) -> Column:
        parts = F.col(f"p_{k}")

        def one(x, i):
            side = (F.right(F.get(parts, i), F.lit(CONTEXT)), F.left(F.get(parts, i + 1), F.lit(CONTEXT))) if k == "token" else (F.lit(None), F.lit(None))
            return F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), x.alias("m"), side[0].cast("string").alias("before"), side[1].cast("string").alias("after"))

        return F.when(F.size(f"m_{k}") > 0, F.transform(F.col(f"m_{k}"), one)).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,m:string,before:string,after:string>>"))

    return df.select("uid", "doc_id", F.concat(*[items(k) for k in patterns]).alias("found"))


def _placed(found: DataFrame) -> DataFrame:
    """One row per match: uid, kind, start, end, m, before, after."""
    rows = found.where(F.size("found") > 0).select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    run = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(run)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))


def _shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{L}+", "a")


def _seeded(seeds: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens (m, left, right) with the kind of a seed that they touch, by two passes over each text in order."""
    side = F.struct("start", "end", "kind")
    both = seeds.select("uid", "start", "end", "kind", F.lit(1).alias("seed"), *[F.lit(None).cast("string").alias(c) for c in ("m", "left", "right")])
    both = both.unionByName(tokens.select("uid", "start", "end", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("seed"), "m", "left", "right"))
    text = Window.partitionBy("uid")
    sofar = text.orderBy("start", F.desc("seed")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = text.orderBy(F.desc("start"), F.desc("seed")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("seed") == 1, F.struct("end", "kind"))).over(sofar)
    coming = F.last(F.when(F.col("seed") == 1, side), ignorenulls=True).over(ahead)
    met = both.withColumn("reach", reach).withColumn("coming", coming).where("seed = 0")
    kind = F.when(F.col("reach.end") > F.col("start"), F.col("reach.kind")).when(F.col("coming.start") < F.col("end"), F.col("coming.kind"))
    return met.select("m", "left", "right", kind.alias("kind"))


def discover(seeds: DataFrame, tokens: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind) of confident instances that no seed covers.

    ``seeds``: uid, kind, start, end; ``tokens``: uid, start, end, m, left, right.
    Confidence only grows from round to round, so the rounds settle.
    """
    known = _seeded(seeds, tokens)
    shape = _shape(F.col("m"))
    patterns = F.array(F.concat_ws("\t", F.lit("l"), "left", shape), F.concat_ws("\t", F.lit("r"), shape, "right"), F.concat_ws("\t", F.lit("b"), "left", "right"))
    edges = known.select("m", "kind", F.explode(patterns).alias("p")).groupBy("m", "kind", "p").agg(F.count("*").alias("n"))
    edges = staged(edges, "pii-edges")
    seen = edges.where("kind is not null").select("m", "kind", F.lit(1.0).alias("c")).distinct()
    fresh = edges.where("kind is null").select("m", "p", "n")
    weight = edges.groupBy("p").agg(F.sum("n").alias("all"), F.count_distinct("m").alias("instances")).where(F.col("instances") >= SUPPORT)
    weight = staged(weight, "pii-patterns")
    base = edges.where("kind is not null").groupBy("p", "kind").agg(F.sum("n").alias("w"))
    found, before = None, -1.0
    while True:
        support = base
        if found is not None:
            grown = fresh.join(found, "m").groupBy("p", "kind").agg(F.sum(F.col("n") * F.col("c")).alias("w"))
            support = base.union(grown).groupBy("p", "kind").agg(F.sum("w").alias("w"))
        score = support.join(weight, "p").select("p", "kind", (F.col("w") / (F.col("all") + PRIOR)).alias("score")).where("score > 0.2")
        miss = fresh.join(score, "p").groupBy("m", "kind").agg(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))).alias("miss"))
        last, found = found, staged(miss.select("m", "kind", (1 - F.exp("miss")).alias("c")), "pii-instances")
        if last is not None:
            discard(last)
        total = found.agg(F.sum("c")).first()[0] or 0.0
        if total - before <= SETTLED * total:
            break
        before = total
    best = found.where(F.col("c") >= accept).groupBy("m").agg(F.max_by("kind", F.struct("c", "kind")).alias("kind"))
    return best.join(seen.select("m"), "m", "left_anti")


def pii_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: uid, doc_id and ``spans``, an array of (kind, start, end, seed, value) by kind and start."""
    found = staged(_found(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "pii-matches")
    placed = staged(_placed(found), "pii-placed")
    seeds = placed.where(F.col("kind") != "token").where(_holds(F.col("kind"), F.col("m"))).select("uid", "kind", "start", "end", "m")
    lead = F.length(F.regexp_extract("m", f"^({EDGE})", 1))
    core = placed.where("kind = 'token'").withColumn("skip", lead).withColumn("core", F.regexp_replace(F.expr("substring(m, skip + 1)"), f"{EDGE}$", "")).where("core <> ''")
    left = F.lower(F.substring_index(F.regexp_replace(F.rtrim("before"), r"[\x20\x09-\x0D]+", " "), " ", -1))
    right = F.lower(F.substring_index(F.regexp_replace(F.ltrim("after"), r"[\x20\x09-\x0D]+", " "), " ", 1))
    tokens = core.select("uid", (F.col("start") + F.col("skip")).alias("start"), (F.col("start") + F.col("skip") + F.length("core")).alias("end"), F.col("core").alias("m"), F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))
    unseen = tokens.join(discover(seeds, tokens), "m").select("uid", "kind", "start", "end", "m")
    both = seeds.withColumn("seed", F.lit(True)).union(unseen.withColumn("seed", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = both.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "seed", F.col("m").alias("value")))).alias("spans"))
    none = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string,seed:boolean,value:string>>")
    rows = found.select("uid", "doc_id").join(spans.select("uid", F.col("spans").cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string,seed:boolean,value:string>>").alias("spans")), "uid", "left")
    return rows.select("uid", "doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _same(kind: str):
    return lambda x: F.when(x == kind, x)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    got = pii_spans(read(spark, sf_dir, "documents"))
    seeds = F.filter("spans", lambda s: s["seed"])
    kinds = F.transform(seeds, lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _same(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(_joined(seeds), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
