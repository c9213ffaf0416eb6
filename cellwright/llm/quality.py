"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gives a few counts, all by DataFrame functions. Ratios of them go
into logarithmic-bin sketches per language and source: a sketch is the table of
its bins' counts, so two sketches merge by adding, a bin's value is exact to
``ALPHA``, and partial aggregation keeps a hot source from meeting in one task.
Sketches of a language, and of all rows, are sums of the finer ones. Each group
adds ``PRIOR`` rows' worth of its language's sketch and as many of that of all
rows to its own, so a small group leans on them and a large one stands for
itself, without a size at which this changes. Rows that fail the base rule are
out already and tell nothing of the others; they are in no sketch.

The length of words is fenced on both sides, ``FENCE`` quartile distances beyond
the quartiles. Shares, which are zero for most texts, may reach ``MULTIPLE`` times
the quantile of the group that ``UPPER`` names, and ``GUARD`` more. Where even that
quantile is zero, what is above it is the exception: then the sketch's part above
zero sets the limit by its own foot, its ``FOOT`` quantile or a tenth of its median
if that is more, divided by ``MULTIPLE``. Without any value above zero all pass.

Defined cases: null text counts as empty (no words, base rule fails); null
language or source is a group of its own; repeated rows are counted and kept
each; a ratio without denominator is zero; an empty table gives no rows.
Equality of lines and of word windows within a text is that of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, read, staged, words

SPAN = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 20, 30
#: Relative accuracy of a bin; rows that a group takes from its language, and from all.
ALPHA, PRIOR = 0.01, 20
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Bin of the value zero.
ZERO = -100_000
#: Quartile distances beyond the quartiles.
FENCE = 4.0
#: Quantile of the part above zero that is its foot.
FOOT = 0.05
#: Quantile of each share, how many times it passes, and what passes beside it.
UPPER = {"symbol_share": 0.8, "dup_line_share": 0.99, "repeat_share": 0.99}
MULTIPLE, GUARD = 1.5, 0.01
#: Sums of parts may differ by their order; quantiles are taken with this margin of a row.
MARGIN = 1e-6
#: Ratios that are also fenced from below.
BOTH_SIDES = ("mean_word",)


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = df.withColumns(
        {
            "__hash": F.transform(words(F.col(text)), lambda w: F.xxhash64(w)),
            "__lines": F.transform(lines, lambda x: F.xxhash64(x)),
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
        }
    )
    h = F.col("__hash")
    starts = F.sequence(F.lit(0), F.size(h) - SPAN)
    at = at.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__spans": F.when(F.size(h) >= SPAN, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)]))),
        }
    ).drop("__hash", "__lines")
    spans = F.col("__spans")
    at = at.withColumn("__sorted", F.when(F.size(F.array_distinct(spans)) < F.size(spans), F.sort_array(F.transform(spans, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__spans")
    s = F.col("__sorted")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-SPAN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return at.withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("__sorted")


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}


def sketches(df: DataFrame, keys: list[str], ratios: dict | None = None) -> DataFrame:
    """Bins of each ratio's sketch: keys, metric, bin, n."""
    ratios = ratios or RATIOS
    values = F.array(*[F.struct(F.lit(m).alias("metric"), _share(*r).alias("x")) for m, r in ratios.items()])
    long = df.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*")
    bin_ = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO)).cast("int")
    return long.groupBy(*keys, "metric", bin_.alias("bin")).agg(F.count("*").alias("n"))


def merge(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the sums of the finer ones."""
    return bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def blended(fine: DataFrame) -> DataFrame:
    """Sketches of each (lang, source) with ``PRIOR`` rows of its language's and of all added: lang, source, metric, bin, n."""
    parts = []
    groups = fine.select("lang", "source").distinct()
    for keys in (["lang"], []):
        coarse = merge(fine, keys)
        size = coarse.groupBy(*keys, "metric").agg(F.sum("n").alias("rows")).withColumnsRenamed({k: f"of_{k}" for k in keys}).withColumnRenamed("metric", "of_metric")
        same = F.col("metric") == F.col("of_metric")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        scaled = coarse.join(size, same).select(*[F.col(k).alias(f"of_{k}") for k in keys], "metric", "bin", (PRIOR * F.col("n") / F.col("rows")).alias("n"))
        own = F.lit(True)
        for k in keys:
            own &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        parts.append((groups.join(scaled, own) if keys else groups.crossJoin(scaled)).select("lang", "source", "metric", "bin", "n"))
    both = fine.select("lang", "source", "metric", "bin", F.col("n").cast("double").alias("n"))
    for p in parts:
        both = both.unionAll(p)
    return both.groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n"))


def fences(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and metric: its rows, and the least and greatest value that pass."""
    own = Window.partitionBy(*keys, "metric")
    run = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("rows", F.sum("n").over(own))
    run = run.withColumn("zeros", F.sum(F.when(F.col("bin") == ZERO, F.col("n")).otherwise(0.0)).over(own))
    value = F.when(F.col("bin") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))

    def quantile(q: Column | float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("rows") - MARGIN, value))

    def above_zero(q: float) -> Column:
        there = (F.col("bin") != ZERO) & (F.col("upto") - F.col("zeros") >= q * (F.col("rows") - F.col("zeros")) - MARGIN)
        return F.min(F.when(there, value))

    upper = F.create_map(*[F.lit(x) for p in UPPER.items() for x in p])[F.col("metric")]
    got = run.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), quantile(upper).alias("top"), F.greatest(above_zero(FOOT), above_zero(0.5) / 10).alias("foot"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    share = F.when(F.col("top") > 0, MULTIPLE * F.col("top") + GUARD).otherwise(F.col("foot") / MULTIPLE)
    high = F.when(F.col("metric").isin(*UPPER), share).otherwise(F.col("q3") + reach)
    return got.select(*keys, "metric", "rows", (F.col("q1") - reach).alias("low"), high.alias("high"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def thresholds(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with a row that passes the base rule: low_* and high_* of each ratio."""
    rows = df.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *{c for r in RATIOS.values() for c in r})
    fine = staged(sketches(rows, ["lang", "source"]), "sketch")
    each = fences(blended(fine), ["lang", "source"])
    wide = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in RATIOS for side in ("low", "high")]
    return each.groupBy("lang", "source").agg(*wide)


def judged(df: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add base_failed and kept, joining each row to its group's thresholds."""
    small = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = lookup(df, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), small=small)
    ok = F.lit(True)
    for m, r in RATIOS.items():
        ok &= F.coalesce(_share(*r) <= F.col(f"high_{m}"), F.lit(True))
        if m in BOTH_SIDES:
            ok &= _share(*r) >= F.col(f"low_{m}")
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(True))).drop(*[c for c in small.columns])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: id, language, source, the counts, base_failed and kept."""
    got = counts(df.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text")
    got = staged(got, "quality")
    return judged(got, thresholds(got))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    got = quality_rules(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    share = {m: f"(case when {b} > 0 then {a} / {b} else 0.0 end)" for m, (a, b) in RATIOS.items()}
    lines = "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words)"
    bins = " union all ".join(f"select uid, lang, source, '{m}' metric, {s} x from c where not {failed}" for m, s in share.items())
    upper = "case metric " + " ".join(f"when '{m}' then {v}" for m, v in UPPER.items()) + " end"
    picked = ", ".join(f"max(case when metric = '{m}' then {s} end) {s}_{m}" for m in RATIOS for s in ("low", "high"))
    ok = " and ".join([f"coalesce({share[m]} <= high_{m}, true)" for m in RATIOS] + [f"{share[m]} >= low_{m}" for m in BOTH_SIDES])
    return f"""
    with d as (select row_number() over () uid, doc_id, lang, source, coalesce(text, '') t from documents),
    s as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, {lines} ls from d),
    win as (select uid, i, array_to_string(ws[i:i + {SPAN - 1}], ' ') g from (select uid, ws, unnest(range(1, len(ws) - {SPAN - 2})) i from s where len(ws) >= {SPAN})),
    twice as (select uid, i from (select uid, i, count(*) over (partition by uid, g) k from win) where k > 1),
    rep as (select uid, sum(least({SPAN}, i - last))::bigint n from (select uid, i, coalesce(lag(i) over (partition by uid order by i), i - {SPAN}) last from twice) group by uid),
    c as (select uid, doc_id, lang, source, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
        length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(n, 0)::bigint n_repeat_words from s left join rep using (uid)),
    sk as (select lang, source, metric, case when x > 0 then ceil(ln(x) / ln({GAMMA!r}))::int else {ZERO} end bin, count(*)::double n from ({bins}) group by all),
    g as (select distinct lang, source from sk),
    ofl as (select lang, metric, bin, {PRIOR} * sum(n) / sum(sum(n)) over (partition by lang, metric) n from sk group by lang, metric, bin),
    ofa as (select metric, bin, {PRIOR} * sum(n) / sum(sum(n)) over (partition by metric) n from sk group by metric, bin),
    bl as (select lang, source, metric, bin, sum(n) n from (select lang, source, metric, bin, n from sk
        union all select g.lang, source, metric, bin, n from g join ofl on g.lang is not distinct from ofl.lang union all select lang, source, metric, bin, n from g, ofa) group by all),
    ru as (select *, case when bin = {ZERO} then 0.0 else 2 * pow({GAMMA!r}, bin) / ({GAMMA!r} + 1) end v, {upper} up,
        sum(n) over (partition by lang, source, metric order by bin) upto, sum(n) over (partition by lang, source, metric) rows_, sum(case when bin = {ZERO} then n else 0 end) over (partition by lang, source, metric) z from bl),
    fe as (select lang, source, metric, min(case when upto >= 0.25 * rows_ - {MARGIN!r} then v end) q1, min(case when upto >= 0.75 * rows_ - {MARGIN!r} then v end) q3,
        min(case when upto >= up * rows_ - {MARGIN!r} then v end) top, min(case when bin <> {ZERO} and upto - z >= {FOOT} * (rows_ - z) - {MARGIN!r} then v end) foot,
        min(case when bin <> {ZERO} and upto - z >= 0.5 * (rows_ - z) - {MARGIN!r} then v end) half from ru group by all),
    li as (select lang, source, metric, q1 - {FENCE} * (q3 - q1) low, case when metric in ({", ".join(f"'{m}'" for m in UPPER)}) then case when top > 0 then {MULTIPLE} * top + {GUARD} else greatest(foot, half / 10) / {MULTIPLE} end else q3 + {FENCE} * (q3 - q1) end high from fe),
    lim as (select lang, source, {picked} from li group by lang, source),
    j as (select c.*, {failed} base_failed, {ok} ok from c left join lim on c.lang is not distinct from lim.lang and c.source is not distinct from lim.source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(ok, true) kept from j"""


QUERIES = {"op2_quality": op2_quality}
ORACLES = {"op2_quality": _oracle()}
