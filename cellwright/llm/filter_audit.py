"""Filter interaction audit: what every filter removes in every order, from one pass over the texts.

Each document gets a mask, one bit for each filter it fails. Counts of masks by
part (32 numbers) are all that is left of the corpus; the subset-zeta transform
turns them into survivors of every subset of filters, S(F) = documents whose
mask has no bit in F, in five butterfly steps. A step of an order goes from a
subset to a neighbour that holds one filter more, so what it removes is the
difference of two survivor counts; the same for documents labelled good or
toxic. All orders of five filters read the same 32 numbers.

Filters (words are maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive), a document fails

* A under 200 words,
* B when 100 * distinct words < 50 * words,
* C when 100 * ``[A-Z]`` characters > 3 * code points,
* D when it holds any of ``#$%&*|``,
* E when a smaller doc_id anywhere in the table has the identical text.

Scale: texts never leave their task, only a 256-bit digest of each does. Equal
rows are added up before every shuffle, so a text of a third of all documents
arrives as one row from each task, and the copies of a text meet as one row for
each part and label.

Defined cases: null and empty texts have no words (they fail A and, among
themselves, E); a null part is the empty string; a document without doc_id has
no smaller one and is nobody's smaller one; rows with equal doc_id and text are
not copies of each other, but count each; an id with several labels has a label
if any of its rows has; an empty table has no parts and returns no rows; only
the columns named here are read, so others may have any name.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, words

FILTERS = "ABCDE"
#: Counts that the transform runs over: all documents, those labelled good, those labelled toxic.
KINDS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that look at one text alone."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    n, distinct = (F.size(w).cast("long") for w in (found, F.array_distinct(found)))
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, F.lit(100) * distinct < F.lit(50) * n, F.lit(100) * upper > F.lit(3) * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def labels_by_id(labels: DataFrame) -> DataFrame:
    """One row per labelled id: whether any of its rows is good, is toxic."""
    marked = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "is_good"), ("toxic", "is_toxic"))]
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(*marked)


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of the mask."""
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), text_mask(F.col("text")).alias("own"),
    )
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))
    # rows without an id find no label: they are dealt by their text instead
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))
    rows = rows.withColumn("key", key).join(labels_by_id(labels), "key", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    rows = rows.select("doc_id", "part", "digest", "own", "n", *flags)
    copies = rows.groupBy("digest", "own", "part", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"),
        F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    # a text has few of these rows, one for each part and label, however many copies it has
    first = copies.groupBy("digest").agg(F.min("least").alias("smallest"), F.collect_list(F.struct("own", "part", "is_good", "is_toxic", "n", "unnumbered", "first")).alias("of"))
    each = first.select("smallest", F.inline("of"))
    kept = F.col("unnumbered") + F.when(F.col("first.doc_id") == F.col("smallest"), _rows_of(F.col("first"))).otherwise(0)
    split = F.array(F.struct(F.col("own").alias("mask"), kept.alias("m")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - kept).alias("m")))
    each = each.select("part", "is_good", "is_toxic", F.inline(split))
    good, toxic = (F.sum(F.when(F.col(c), F.col("m")).otherwise(0)).alias(k) for c, k in (("is_good", "good"), ("is_toxic", "toxic")))
    return each.groupBy("part", "mask").agg(F.sum("m").alias("n"), good, toxic)


def _rows_of(first: Column) -> Column:
    """Rows of the smallest id of a group."""
    return F.coalesce(first["n"], F.lit(0).cast("long"))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): arrays by subset of filters, S[F] = documents that fail none of F.

    ``counts`` has one row for each part and mask. The zeta transform sums over
    the subsets of each set; the survivors of F are the sum of its complement.
    """
    full = (1 << len(filters)) - 1
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS))))
    parts = counts.groupBy("part").agg(by_mask.alias("by_mask"))

    def zeta(kind: str) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at("by_mask", m)[kind], F.lit(0).cast("long")))
        for bit in (1 << i for i in range(len(filters))):
            sums = _plus_without(sums, bit)
        return F.reverse(sums).alias(kind)

    return parts.select("part", *(zeta(k) for k in KINDS))


def _plus_without(sums: Column, bit: int) -> Column:
    """One butterfly step: to the sum of each set that holds the bit comes that of the set without it."""
    bound = F.transform(F.array(sums), lambda a: F.transform(a, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(a, m - bit)).otherwise(0)))
    return bound[0]


def order_steps(survived: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of neighbouring subsets."""
    k, full = len(filters), (1 << len(filters)) - 1
    steps, values = [], []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[i] for i in order), "step": step, "f": f, "s": before, "t": before | 1 << f})
            before |= 1 << f
    for f in range(k):
        sets = [s for s in range(full + 1) if not s >> f & 1]
        values.append([{"s": s, "t": s | 1 << f, "w": factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())} for s in sets])

    def lost(kind: str, s: Column, t: Column) -> Column:
        """What the step from the set s to its neighbour t loses."""
        return F.get(kind, s) - F.get(kind, t)

    def table(rows: list, schema: str) -> Column:
        return F.from_json(F.lit(json.dumps(rows)), schema)

    zero = F.lit(0).cast("long")
    moves = table(values, "array<array<struct<s: int, t: int, w: long>>>")
    shapley = F.transform(moves, lambda of: F.aggregate(of, zero, lambda sum_, x: sum_ + x["w"] * lost("n", x["s"], x["t"])))
    rows = survived.select("part", *KINDS, shapley.alias("values"))
    rows = rows.select("*", F.inline(table(steps, "array<struct<filter_order: string, step: int, f: int, s: int, t: int>>")))
    s, t, bit = F.col("s"), F.col("t"), F.col("t") - F.col("s")
    removed = lost("n", s, t)
    return rows.select(
        "part", "filter_order", "step", F.get("n", t).alias("kept"), removed.alias("removed"), (lost("n", F.lit(0), bit) - removed).alias("redundant"),
        lost("n", F.lit(full) - bit, F.lit(full)).alias("unique_fails"), lost("good", s, t).alias("good_lost"), lost("toxic", s, t).alias("toxic_lost"), F.get("values", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return order_steps(survivors(masked_counts(docs, labels)))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: The twin counts every order and step directly, without survivors of subsets.
_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), least_id as (select body, min(doc_id) as m from d group by body),
lab as (select doc_id, max((quality = 1)::int) as q, max((toxic = 1)::int) as t from labels group by doc_id),
f as (
  select part, coalesce(q, 0) as q, coalesce(t, 0) as t,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
     regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > m, false)] as fails
  from d join least_id using (body) left join lab using (doc_id)
), g as (select part, fails, count(*) as n, sum(q) as q, sum(t) as t from f group by part, fails),
o as (
  select [a.i, b.i, c.i, e.i, h.i] as p from range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) e(i), range(1, 6) h(i)
  where len(list_distinct([a.i, b.i, c.i, e.i, h.i])) = 5
), s as (select p, k::int as step from o, range(1, 6) r(k)),
x as (
  select part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i::int, 1)), '') as filter_order, step, p[step] as letter, n, q, t, fails[p[step]] as this,
    len(list_filter(p[1:step - 1], lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda y: y)) as n_fails
  from g, s
), y as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (not gone and not this), 0)::bigint as kept, coalesce(sum(n) filter (not gone and this), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and this), 0)::bigint as redundant, coalesce(sum(n) filter (this and n_fails = 1), 0)::bigint as unique_fails,
    coalesce(sum(q) filter (not gone and this), 0)::bigint as good_lost, coalesce(sum(t) filter (not gone and this), 0)::bigint as toxic_lost
  from x group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, letter)::bigint as shapley from y
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": _SQL}
