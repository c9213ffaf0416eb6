"""Mixing sources to target weights by capped water-filling.

Every source gets the share of the budget that its weight asks for. A source
whose share exceeds ``max_epochs`` times its size is clamped there, and what it
leaves is dealt out again by weight until no source is above its cap. Clamped
sources are those of least cap per weight, so sorting by that ratio and
summing up from both ends finds the water level in one pass over the sources.

A source's target is taken as whole repetitions of all its documents, and a
seeded sample for the fraction: documents in the order of a seeded hash until
the words are nearest to what is missing. The sample needs no sort of a source:
hash buckets are summed first, and only the one bucket in which the target
falls is put in order, so a source that holds a third of all rows costs no more.

Defined cases: null text has size zero and is taken with its source's whole
repetitions; a null source is a source of its own, last in order; rows that
repeat in their id are taken or left together, as are rows without id of equal
text; sources without weight get none; an empty table gives no rows; further
columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, lookup, read, staged

SEED = "mix-1"
BUDGET, MAX_EPOCHS = 1.5, 2
#: Weights that the sources take in turn, in the order of their names.
CYCLE = (5, 2, 1)
#: Hexadecimal digits of the hash that name a bucket.
BUCKET_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def cycled_weights(sizes: DataFrame, cycle: tuple = CYCLE) -> DataFrame:
    """Weights for ``sizes`` (source, source_size): the cycle over sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.array(*[F.lit(w).cast("long") for w in cycle])[(rank % len(cycle)).cast("int")])


def water_fill(sizes: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): weighted shares of the budget under the caps.

    One row per source; the window over them all is a pass over that small table.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy((cap / F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * budget
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(from_here)
    # the first source whose cap the level does not reach, and all after it, get the level times their weight
    at = sizes.where("weight > 0").withColumn("cap", cap).withColumn("level", level)
    free = at.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap")).withColumn("water", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return free.withColumn("target", target).drop("cap", "level", "free", "water")


def _hash(key: Column, text: Column, seed: str) -> Column:
    """Place of a row in its source's order; rows without id are told apart by their texts."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), named))


def limits(rows: DataFrame, budget: float, max_epochs: int, weights) -> DataFrame:
    """Per source of ``rows`` (source, size, h): s, source_size, target, whole repetitions and ``cut``.

    Rows whose hash is at most ``cut`` are taken once more. Hash buckets are
    summed first; only the bucket in which the target falls is put in order.
    """
    rows = rows.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    plan = water_fill(weights(buckets.groupBy("source").agg(F.sum("n").alias("source_size"))), budget, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = staged(plan.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "plan").withColumnRenamed("source", "s")
    n = plan.count()
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = plan.select("s", "want").where("want > 0")
    run = lookup(buckets.withColumn("upto", F.sum("n").over(upto)), F.col("source").eqNullSafe(F.col("s")), "inner", rows=n, small=wanted)
    edge = run.where((F.col("upto") - F.col("n") < F.col("want")) & (F.col("upto") > F.col("want")))
    edge = edge.select(F.col("s").alias("es"), F.col("bucket").alias("edge"), (F.col("upto") - F.col("n")).alias("below"), "want")
    full = run.where(F.col("upto") <= F.col("want")).groupBy("s").agg(F.max("bucket").alias("full")).withColumnRenamed("s", "fs")
    inside = lookup(rows, F.col("source").eqNullSafe(F.col("es")) & (F.col("bucket") == F.col("edge")), "inner", rows=n, small=edge)
    own = Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy("source", "h")
    mid = inside.withColumn("mid", 2 * (F.col("below") + F.sum("size").over(own)) - F.sum("size").over(peers))
    last = mid.where(F.col("mid") <= 2 * F.col("want")).groupBy("es").agg(F.max("h").alias("last"))
    out = plan.join(last, F.col("s").eqNullSafe(F.col("es")), "left").join(full, F.col("s").eqNullSafe(F.col("fs")), "left")
    # "g" comes after all hexadecimal digits, so a bucket's name with it stands behind the whole bucket
    cut = F.coalesce("last", F.concat("full", F.lit("g")), F.lit(""))
    out = staged(out.select("s", "source_size", "target", "whole", cut.alias("cut")), "limits")
    discard(buckets)
    return out


def _sized(df: DataFrame, id_col: str, text: str, source: str, seed: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), _hash(F.col(id_col), F.col(text), seed).alias("h"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights=cycled_weights) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (times the mix takes the row)."""
    rows = staged(_sized(df, id_col, text, source, seed), "sizes")
    met = lookup(rows, F.col("source").eqNullSafe(F.col("s")), small=limits(rows, budget, max_epochs, weights))
    return met.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), _copies().alias("copies"))


def _copies() -> Column:
    return F.coalesce(F.col("whole") + (F.col("h") <= F.col("cut")).cast("long"), F.lit(0).cast("long"))


def repeat_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights=cycled_weights) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, columns unchanged; no text is shuffled."""
    rows = staged(_sized(df, id_col, text, source, seed), "sizes")
    found = limits(rows, budget, max_epochs, weights)
    discard(rows)
    whole = F.struct(*[F.col(c) for c in df.columns]).alias("__all")
    met = lookup(df.select(whole, F.col(source).alias("source"), _hash(F.col(id_col), F.col(text), seed).alias("h")), F.col("source").eqNullSafe(F.col("s")), small=found)
    times = met.withColumn("copies", _copies()).where("copies > 0")
    return times.select("__all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__all.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    got = mix(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5('{SEED}:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))) h from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 k from d group by source),
w as (select source, source_size, case k % 3 when 0 then {CYCLE[0]} when 1 then {CYCLE[1]} else {CYCLE[2]} end weight, {MAX_EPOCHS} * source_size cap from s),
l as (select *, ({BUDGET} * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double lev from w),
t as (select *, least(cap::double, coalesce(first_value(case when lev * weight <= cap then lev end ignore nulls) over (order by cap / weight, source nulls last rows between unbounded preceding and unbounded following) * weight, cap::double)) target from l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end whole from t),
c as (select d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size want,
    2 * sum(d.size) over (partition by d.source order by h range between unbounded preceding and current row) - sum(d.size) over (partition by d.source, h) mid
    from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (size * (whole + case when mid <= 2 * want and want > 0 then 1 else 0 end))::bigint taken from c"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": ORACLE}
