"""Every registered query runs; those with SQL return its rows."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellwright.functions.scalars import html_to_text
from cellwright.plans import registry

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    compare(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_pages_cut_inside_an_entity(spark, tmp_path):
    """Entities without their end are text for the SQL, but for the ampersand's."""
    whole = ("&quot;", "&copy;", "&middot;", "&amp;", "&amp;quot;", "&ampquot;", "&amp&amp;", "&quotes;", "&copyright;")
    parts = sorted({w[:n] for w in whole for n in range(1, len(w) + 1)})
    texts = [None, "", " ".join(parts), *parts, *(f"?a=1{p}=2" for p in parts), *(f"{p}{q}" for p in parts for q in parts)]
    pages = [(k, None if t is None else f"<p>token = {t} <b>x</b></p>{t}") for k, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    assert compare(registry.QUERIES["page_plain_text"](spark, str(tmp_path)), registry.ORACLES["page_plain_text"], str(tmp_path)) == len(texts)
    other = spark.createDataFrame([("&lt;b&gt; &eacute; &#39; &#x41; &unknown; &lt &#65",)], "page string")
    assert other.select(html_to_text(F.col("page"), unclosed=False)).first()[0] == "<b> é ' A &unknown; &lt &#65"
