"""Every registered query against its DuckDB oracle on the small tables."""

import glob
import os

import duckdb
import pytest

from graphlens import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def _norm(rows, cols, names):
    at = [cols.index(n) for n in names]
    cells = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows]
    return sorted(cells, key=lambda x: tuple((v is None, str(v)) for v in x))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in got.description]
    names = sorted(df.columns)
    assert names == sorted(cols)
    assert _norm([tuple(r) for r in df.collect()], df.columns, names) == _norm(got.fetchall(), cols, names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_no_nested_loop_in_identifier_match(spark, sf_dir):
    df = catalog.QUERIES["multi_key_match"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_page_titles_as_in_sql(spark, tmp_path):
    titles = ["a &&&amp", "a &amp; b&lt;i&gt;", "&amp;lt; &amp;amp;", "<i>x</i> ( y ) , z ;", "&nbsp;&copy &#39; é", "\u00a0a & b\u3000", "&\x0b a \x0b", "a\n\t\r\f b\n", "  plain  , kept  ", "", "&", "\u2028&\u2028", "&quot;q&QUOT;"]
    html = [f"<html><title>{t}</title></title>" for t in titles] + [None, "", "no title", "<title>open", "<TITLE>x &</TITLE>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["page_titles_cleaned"](spark, str(tmp_path)).select("page_id", "title").collect()}
    assert got == set(c.execute(catalog.ORACLES["page_titles_cleaned"]).fetchall())
