"""Every query with SQL gives the rows that its SQL gives."""

import pytest
from helpers import duck, normal

from quizmill.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    got, expected = normal(QUERIES[name](spark, sf).toPandas()), normal(con.execute(SQL[name]).df())
    assert list(got.columns) == list(expected.columns)
    floats = lambda f: f.map(lambda v: f"{float(v):.6g}" if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v)
    assert floats(got).equals(floats(expected))


@pytest.mark.parametrize("name", ["semantic_chunks", "select_strict", "uniform_sample"])
def test_partitions_do_not_matter(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(normal(QUERIES[name](spark, sf).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].equals(found[1])


def test_generated_tests_are_whole(spark, sf):
    rows = QUERIES["generated_tests"](spark, sf).collect()
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r["sort_order"])
    assert per and all(sorted(v) == [1, 2, 3, 4, 5] for v in per.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_top_n_does_not_sort_everything(spark, sf):
    plan = QUERIES["owner_page"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_totalprice" not in plan
