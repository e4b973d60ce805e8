"""Every registered query beside its SQL, on the smallest tables."""

import pytest
from harness import compare, oracle_connection

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, con, name):
    wrong, _ = compare(name, QUERIES[name](spark, folder), con, ORACLE[name])
    assert wrong is None, wrong


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0


def test_every_sql_names_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_near_recipes_of_every_size(spark, folder):
    parts = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size").collect()}
    found = {r.recipe for r in QUERIES["b13_near_recipes_all_sizes"](spark, folder).select("recipe").distinct().collect()}
    assert {parts[r] > 25 for r in found} == {False, True}  # two items, three items


def test_estimated_total_is_of_several_items(spark, folder, monkeypatch):
    from wickerwork.operators import guide

    seen, real = [], guide.estimated_total
    monkeypatch.setattr(guide, "estimated_total", lambda *a, **k: seen.append(a) or real(*a, **k))
    assert QUERIES["t12_estimated_total"](spark, folder).count() > 0
    ours, items = seen[0][0], seen[0][4]
    assert items.select("item").distinct().count() > 1
    assert ours.select("variant").distinct().count() == items.count()
