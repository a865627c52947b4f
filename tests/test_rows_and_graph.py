from __future__ import annotations

import pytest

from strataform.errors import ArgumentError
from strataform.operators import graph, guards, rows

from . import trees


@pytest.mark.parametrize(("wanted", "want"), [(["b", "a"], [1, 0]), ([3, 1], [2, 0]), ([], []), (None, [0, 1, 2]), ([2.0], [1])])
def test_resolve(wanted, want):
    assert rows.resolve(["a", "b", "c"], wanted) == want


@pytest.mark.parametrize("wanted", [["x", "y"], [0], [4], [1.5], ["a", "a"], [1, "b"], [None], [True]])
def test_resolve_refuses(wanted):
    with pytest.raises(ArgumentError):
        rows.resolve(["a", "b", "c"], wanted)


def test_unknown_names_are_listed_together():
    with pytest.raises(ArgumentError, match="'x', 'y'"):
        rows.resolve(["a"], ["x", "a", "y"])


def test_take_keeps_order_and_repeats(spark):
    df = spark.range(0, 100, 1, 5).withColumnRenamed("id", "row")
    asked = [5, 99, 5, 0]
    assert [r["row"] for r in rows.take(df, "row", asked).orderBy("place").collect()] == asked
    assert rows.take(df, "row", []).count() == 0
    with pytest.raises(ArgumentError):
        rows.take(df, "row", [100], total=100)
    with pytest.raises(ArgumentError):
        rows.take(df, "row", [-1])


def test_numbering_is_dense_with_ties(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id % 10 AS k", "id")
    got = rows.number(df, ["k", "id"], buckets=8).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).withColumnRenamed("id", "row").write.parquet(path)
    plan = rows.window(spark.read.parquet(path), "row", 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(row,5)" in plan


def test_find_and_order(spark):
    objects = trees.objects(spark, "")
    assert graph.find(objects, ["sales", "price"]) == 7
    assert graph.find(objects, [2, 1, "coef"]) == 11
    with pytest.raises(ArgumentError, match="step 2"):
        graph.find(objects, ["sales", "nothing"])
    order = [r["path"] for r in graph.tree(objects).orderBy("sort_key").collect()]
    assert order[:4] == ["", "$sales", "$sales$day", "$sales$store"]


def test_guards_pass_on_a_clean_directory(spark):
    assert guards.check(spark, guards.frames(spark, guards.directory())) == []


@pytest.mark.parametrize("name", sorted(guards.GUARDS))
def test_each_guard_alone_sees_its_damage(spark, name):
    assert name in guards.TAMPERED
    tables = guards.frames(spark, guards.directory(name))
    assert guards.violations(spark, name, tables).count() >= 1
