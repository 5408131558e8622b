"""The relational toolkit on small made-up inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillmark.functions import scalar
from rillmark.operators import predicates as p
from rillmark.operators import relational as rel


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, -5.0, "abcdX"), (1, -2.0, "abcdY"), (2, -9.0, "abcdX"), (1, -5.0, "abcdX")], "k int, v double, s string")


def test_predicates(rows):
    assert rel.select(rows, p.greater("v", -6.0), p.equal("s", "abcdX")).count() == 2
    assert rel.select(rows, p.less("k", 2), p.like("s", "%Y")).count() == 1
    assert rel.select(rows).count() == 4
    assert rel.select(rows, p.like("s", "_bcd_")).count() == 4 and rel.select(rows, p.like("s", "bcd%")).count() == 0


def test_distinct_compares_whole_values_and_projects_afterwards(rows):
    assert rel.select_distinct(rows).count() == 3
    projected = rel.select_project_distinct(rows, ["k"], p.equal("k", 1)).collect()
    assert [r["k"] for r in projected] == [1, 1]


def test_many_to_many_join_with_composite_keys(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "x int, y int, l string")
    right = spark.createDataFrame([(1, 1, "d"), (1, 1, "e"), (2, 2, "f")], "x2 int, y2 int, r string")
    met = rel.join(left, right, [("x", "x2"), ("y", "y2")], ["l", "r"]).collect()
    assert sorted(tuple(r) for r in met) == [("a", "d"), ("a", "e"), ("b", "d"), ("b", "e")]
    assert rel.join(left, right, [("x", "x2")], ["l", "r"], p.equal("r", "d"), p.equal("l", "c")).count() == 1


def test_aggregates_of_negative_values_and_of_nothing(rows):
    every = {"low": ("min", "v"), "high": ("max", "v"), "n": ("count", None), "total": ("sum", "v"), "mean": ("avg", "v")}
    assert tuple(rel.group_by_all(rows, every).first()) == (-9.0, -2.0, 4, -21.0, -5.25)
    assert tuple(rel.group_by_all(rows, every, p.greater("v", 0.0)).first()) == (None, None, 0, None, None)
    grouped = rel.group_by(rows, ["k"], every).collect()
    assert {r["k"]: r["high"] for r in grouped} == {1: -2.0, 2: -9.0}


def test_order_and_top(spark):
    made = spark.createDataFrame([(10,), (9,), (100,)], "n int")
    assert [r["n"] for r in rel.sort(made, "n").collect()] == [9, 10, 100]
    assert [r["n"] for r in rel.sort_strings(made, "n").collect()] == [10, 100, 9]
    assert [r["n"] for r in rel.top(made, ["n"], 2).collect()] == [10, 100]
    plan = rel.top(made, ["n"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_shards_are_never_negative(spark):
    made = spark.createDataFrame([(-5, 2), (5, 2)], "a int, b int")
    assert sorted(r[0] for r in made.select(rel.shard_of(["a", "b"], 4)).collect()) == [1, 3]


def test_map_reduce_and_keyed(spark):
    made = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    assert [r["v"] for r in scalar.map_values(made, "v", scalar.times_ten, scalar.times_ten).collect()] == [100, 200, 300]
    assert scalar.reduce_values(made, "v").first()[0] == 6
    assert {tuple(r) for r in scalar.keyed_count(made, "k").collect()} == {("x", 2), ("y", 1)}
    assert {tuple(r) for r in scalar.keyed_sum(made, "k", "v").collect()} == {("x", 3), ("y", 3)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-100, 100)), max_size=12))
def test_group_by_equals_python(spark, values):
    made = spark.createDataFrame(values, "k int, v int")
    found = {r["k"]: (r["n"], r["s"]) for r in rel.group_by(made, ["k"], {"n": ("count", None), "s": ("sum", "v")}).collect()}
    groups: dict = {}
    for k, v in values:
        groups.setdefault(k, []).append(v)
    assert found == {k: (len(v), sum(v)) for k, v in groups.items()}
