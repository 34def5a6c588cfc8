"""Predicate trees from bitmaps against the same trees over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tidepool.operators import filters, value_index


def table(spark, n):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, 5, 5, 5, rng.randrange(n)]), rng.choice([float("nan"), None, rng.random()]), f"s{rng.randrange(n):05d}", i % 3 == 0, 1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, kind string, size long, part double, name string, odd boolean, may int").repartition(3)


def shown(df):
    return list(map(repr, rows_of(df)))  # as a NaN equals no other


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = table(spark, 5000)
    rows = rows.unionByName(rows.where("id % 50 = 0"))
    return rows, value_index.build(rows, str(tmp_path_factory.mktemp("values")), ["kind", "size", "part", "name", "odd", "id"])


def random_tree(rng, depth=2):
    if depth and rng.random() < 0.7:
        return {rng.choice(["AND", "OR"]): [random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    ops = ["==", ">", ">=", "<", "<="]
    values = {"kind": ["a", "b", "zz"], "size": [5, 4, 0, 2500, 9999, -1], "part": [0.5, 0.0, 2.0, float("nan")], "name": ["s02500", "s00000", "t", ""], "odd": [True], "may": [1, 2], "id": [17, 2500, 4999, -3]}
    keys = rng.sample(sorted(values), rng.randint(0, 3) if rng.random() < 0.1 else rng.randint(1, 3))
    return {k: (rng.choice(ops), rng.choice(values[k])) for k in keys}


@pytest.mark.parametrize("seed", range(8))
def test_trees_equal_the_filter(built, seed):
    rows, index = built
    tree = random_tree(random.Random(seed))
    for mode in ("sql", "ignore"):
        assert shown(value_index.select(index, tree, mode)) == shown(filters.apply_filter(rows, tree, mode)), tree
    assert value_index.count(index, tree) == filters.apply_filter(rows, tree).count()


def test_ranges_are_used_and_bound(built):
    rows, index = built
    assert 1 < index.values["id"].select("lo", "hi").distinct().count() <= value_index.BINS * 3 * 4
    assert index.values["kind"].where("lo <> hi").isEmpty()
    bits = value_index.matching_bits(index, {"id": ("<=", 2500)})
    sure, may = bits.agg(F.sum(F.bitmap_count("__sure")), F.sum(F.bitmap_count("__may"))).first()
    exact = rows.where("id <= 2500").count()
    assert sure <= exact <= may and may - sure <= rows.count() / 20  # only one range is cut


def test_opened_again_and_errors(spark, tmp_path):
    rows = table(spark, 40)
    value_index.build(rows, str(tmp_path), ["kind"])
    again = value_index.open_index(spark, str(tmp_path))
    tree = {"kind": ("==", "a"), "size": (">", 4)}
    assert shown(value_index.select(again, tree)) == shown(filters.apply_filter(rows, tree))
    for bad, error in (({"OR": []}, ValueError), ({"kind": ("!=", "a")}, ValueError)):
        with pytest.raises(error):
            value_index.select(again, bad)
    with pytest.raises(ValueError):
        value_index.select(again, tree, "other")


def test_empty_table(spark, tmp_path):
    index = value_index.build(table(spark, 5).limit(0), str(tmp_path), ["kind", "size"])
    assert value_index.select(index, {"kind": ("==", "a")}).count() == 0
    assert value_index.count(index, {"OR": [{"size": ("<", 4)}]}) == 0


def test_stored_rows_are_not_shuffled(spark, built):
    _, index = built
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = value_index.select(index, {"kind": ("==", "a")})._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "Bucketed: true" in plan and plan.count("Exchange") <= 1  # at most the bits are
    assert "SelectedBucketsCount" in plan  # and only the buckets of runs with results are read
