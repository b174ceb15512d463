"""Parallel greedy packing against a loop: ties in length, empty items, one group of all rows, budgets that divide evenly."""

import random

import pytest
from pyspark.sql import functions as F

from arborfold.operators import prefix, reduce


def greedy(lengths, budget):
    out, batch, size = [], 0, 0
    for k, n in enumerate(lengths):
        if k and size + n > budget:
            batch, size = batch + 1, 0
        size += n
        out.append(batch)
    return out


def check(spark, groups, budget):
    rows = [(g, i, 0, n) for g, lengths in groups.items() for i, n in enumerate(lengths)]
    random.Random(0).shuffle(rows)
    got = {}
    for r in reduce.pack(spark.createDataFrame(rows, "grp string, ord int, sub int, len int"), budget).collect():
        got.setdefault(r.grp, []).append((r.ord, r.batch))
    for g, lengths in groups.items():
        assert sorted(got.pop(g)) == [(i, b) for i, b in enumerate(greedy(lengths, budget))], (g, lengths, budget)
    assert not got


@pytest.mark.parametrize("budget", [1, 40])
def test_random_groups(spark, budget):
    rng = random.Random(budget)
    groups = {f"g{k}": [rng.randrange(budget + 1) for _ in range(rng.randrange(1, 60))] for k in range(15)}
    groups |= {"even": [max(1, budget // 4)] * 90, "empty": [0] * 7, "ends empty": [budget, 0, 0], "begins empty": [0, 0, budget, 1], "full": [budget] * 20, None: [1, budget, 1]}
    check(spark, groups, budget)


def test_one_group_of_all_rows(spark):
    """Thousands of items of equal length, which no two chains of batches ever share, in one group beside small ones."""
    rng = random.Random(1)
    check(spark, {"hot": [64] * 3000 + [rng.choice([0, 0, 1, 700, 1536]) for _ in range(500)], "small": [5, 5]}, 1536)


def test_no_python_worker_and_no_group_in_one_task(spark):
    items = spark.range(2000).select(F.lit("g").alias("grp"), F.col("id").alias("ord"), F.lit("x" * 50).alias("text"))
    packed = reduce.pack(reduce.expand(items, 200), 200)
    assert "Python" not in packed._jdf.queryExecution().toString()
    assert packed.groupBy("batch").count().filter("count = 4").count() == 500


def test_empty(spark):
    assert reduce.pack(spark.createDataFrame([], "grp string, ord int, sub int, len int"), 5).count() == 0


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(-5, 50)) for k in range(900)]
    got = prefix.running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], n=F.lit(1), total=F.col("v")).collect()
    assert len(got) == 900
    for r in got:
        before = [v for g, k, v in rows if g == r.g and k < r.k]
        assert (r.n, r.total) == (len(before), sum(before))
