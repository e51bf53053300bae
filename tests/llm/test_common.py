import random

import pytest

from tidewatch.llm import common


def test_hot_keys_are_joined_like_others(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, rng.randint(3, 60)]), i) for i in range(900)], "k long, x int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(50)], "k long, y string")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for hot in (5, 100, 10_000):
        assert sorted(map(tuple, common.join_hot(left, right, "k", hot=hot).collect())) == want


@pytest.mark.parametrize("per_task", [7, 10_000])
def test_groups_of_a_stream_are_whole(spark, per_task):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), rng.choice("ab"), i) for i in range(3000)]
    got = common.by_group(spark.createDataFrame(rows, "k int, s string, v int"), ["k", "s"], ["v"], len(rows), lambda g: [(g["k"][0], g["s"][0], len(g["v"]), g["v"] == sorted(g["v"]))], "k int, s string, n int, sorted boolean", per_task).collect()
    want = {}
    for k, s, _ in rows:
        want[k, s] = want.get((k, s), 0) + 1
    assert {(r.k, r.s): r.n for r in got} == want and len(got) == len(want) and all(r.sorted for r in got)
    assert common.by_group(spark.createDataFrame([], "k int, v int"), ["k"], [], 0, lambda g: [(1,)], "n int").count() == 0


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.id: r.component for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), **dict.fromkeys(range(1000, 1041), 1000)}
