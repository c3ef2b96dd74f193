"""Components of links, by rounds and by the driver."""

import random
import uuid

import pytest

from ancestra.llm.links import components


def _plain(edges):
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    return sorted(least.items())


@pytest.mark.parametrize("few", [0, 40, 50_000])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_by_rounds_and_by_the_driver_are_the_same(spark, kind, few):
    r = random.Random(7)
    edges = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(20)] + [(None, 1), (2, None), (300, 300)]
    r.shuffle(edges)
    if kind == "binary":
        edges = [tuple(None if x is None else (x + 60).to_bytes(4, "big") + bytes(2) for x in e) for e in edges]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    got = components(df, few=few)
    assert got.dtypes == [("node", df.dtypes[0][1]), ("least", df.dtypes[0][1])]
    assert sorted(map(tuple, got.collect())) == _plain(edges)
    assert components(df.limit(0), few=few).collect() == []


def test_few_links_need_few_tasks(spark):
    order = random.Random(5).sample(range(1000), 200)
    df = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "components")
    try:
        assert {r.least for r in components(df).collect()} == {min(order)}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    assert 0 < len(jobs) <= 12
