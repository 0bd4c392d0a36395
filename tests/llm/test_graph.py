import random

import pytest

from gridloom.llm.common import Scratch
from gridloom.llm.graph import components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    n = 300
    names = rng.sample(range(10_000), n)
    edges = {
        "path": [(names[i], names[i + 1]) for i in range(n - 1)],
        "star": [(names[0], x) for x in names[1:]] + [(names[1], names[2])],
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(200)] + [(5, 5)],
        "none": [],
    }[shape]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    out = components(df, Scratch(spark, "test"))
    assert sorted(map(tuple, out.collect())) == sorted((x, find(x)) for x in parent)
