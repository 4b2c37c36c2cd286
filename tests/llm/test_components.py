import random

import pytest

from quotelake.llm.components import Forest, components


@pytest.mark.parametrize("bound", [0, 10**6])
def test_components_against_union_find(spark, bound):
    random.seed(5)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)]
    links += [(2000, 2001 + i) for i in range(60)] + links[:10] + [(7, 7), (None, 3), (4, None)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(spark, df, bound).collect()}
    forest = Forest()
    for a, b in links:
        if a is not None and b is not None and a != b:
            forest.link(a, b)
    assert got == {x: forest.root(x) for x in forest}


def test_no_links(spark):
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []
