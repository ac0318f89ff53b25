"""Components over shapes that are hard for stars."""

import random

from stowage.llm import simhash


def roots(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r["node"]: r["root"] for r in simhash.components(df).collect()}


def test_a_long_chain_in_any_order(spark):
    names = list(range(150))
    random.Random(3).shuffle(names)
    edges = list(zip(names, names[1:], strict=False))
    random.Random(4).shuffle(edges)
    assert roots(spark, edges) == {n: 0 for n in range(1, 150)}


def test_a_star_and_strangers(spark):
    edges = [(500, n) for n in range(100, 300)] + [(7, 8), (8, 9), (9, 7)]
    assert roots(spark, edges) == {**{n: 100 for n in [500, *range(101, 300)]}, 8: 7, 9: 7}


def test_no_links(spark):
    assert roots(spark, []) == {}
    assert roots(spark, [(4, 4)]) == {}
