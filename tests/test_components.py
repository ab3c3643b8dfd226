import random

from notegrain.operators.components import components


def truth(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


def run(spark, edges):
    return {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}


def test_chain_hub_loops_nulls_and_repeats(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), ("y", None), ("p", "q"), ("q", "p"), ("p", "q")]
    assert run(spark, edges) == truth(edges)


def test_random_and_empty(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(200):03}", f"n{r.randrange(200):03}") for _ in range(120)]
    assert run(spark, edges) == truth(edges)
    assert run(spark, []) == {}
