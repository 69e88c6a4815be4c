import random

from nivalis.llm.components import components


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(60)]  # a chain of 61
    edges += [(nodes[100], nodes[i]) for i in range(101, 160)] + [(nodes[200], nodes[201]), (nodes[201], nodes[200]), (nodes[250], nodes[250])]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for own in (nodes[:61], nodes[100:160], nodes[200:202]):
        assert {found[n] for n in own} == {min(own)}
    assert len(found) == 61 + 60 + 2
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
