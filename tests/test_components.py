import random

from parlance.operators.components import components
from parlance.operators.leads import same_chats


def brute(edges):
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {x: find(x) for x in of}


def test_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (900, 900)]
    found, _ = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.least for r in found.collect()} == brute(edges)
    found, rounds = components(spark.createDataFrame([], "a long, b long"))
    assert found.collect() == [] and rounds == 0


def test_long_chains_take_few_rounds(spark):
    """A chain of 10,000 with shuffled, very large ids, and a star."""
    ids = [(1 << 62) + k for k in range(10_000)]
    random.Random(1).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5, k) for k in range(6, 300)], "a long, b long")
    found, rounds = components(chain)
    rows = found.groupBy("least").count().collect()
    assert {r.least: r["count"] for r in rows} == {1 << 62: 10_000, 5: 295}
    assert rounds < 20


def test_identities_of_very_large_ids(spark):
    """Names that lead from one to the next, with ids whose sum is no long."""
    big = 1 << 62
    rows = [(big + k, None, f"name_{k // 2}", f"invite_{(k + 1) // 2}") for k in range(400)] + [(3, 77, "NAME_9", None), (4, 78, "other", None), (big - 1, None, None, None)]
    found = {r.id: r.group for r in same_chats(spark.createDataFrame(rows, "id long, peer_id long, username string, invite string")).collect()}
    assert found == {big + k: 3 for k in range(400)} | {3: 3, 4: 4, big - 1: big - 1}
