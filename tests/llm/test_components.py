import random

from quern.llm.components import components


def test_long_paths(spark):
    """Paths of a few thousand nodes with random ids settle, and in one component each."""
    rng, edges, want = random.Random(0), [], {}
    for length in (3000, 500):
        ids = [rng.getrandbits(63) - (1 << 62) for _ in range(length)]
        edges += zip(ids, ids[1:], strict=False)
        want |= dict.fromkeys(ids, min(ids))
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
