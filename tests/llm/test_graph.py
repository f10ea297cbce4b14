"""Connected components against union by hand."""

import random


def by_hand(links):
    up = {x: x for link in links for x in link}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def found(spark, links):
    from slicewise.llm.graph import components

    rows = components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.label for r in rows}


def test_a_long_chain_is_one_component(spark):
    ids = random.Random(3).sample(range(10**6), 1000)
    links = list(zip(ids, ids[1:], strict=False))
    assert found(spark, links) == dict.fromkeys(ids, min(ids))


def test_components_of_mixed_links(spark):
    """Paths in order and in reverse, a star, loops, links that repeat, random links."""
    r = random.Random(4)
    links = [(k, k + 1) for k in range(100)] + [(301 - k, 300 - k) for k in range(100)] + [(999, k) for k in range(900, 950)] + [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    links += [(r.randrange(10_000, 10_300), r.randrange(10_000, 10_300)) for _ in range(140)]
    assert found(spark, links) == by_hand(links)
    assert found(spark, [(7, 7)]) == {7: 7}
    assert found(spark, []) == {}
