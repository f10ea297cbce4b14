"""Ranked search against scores of every document."""

import collections
import math
import random
import re

import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({65 + k: 97 + k for k in range(26)}))


def brute(docs, items):
    """Every score, by the formula."""
    words = [terms(t) for _, t in docs]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    df = collections.Counter(t for w in words for t in set(w))
    asked = collections.defaultdict(list)
    for i, t in items:
        asked[i] += terms(t)
    out = []
    for i, q in asked.items():
        found = []
        for (d, _), w in zip(docs, words):
            tf = collections.Counter(w)
            m = 100 - 25 + 25 * len(w) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in q if tf[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:20])]
    return sorted(out, key=str)


def table(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "the on ré ß x1".split() for b in range(60)]
    docs = [(k, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=r.choice([0, 1, 5, 40, 300])))) for k in range(n)]
    docs += [(0, docs[3][1]), (None, docs[4][1]), (None, None), (n, ""), (n + 1, "The0 " * 30_000), (n + 2, "x" * 100_000), (n + 3, docs[9][1]), (n + 4, docs[9][1])]
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 3, 30])))) for k in range(90)] + [(1, "THE0 the0, the0; ré1"), (None, "on3 on3"), (200, None), (201, "?!"), (202, "nowhere")]
    return docs, items


@pytest.fixture(params=["whole", "small blocks", "blocks of items"])
def sizes(request, monkeypatch):
    from slicewise.llm import search

    if request.param == "small blocks":
        monkeypatch.setattr(search, "BLOCK_DOCS", 7)
        monkeypatch.setattr(search, "BUNDLE", 5)
    if request.param == "blocks of items":
        monkeypatch.setattr(search, "ITEMS", 40)


def test_search_is_what_every_score_says(spark, sizes):
    from slicewise.llm import search

    docs, items = table(3, 150)
    d = spark.createDataFrame([(*x, 7, "y") for x in docs], "doc_id long, text string, score long, block string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, search.search(d, i).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    from slicewise.llm import search

    docs, items = (spark.createDataFrame(x, f"{c} long, text string") for c, x in (("doc_id", [(1, "one")]), ("item_id", [(1, "one")])))
    assert search.search(docs.limit(0), items).collect() == [] and search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs, items.limit(0)).count() == 0


def test_pruning_leaves_accumulators_behind():
    """An item with a rare term in 20 documents begins none for a common one."""
    import numpy as np

    from slicewise.llm.search import OWNERS, Asked

    asked = Asked([[0, 1]], np.array([30, 90_000]), np.array([1, 3]), 100_000, 10_000_000)
    assert asked.owner[0] < asked.owner[1] == OWNERS - 1
    assert asked.rest[OWNERS - 1, 0] < asked.weight[0] * (10**9 // (1000 + 12 * 100))
