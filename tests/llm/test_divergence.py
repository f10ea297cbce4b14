"""The divergence audit against sums over all kept terms."""

import collections
import random
import re

import pytest

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs):
    rows = [(lang or "", source or "", TERM.findall((t or "").translate({65 + k: 97 + k for k in range(26)}))) for t, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = collections.Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        counts = {s: collections.Counter(t for r in own if r[1] == s for t in r[2] if df[t] >= 3) for s in {r[1] for r in own}}
        counts[None] = sum(counts.values(), collections.Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            if s is None:
                continue
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o not in (None, s)]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:200])]
    return sorted(out)


def table(seed, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "the on ré ß Zu".split() for b in "abcdefghijklmnopqrstuvwxyz"] + ["日本"]
    text = lambda: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=r.choice([0, 1, 9, 60])))
    docs = [(text(), r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", "s2", None, "s é"])) for _ in range(n)]
    docs += [(None, "en", "empty"), ("", "xx", "a"), ("one two", "xx", "b"), ("the1the " * 50_000, "en", "s1"), ("q" * 90_000, "en", "s1")]
    return docs + docs[:20]


@pytest.mark.parametrize(("block", "fan"), [(300_000, 4096), (60, 4096), (60, 2)])
def test_audit_is_what_all_terms_say(spark, block, fan):
    from slicewise.llm import divergence

    docs = table(5)
    d = spark.createDataFrame([(k, *x, "z", 1) for k, x in enumerate(docs)], "doc_id long, text string, lang string, source string, item string, value long").repartition(5)
    got = divergence.audit(d, block, fan).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(docs)


def test_empty_table(spark):
    from slicewise.llm import divergence

    out = divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_many_sources_of_one_term(spark, monkeypatch):
    """A term of more sources than are looked at together, and sums that are sent on before the end."""
    from slicewise.llm import divergence

    monkeypatch.setattr(divergence, "PAIRS", 100)
    monkeypatch.setattr(divergence, "SUMS", 50)
    docs = [(f"common common own{k}" + " w" * (k % 5), "en", f"s{k}") for k in range(40)] * 3
    d = spark.createDataFrame(docs, "text string, lang string, source string")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(d).collect())
    assert got == brute(docs)


def test_shares_stay_exact_beyond_64_bits(spark):
    from slicewise.llm.divergence import share

    rows = [(0, 1), (10**13, 3 * 10**13), (2 * 10**13 + 7, 10**13 + 3), (12_345_678_901, 98_765_432_109)]
    got = spark.createDataFrame(rows, "c long, d long").select("c", "d", share("c", "d").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.d for r in got)
