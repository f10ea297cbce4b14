"""Compression distance: held-out accuracy, defined cases, and the parts by themselves."""

import random
import zlib

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or".split()
BAD = ["grobbel", "snarfing", "klodtwit", "murkish"]


def word(r):
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 5)))


def text(r, bad, n=60):
    return " ".join(r.choice(BAD) if bad and r.random() < 0.06 else word(r) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(k, k % 5 == 1) for k in range(900)]
    docs = [(k, text(r, bad, 60) + (" " + r.choice(BAD) if bad else "")) for k, bad in rows]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, "of " * 30), (2003, "x" * 200_000), (2004, "of the " * 100_000), (5, docs[5][1]), (2005, docs[6][1])]
    labels = [(k, 1, int(bad)) for k, bad in rows if k % 3] + [(5, 1, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame([(*d, "en", "s", 0.5) for d in docs], "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(corpus):
    from slicewise.llm import toxicity

    got = toxicity.score(*corpus).collect()
    assert len(got) == 908 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900 or r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    bad = [r.predicted for r in held if r.doc_id % 5 == 1]
    good = [r.predicted for r in held if r.doc_id % 5 != 1]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for x in by.values()) and by[2000] == by[2001] == by[2002] and by[2005] == by[6]


def test_held_out_labels_teach_nothing(spark, corpus):
    from slicewise.llm import toxicity

    docs, labels = corpus
    other = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize(("toxic", "score"), [([], 0.0), ([0, 0, 0], 0.0), ([1, 1, 1], 1.0)])
def test_without_labels_of_both_kinds(spark, toxic, score):
    from slicewise.llm import toxicity

    docs = spark.createDataFrame([(k, "one two") for k in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, t in zip((1, 2, 3), toxic)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, labels).collect()} == {score}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_too_few_samples_for_a_dictionary():
    from slicewise.llm.toxicity import Distance, trained, windows

    assert trained([b" one "], 100) == b" one "
    cells = Distance(trained([b" bad words here "], 100), trained([b" good ones here "], 100)).cells([b"good", b"bad"])
    assert len(cells) == 2
    assert windows("Ab1é " .encode() + b"y" * 70) == {b"ab", "é".encode(), b"y" * 30, b"y" * 10}
