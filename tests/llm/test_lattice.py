"""Words of every length count in the fit of the pieces."""

import random

import numpy as np


def test_long_words_are_expected_as_short_ones_are(monkeypatch):
    from slicewise.llm import lattice

    pieces = [lattice.MARK, lattice.MARK + "a", "a", "b", "ab", "aba", *(f"<0x{b:02X}>" for b in range(256))]
    model = lattice.Lattice(pieces, list(range(6, 262)), np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1))))
    r = random.Random(2)
    words = ["".join(r.choice(["a", "b", "ab", "é", "日本"]) for _ in range(n)).encode() for n in (70, 300, 400)]
    counts = np.array([1.0, 3.0, 2.0])
    alone = model.expected(words, counts)
    monkeypatch.setattr(lattice, "LONG", 10_000)
    assert alone.sum() > 1000 and np.allclose(alone, model.expected(words, counts))


def test_scores_against_all_segmentations(spark):
    """A text's score from its words' counts and a plain sum over segmentations, for pieces that are not fitted."""
    import math
    import random
    import zlib
    from collections import Counter

    import public_tokenizers

    from slicewise.llm import lattice

    r = random.Random(6)
    words = ["the", "thing", "én", "日本", "a" * 70, "x.y", "Under", "q"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(60)] + [(60, None), (61, " "), (None, "the q")]
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {x.doc_id: x for x in lattice.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, rounds=0).collect()}

    pieces, of_byte = lattice.read_pieces(path)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    split = {d: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for d, t in rows}
    count = Counter(w for d, ws in split.items() if not held[d] for w in ws)
    docs = sum(not h for h in held.values())
    n, v = sum(count.values()) + docs, len(count) + 1
    start = [1 / (k + 10) for k in range(len(pieces))]
    end = sum(start) * docs / (n - docs) / 2
    total = sum(start) + end
    p = {x: s / total for x, s in zip(pieces, start, strict=True)}
    whole = n / (n + v)

    def spelled(word):
        text = "▁" + word
        at = [1.0] + [0.0] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                if text[s:e] in p:
                    at[e] += at[s] * p[text[s:e]]
                elif e - s == 1:
                    at[e] += at[s] * math.prod(start[of_byte[b]] / total for b in text[s:e].encode())
        return at[-1]

    first = sum(x for k, x in p.items() if k.startswith("▁")) + end / total
    of = {w: math.log10(whole * count[w] / n + (1 - whole) * spelled(w)) for w in {w for ws in split.values() for w in ws}}
    last = math.log10(whole * docs / n + (1 - whole) * end / total / first)
    for d, ws in split.items():
        assert math.isclose(got[d].score, sum(of[w] for w in ws) + last, rel_tol=1e-6), d
        assert got[d].train_tokens == n and got[d].held_out == held[d]
