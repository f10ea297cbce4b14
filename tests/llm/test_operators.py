"""The ten operators and the pipeline against brute force, on a small table that holds the odd cases and on an empty one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

random.seed(5)
WORDS = [a + b for a in ("the", "ing", "on", "er", "ré", "ß") for b in ("st", "an", "ou", "e")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(80, 1)
ITEM = prose(20, 2)
ROWS = [
    (0, prose(60, 10)), (1, prose(60, 10)), (2, prose(60, 10) + " End"), (3, None), (4, ""), (5, " \t\n\x0b "), (6, "one"), (7, "one"),
    (8, prose(40, 11) + " " + PASSAGE + " " + prose(40, 12)), (9, PASSAGE + "\n" + PASSAGE), (10, prose(30, 13) + "  " + ITEM.upper() + "!! " + prose(5, 14)),
    (11, "mail a.b+c@ex-am.ple.org, x@y, @z.com 10.0.0.256 10.0.0.25 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 +12"), (12, "aaaa " * 3000),
    (13, prose(20_000, 15)), (14, "日本語 😀 é   x  \r\n\tIt's we'LL 123abc"), (15, "line\nline\n\nother\nline\n"), (16, prose(60, 10)), (16, prose(60, 10)), (None, prose(25, 16)), (17, ITEM),
    *((20 + k, prose(100, 40) + " " + prose(k % 7 + 1, 50 + k)) for k in range(40)), *((100 + k, prose(30 + k, 200 + k)) for k in range(30)),
]
ITEMS = [(1, ITEM), (2, ITEM), (3, None), (4, "one"), (5, "..."), (None, prose(12, 14)), (6, prose(30, 77))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of the odd table and of empty ones. The documents carry columns named as outputs are."""
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    docs = spark.createDataFrame([(d, t, ["en", None][k % 2], [None, "src0", "src1"][k % 3], len(t or ""), "x", "y", k) for k, (d, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long, spans string, ids string, node int")
    labels = spark.createDataFrame([(d, 1 if d % 3 else 0, 0) for d in range(100, 130)] + [(3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items), ("pages", pages)):
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>';</script></head><body><nav><a href=/>Home</a></nav>{extra}{body}<footer>&copy; us</footer></body></html>"


PAGES = [
    (1, "http://a.example/1", page('<article><h1>Head &amp; more</h1><p>One  <b>two</b>\n&lt;three&gt;<p>Four<div class="ad">Buy</div></p></article><section class="comments"><p>Nice</p></section>')),
    (2, "http://a.example/2", page("<article><h1>Other</h1><p>Text &#233;&nbsp;x</p></article>", '<div id="cookie-notice">We use cookies</div><aside>Side</aside><form>Send</form>')),
    (3, "http://a.example/3", page("<article><p>Unclosed <i>tags<p>go on</article>", "<header>Top</header><!-- <article>no</article> -->")),
    (4, None, None), (5, "odd", ""), (6, "http://b.example/", "<div class=content><p>Only this</p></div><div class=sidebar>not this</div>"), (7, "http://c.example/", "plain < text"),
]
TEXTS = {1: "Head & more\n\nOne two <three>\n\nFour", 2: "Other\n\nText é x", 3: "Unclosed tags\n\ngo on", 4: "", 5: "", 6: "Only this", 7: "plain < text"}


@pytest.fixture(scope="module")
def results(spark, tables):
    from slicewise.llm import registry

    cache = {}

    def of(number, which=0):
        name = next(q for q in registry.QUERIES if q.startswith(f"op{number}_"))
        if (name, which) not in cache:
            cache[name, which] = registry.QUERIES[name](spark, tables[which]).collect()
        return cache[name, which]

    return of


def same(got, expected):
    """Rows as a multiset: ids may repeat or be null."""
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@pytest.mark.parametrize("number", range(1, 11))
def test_empty_tables_give_no_rows(results, number):
    assert results(number, 1) == []


@pytest.mark.parametrize("number", [1, 2, 3, 4, 6, 7, 8, 9, 10])
def test_every_row_is_answered(results, number):
    assert collections.Counter(r.doc_id for r in results(number)) == collections.Counter(d for d, _ in ROWS)


def test_decontamination(results):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, tuple(w[k : k + 10])) for i, t in ITEMS for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    expected = []
    for d, t in ROWS:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    ids |= {str(i)} if i is not None else set()
        expected.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    same(results(2), expected)


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have others; stretches and words of any length."""
    from slicewise.llm import common
    from slicewise.llm.decontaminate import WORD_BYTES, words_of

    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "ab", "ba", "Ab", "aab", "é", "z" * 90, "z" * 91, "\0", "", "x-y"]) for _ in range(r.randint(0, 60))).encode() for _ in range(50)] + [b"", b"  ", b"one"]
    for stretch in (40, 1 << 20):
        monkeypatch.setattr(common, "STRETCH", stretch)
        h, many = common.word_hashes(texts, WORD_BYTES)
        words = [w for t in texts for w in words_of(t)]
        assert many.tolist() == [len(words_of(t)) for t in texts] and len(h) == len(words)
        assert len(dict(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist(), strict=True)))
    assert common.word_hashes([], WORD_BYTES)[0].size == 0


def test_decontamination_with_a_full_filter(spark, tables, monkeypatch):
    """A filter that lets nearly all through changes nothing, nor does dropping the documents that are hit."""
    from slicewise.llm import decontaminate

    docs, items = (spark.read.parquet(f"{tables[0]}/{x}.parquet") for x in ("documents", "benchmark"))
    one = decontaminate.decontaminate(docs, items)
    assert {*docs.columns, "n_words", "n_hit", "item_ids", "hits", "contaminated"} == set(one.columns)
    rows = one.collect()
    monkeypatch.setattr(decontaminate, "filter_of", lambda keys, key: np.full(4096, 255, np.uint8))
    same(decontaminate.digest(decontaminate.decontaminate(docs, items)).collect(), list(map(tuple, decontaminate.digest(one).collect())))
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    same([(r.doc_id, r.text) for r in clean.collect()], [(r.doc_id, r.text) for r in rows if not r.contaminated])
    assert all(sum(h.end - h.start for h in r.hits) == r.n_hit for r in rows)


def test_byte_bpe(results):
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same(results(3), [(d, len(i), sha(" ".join(map(str, i))), sha(t or "")) for d, t in ROWS for i in [enc.encode_ordinary(t or "")]])


def test_byte_bpe_of_random_texts():
    import base64

    import public_tokenizers as p
    import tiktoken

    from slicewise.llm.bpe import Replay, read_ranks

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc, own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), Replay(read_ranks(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)
    parts = ["a", "b", "es", "ation", " ", "  ", "\n", "\x1c", "\x85", " ", "'s", "é", "日本", "😀", "1", "--", "aaaa", "the", " the", "\x00", "ſ", "​", "́"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(500)]
    texts += ["a" * 5000, "=" * 777, "é" * 300, "日本" * 400, "", "".join(random.choice("aeinst") for _ in range(3000))]
    pieces = [own.split(t) for t in texts]
    distinct = list(dict.fromkeys(p for ps in pieces for p in ps))
    flat, many = own.replay([x.encode() for x in distinct])
    ids = dict(zip(distinct, (x.tolist() for x in np.split(flat, np.cumsum(many)[:-1])), strict=True))
    assert [[i for x in ps for i in ids[x]] for ps in pieces] == [enc.encode_ordinary(t) for t in texts]
    assert all(own.by_itself(x.encode()) == ids[x] for x in distinct if x.encode() not in own.rank)


def test_merges_that_bring_up_a_smaller_rank(monkeypatch):
    """A made-up vocabulary in which ab, of a large rank, becomes abc, of a small one."""
    import tiktoken

    from slicewise.llm.bpe import Replay

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"cc", b"ab", b"abab", b"abcab", b"aa", b"aaa"]
    own = Replay(tokens, r"\S+|\s+")
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
    words = list({"".join(random.choice("abc") for _ in range(random.randint(1, 14))) for _ in range(3000)})
    flat, many = own.replay([w.encode() for w in words])
    assert [x.tolist() for x in np.split(flat, np.cumsum(many)[:-1])] == [enc.encode_ordinary(w) for w in words]


def test_encode_keeps_columns(spark, tables):
    import public_tokenizers as p

    from slicewise.llm import bpe

    path = p.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = bpe.decode(bpe.encode(docs, path, p.PATTERN), path, p.PATTERN)
    assert set(out.columns) == {*docs.columns, "n_tokens", "decoded"}
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out.collect())


def test_lattice_base_counts(results):
    tokens = [(d, (t or "").encode().translate(LOW).split() + [b"\n"]) for d, t in ROWS]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    base = [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in tokens]
    same([(*r[:5], round(r.base_score, 4)) for r in results(4)], base)
    assert all(r.score < 0 for r in results(4))


def test_lattice_sums_all_segmentations():
    import numpy as np

    from slicewise.llm.lattice import MARK, Lattice

    pieces = [MARK, MARK + "a", "a", "b", "ab", "aba", *(f"<0x{b:02X}>" for b in range(256))]
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1))
    lattice = Lattice(pieces, list(range(6, 262)), np.log(p))

    def total(text):
        if not text:
            return 1.0
        own = sum(p[k] * total(text[len(x) :]) for k, x in enumerate(pieces[:6]) if text.startswith(x))
        spelled = 1.0
        for b in text[0].encode():
            spelled *= p[6 + b]
        return own + (0 if text[0] in "ab" + MARK else spelled * total(text[1:]))

    words = ["ab", "aba", "ababab", "b", "éa", "abab"]
    assert np.allclose(lattice.score([w.encode() for w in words]), [math.log(total(MARK + w)) for w in words])
    long = "ab" * 50
    rows = np.array([[ord(c) + 1 for c in MARK + long]], np.uint64)
    assert np.isclose(lattice.alone(rows[0]), lattice.forward(rows)[0][0, -1])
    uses = lattice.expected([b"aba"], np.array([2.0]))
    paths = {(MARK, "a", "b", "a"): 0, (MARK + "a", "b", "a"): 0, (MARK, "ab", "a"): 0, (MARK, "aba"): 0}
    for path in paths:
        paths[path] = math.prod(p[pieces.index(x)] for x in path)
    z = sum(paths.values())
    assert np.allclose(uses[:6], [2 * sum(w * path.count(x) for path, w in paths.items()) / z for x in pieces[:6]])


def test_lattice_beats_spelling_at_random(results):
    """Held-out texts made of the corpus's words are likelier per token than ones that are not."""
    of = {r.doc_id: r.score / r.n_tokens for r in results(4)}
    assert of[104] > of[14]


def test_pages(results):
    assert {r.page_id: r.text for r in results(5)} == TEXTS
    assert all(r.n_chars == len(r.text) for r in results(5))


@pytest.mark.parametrize("most_sent", ["-1", "10m"])
def test_template_text_goes(spark, most_sent):
    from slicewise.llm import template

    rows = [(k, f"http://t.example/{k}", f"<body><div>Subscribe to our paper today</div><div><p>{prose(40, 300 + k)}</p></div><div>All rights and wrongs</div></body>") for k in range(12)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most_sent)
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: prose(40, 300 + k) for k in range(12)}


def test_rules_base(results):
    word, expected = re.compile(r"[^\x20\x09-\x0D]+"), []
    for d, t in ROWS:
        t = t or ""
        w = word.findall(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        expected.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    same([r[:7] for r in results(6)], expected)
    assert all(not (r.base_failed and r.kept) for r in results(6))


def test_rules_are_learned():
    import numpy as np

    from slicewise.llm import rules

    r = np.random.default_rng(2)
    x = r.random((3000, len(rules.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 4] > 0.6) & (x[:, 7] < 0.3))
    list_ = rules.learn(x, bad)
    caught = np.zeros(len(x), bool)
    for rule in list_:
        caught |= rules.holds(x, rule)
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.03 * (~bad).sum()


def test_sharding(results):
    out = results(7)
    size = lambda t: len((t or "").encode()) + 1
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out], [(d, size(t), zlib.crc32((t or "").encode()), "bytes", None) for d, t in ROWS])
    of_text = collections.defaultdict(set)
    for r in out:
        of_text[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.shard for r in out} <= set(range(8))
    # the largest shard is the least that contiguous cuts of the groups' order allow
    groups = collections.Counter()
    for _, t in ROWS:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += size(t)
    sizes = [groups[g] for g in sorted(groups)]

    def fits(c):
        n, room = 1, c
        for x in sizes:
            if x > room:
                n, room = n + 1, c
            room -= x
        return n <= 8

    low, high = max(sizes), sum(sizes)
    while low < high:
        low, high = (low, (low + high) // 2) if fits((low + high) // 2) else ((low + high) // 2 + 1, high)
    used = collections.Counter()
    for r in out:
        used[r.shard] += r.size
    assert max(used.values()) == low


def test_personal_data(results):
    luhn = lambda d: sum(sum(map(int, str(int(c) * 2))) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    expected = []
    for d, t in ROWS:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, form, good) in enumerate(forms) for m in re.finditer(form, t or "") if good(m[0]))
        expected.append((d, *(sum(s[3] == name for s in spans) for name, _, _ in forms), sha(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans))))
    same([r[:6] for r in results(8)], expected)


def test_strict_spans_of_random_texts():
    from slicewise.llm.pii import strict

    form = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(random.choice("a.@b-+1 _") for _ in range(random.randint(0, 25)))
        assert [s for s in strict(t) if s[2] == "email"] == [(m.start(), m.end(), "email") for m in form.finditer(t)], t


def test_secrets_are_added(spark):
    from slicewise.llm import pii

    r = random.Random(4)
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{prose(20, k)} token = "{code()}" {prose(5, k)}' if k % 3 else f"{prose(10, k)} item-{k}-of-the-long-list-2024 {prose(9, k)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in pii.find(docs, pii.learn(docs)).collect()}
    assert sum(any(s.kind == "secret" for s in out[k].spans) for k in range(300) if k % 3) > 190
    assert not any(out[k].spans for k in range(0, 300, 3))


def near_brute(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(LOW).split()
        s = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        if d is not None:
            sets[d] = s
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_duplicates(results):
    component, n = near_brute(ROWS, 4)
    for r in results(9):
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (n[r.doc_id], component[r.doc_id], r.doc_id == component[r.doc_id])
        else:
            assert (r.component_id, r.kept) == (None, True)


@pytest.mark.parametrize("dense", [0, 1000])
def test_near_duplicates_in_a_hot_group(spark, monkeypatch, dense):
    """Edited copies of one text, linked and not, with cells so small that a list needs many; all are dense or none is."""
    from slicewise.llm import near

    r = random.Random(9)
    base = prose(150, 500).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "DENSE", dense)
    got = {x.doc_id: x.component_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == near_brute(rows, 4)[0]
    assert len(set(got.values())) > 1


def test_a_chain_of_edited_texts_is_one_component(spark):
    """300 texts, each like its neighbours only, with ids in no order."""
    from slicewise.llm import near

    words = [f"w{k}" for k in range(100 + 300 * 9)]
    ids = random.Random(4).sample(range(1000), 300)
    rows = [(d, " ".join(words[9 * k : 9 * k + 100])) for k, d in enumerate(ids)]
    got = {x.doc_id: x.component_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == near_brute(rows, 4)[0] and set(got.values()) == {min(ids)}


def repeats_brute(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def test_repeats(results):
    same(results(10), repeats_brute(ROWS))


@pytest.mark.parametrize("many", [0, 3, 20_000])
def test_repeats_across_small_blocks(spark, many):
    """Blocks, stretches and groups so small that every way is taken."""
    from slicewise.llm import repeats

    r = random.Random(many)
    shared = [prose(25, 600 + k) for k in range(6)]
    rows = [(k, prose(r.randint(0, 20), 700 + k) + r.choice(shared) * r.randint(0, 3) + "ab" * r.randint(0, 120) + r.choice(shared)[r.randint(0, 60) :]) for k in range(60)]
    same(repeats.digest(repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_bytes=2000, stretch=700, many=many)).collect(), repeats_brute(rows))


@pytest.mark.parametrize("length", [64, 65, 100, 113, 128, 160, 200, 257, 400])
def test_repeats_of_any_length(spark, length):
    """Texts that share stretches shorter and longer than the length, equal but for one byte anywhere."""
    from slicewise.llm import repeats

    r = random.Random(length)
    base = "".join(r.choice("abcdefgh ") for _ in range(3 * length))
    rows = []
    for k in range(40):
        cut, n = r.randrange(len(base)), r.randint(length // 2, 3 * length)
        piece = list(base[cut : cut + n])
        if piece and k % 2:
            piece[r.randrange(len(piece))] = "é#"[k % 4 // 2]
        rows.append((k, "".join(r.choice("xyz") for _ in range(r.randint(0, 30))) + "".join(piece)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(repeats.digest(repeats.repeats(docs, length=length, block_bytes=6 * length, stretch=2 * length, many=r.choice([0, 20_000]))).collect(), repeats_brute(rows, length))


def test_suffix_ranks_against_a_sort():
    from slicewise.llm.repeats import suffix_ranks

    r = np.random.default_rng(4)
    data = r.integers(0, 3, 400).astype(np.uint8)
    for length in (1, 7, 8, 9, 64, 100):
        at = r.choice(301, 150)
        suffixes = [data[i : i + length].tobytes() for i in at]
        assert suffix_ranks(data, at, length).tolist() == [sorted(suffixes).index(x) for x in suffixes]


def test_strings_that_are_ordered_together(monkeypatch):
    """Whatever the number that is ordered at a time, the same strings of a block are first."""
    from slicewise.llm import repeats

    r = random.Random(12)
    base = "".join(r.choice("abc ") for _ in range(700))
    texts = [(base[r.randrange(600) :] + base[: r.randrange(300)] + "x" * (k % 3)).encode() for k in range(12)]
    row = {"ids": np.arange(12).tobytes(), "ends": np.cumsum([len(t) for t in texts]).tobytes(), "nulls": bytes(12), "data": __import__("zstandard").ZstdCompressor().compress(b"".join(texts))}
    block, seen = repeats.Block(row, 100, 500), []
    for most in (1, 60, 10**9):
        monkeypatch.setattr(repeats, "TOGETHER", most)
        starts, first = block.windows(np.arange(len(block.key)))
        seen.append(sorted(zip(starts.tolist(), first.tolist(), strict=True)))
        assert [x for a, b in repeats.together(np.array([1, 1, 2, 3, 3]), np.array([5, 50, 1, 70, 1])) for x in range(a, b)] == list(range(5))
    data = block.data.tobytes()
    known: dict[bytes, int] = {}
    expected = []
    for s, _ in seen[0]:
        expected.append((s, known.setdefault(data[s : s + 100], s) == s))
    assert seen[0] == seen[1] == seen[2] == expected


def test_classifier_on_held_out_labels(spark):
    """Half of the labels teach; the others must be told right."""
    from pyspark.sql import functions as F

    from slicewise.llm import quality

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    taught = quality.classify(docs, labels.where(F.xxhash64(F.col("doc_id") + 7) % 2 == 0))
    test = labels.where(F.xxhash64(F.col("doc_id") + 7) % 2 != 0).join(taught, "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    low, toxic = F.col("quality") == 0, (F.col("quality") == 1) & (F.col("toxic") == 1)
    clean, low, toxic = test.agg(*(F.avg(F.when(x, F.col("kept").cast("int"))) for x in (good, low, toxic))).first()
    assert clean > 0.99 and low < 0.05 and toxic < 0.1, (clean, low, toxic)


def test_sparse_sites_are_shrunk(spark):
    from slicewise.llm import quality

    paths = spark.createDataFrame([("h", 1000, 900.0), ("i", 1000, 100.0), ("j", 2, 2.0), ("k", 1000, 480.0)], "host string, n long, s double")
    k = quality.strength(paths, 0.5)
    assert 1 <= k < 100
    assert quality.strength(spark.createDataFrame([("h", 1000, 500.0), ("i", 1000, 500.0)], "host string, n long, s double"), 0.5) == 1e6


def test_posteriors_against_plain_sums(spark, tables):
    """Rates of paths and hosts and each document's odds, from the documents' own probabilities."""
    from slicewise.llm import quality

    docs, labels = (spark.read.parquet(f"{tables[0]}/{x}.parquet") for x in ("documents", "labels"))
    got = quality.rated(quality.scored(docs, labels, ["doc_id"], None, None, 20_000)).collect()
    sums = {"__host": collections.defaultdict(list), "__path": collections.defaultdict(list)}
    for r in got:
        assert math.isclose(r.p_document, 1 / (1 + math.exp(-r["__z"])))
        for k, x in sums.items():
            x[r[k]].append(r.p_document)
    rate = sum(r.p_document for r in got) / len(got)

    def weight(groups):
        within = rate * (1 - rate)
        between = sum(len(g) * (sum(g) / len(g) - rate) ** 2 for g in groups) / len(got) - within * len(groups) / len(got)
        return max(1, within / between - 1) if between > within / 1e6 else 1e6

    w = {k: weight(list(x.values())) for k, x in sums.items()}
    for r in got:
        h, p = sums["__host"][r["__host"]], sums["__path"][r["__path"]]
        host = (sum(h) + w["__host"] * rate) / (len(h) + w["__host"])
        path = (sum(p) + w["__path"] * host) / (len(p) + w["__path"])
        odds = math.exp(r["__z"]) * path / (1 - path) * (1 - rate) / rate
        assert math.isclose(r.host_rate, host, rel_tol=1e-6) and math.isclose(r.path_rate, path, rel_tol=1e-6) and math.isclose(r.p_bad, odds / (1 + odds), rel_tol=1e-6)


def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "pii", "byte_bpe"]
    for folder in tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema.names == docs.schema.names
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_pipeline_against_plain_stages(spark, tables, results):
    """Each stage's decision is the operator's, on the whole of what the stage before kept."""
    import corpus_pipeline
    from slicewise.llm import quality

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("doc_id is not null")
    kept = corpus_pipeline.near_dedup(spark, docs, tables[0]).collect()
    component, _ = near_brute(ROWS, 5)
    assert sorted(r.doc_id for r in kept) == sorted({c for d, c in component.items()})
    clean = corpus_pipeline.decontamination(spark, docs, tables[0]).collect()
    assert collections.Counter(r.doc_id for r in clean) == collections.Counter(r.doc_id for r in results(2) if not r.contaminated and r.doc_id is not None)
    hidden = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, tables[0]).collect()}
    assert "[EMAIL]" in hidden[11].text and "[PHONE]" in hidden[11].text and hidden[11].n_chars == len(hidden[11].text) and hidden[3].text is None
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, tables[0]).collect()} == good
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.byte_bpe(spark, docs, tables[0]).collect():
        texts = [t or "" for d, t in ROWS if d == r.doc_id]
        assert (r.ids, r.n_tokens, r.decoded_sha256) in [(i, len(i), sha(t)) for t in texts for i in [enc.encode_ordinary(t)]] and r.ids_sha256 == sha(" ".join(map(str, r.ids)))


def test_clashing_columns_of_every_table(spark, tables):
    """Columns of labels, benchmark and pages that are named as an operator's own are in nobody's way."""
    from pyspark.sql import functions as F

    from slicewise.llm import decontaminate, quality, rules, template

    docs, labels, items, pages = (spark.read.parquet(f"{tables[0]}/{x}.parquet") for x in ("documents", "labels", "benchmark", "pages"))
    rows = lambda df: collections.Counter(map(str, df.collect()))
    more = lambda df, *names: df.withColumns({c: F.lit("x") for c in names})
    assert rows(template.extract(more(pages, "host", "tags", "main", "texts", "text", "n_chars", "token"))) == rows(template.extract(pages))
    assert rows(decontaminate.digest(decontaminate.decontaminate(docs, more(items, "item", "words", "n", "token", "place")))) == rows(decontaminate.digest(decontaminate.decontaminate(docs, items)))
    assert rows(quality.classify(more(docs, "host", "path", "z", "p_bad", "n", "s"), more(labels, "text", "low", "bad", "words", "shape"))) == rows(quality.classify(docs, labels))
    assert rows(rules.quality_rules(more(docs, "t", "words", "n_words", "rule", "kept"), more(labels, "bad", "text", "n_words"))) == rows(rules.quality_rules(docs, labels))


@pytest.mark.parametrize("number", [3, 4, 6, 8, 9, 10])
def test_one_huge_word(spark, number, tmp_path):
    """A text of one word of some ten thousand characters, next to its copy, is treated like any other."""
    from slicewise.llm import registry

    r = random.Random(1)
    word = "".join(r.choice("abcdefghij0123456789") for _ in range(12_000))
    docs = spark.createDataFrame([(1, word), (2, word), (3, "a few short words")], "doc_id long, text string")
    docs.withColumn("lang", docs["text"].substr(1, 1)).withColumn("source", docs["text"].substr(1, 1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in next(f for n, f in registry.QUERIES.items() if n.startswith(f"op{number}_"))(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    if number == 3:
        assert got[1].decoded_sha256 == got[2].decoded_sha256 == sha(word)
    elif number == 4:
        assert -1000 < got[1].score == got[2].score < 0
    elif number == 6:
        assert (got[1].n_words, got[1].word_chars, got[1].base_failed) == (1, 12_000, True)
    elif number == 9:
        assert (got[2].component_id, got[2].n_shingles, got[3].component_id) == (1, 1, 3)
    elif number == 10:
        assert (got[1].n_removed, got[2].n_removed) == (0, 12_000)
