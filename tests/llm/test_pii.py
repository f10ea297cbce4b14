"""Every kind of personal data is found: beside words that name it, and by the trees alone."""

import random

LONG = "".join(random.Random(5).choices("0123456789abcdef", k=320))
WORDS = "onder ther ingst anou erbe theran stou anst eran".split()
NAMED = {
    "EMAIL": "mail me at jane.doe at example dot com",
    "IP": "from 10.20.30.40",
    "CARD": "paid with 4111-1111-1111-1111",
    "PHONE": "phone: (555) 010-9999",
    "SECRET": f'token = "{LONG}"',
    "IDENTITY": "SSN: 123-45-6789",
}
ALONE = {"EMAIL": "jane.7 at mail2 dot example dot com", "CARD": "4111.1111.1111.1111", "PHONE": "(312) 555-0199", "SECRET": LONG, "IDENTITY": "123-45-6789"}


def hidden(spark, texts):
    from slicewise.llm import pii

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.redacted(docs).collect()}


def test_one_of_every_kind_beside_its_name(spark):
    out = hidden(spark, [f"a line {x} and more" for x in NAMED.values()])
    for k, kind in enumerate(NAMED):
        assert f"[{kind}]" in out[k] and not any(c.isdigit() for c in out[k]), out[k]
    assert "doe" not in out[0]


def test_one_of_every_kind_without_its_name(spark):
    r = random.Random(8)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = lambda: " ".join(r.choice(WORDS) for _ in range(8))
    taught = []
    for k in range(150):
        card = digits(15)
        card += next(c for c in "0123456789" if sum(sum(map(int, str(int(x) * 2))) if i % 2 else int(x) for i, x in enumerate((card + c)[::-1])) % 10 == 0)
        secret = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([40, 64, 320])))
        taught.append(f'{words()} {r.choice(WORDS)}.{k}@mail{k % 9}.example.com {words()} +1 ({r.randint(200, 999)}) 555-{digits(4)} {words()} {card} {words()} key = "{secret}" {words()} item-{k}-of-the-long-list-2024 {words()}')
    texts = [f"{words()} {x} {words()}" for x in ALONE.values()]
    plain = ["look at example.com", "000-12-3456", "4111.1111.1111.1112", "item-7-of-the-long-list-2024", "2024-01-15 30"]
    out = hidden(spark, taught + texts + [f"{words()} {x} {words()}" for x in plain])
    for k, kind in enumerate(ALONE):
        assert f"[{kind}]" in out[len(taught) + k], out[len(taught) + k]
    for k, x in enumerate(plain):
        assert x in out[len(taught) + len(texts) + k]


def test_candidates_overlap_and_runs_have_no_limit():
    from slicewise.llm.pii import proposed

    run = " ".join(["12"] * 300) + " 4111 1111 1111 1111 99 (312) 555-0199 " + "7 " * 100 + "123-45-6789"
    found = {(run[s:e], k) for s, e, k in proposed(run)}
    assert {("4111 1111 1111 1111", "card"), ("(312) 555-0199", "phone"), ("123-45-6789", "identity")} <= found
    assert any(k == "phone" and "12 12" in x for x, k in found)
    assert len(list(proposed("1 " * 20_000))) < 200_000


def test_precision_and_recall_of_forms_without_words(spark):
    """Half of the planted texts teach nothing but strict forms; loose forms without any naming words are then told from decoys."""
    from slicewise.llm import pii

    r = random.Random(21)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = lambda n=8: " ".join(r.choice(WORDS) for _ in range(n))

    def card(good):
        d = digits(15)
        want = [c for c in "0123456789" if (sum(sum(map(int, str(int(x) * 2))) if i % 2 else int(x) for i, x in enumerate((d + c)[::-1])) % 10 == 0) == good]
        return d + want[0]

    four = lambda d, by: by.join(d[i : i + 4] for i in range(0, 16, 4))
    taught = [f'{words()} {r.choice(WORDS)}.{k}@mail{k % 9}.example.com {words()} +1 ({r.randint(200, 999)}) 555-{digits(4)} {words()} {card(True)} {words()} key = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {words()} {card(False)} {words()}' for k in range(200)]
    true = [four(card(True), ".") for _ in range(40)] + [f"({r.randint(201, 989)}) {r.randint(201, 989)}-{digits(4)}" for _ in range(40)] + ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    false = [four(card(False), ".") for _ in range(60)] + [card(False) for _ in range(30)] + [f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)} {digits(2)}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(taught + [f"{words()} {x} {words()}" for x in true + false])), "doc_id long, text string")
    hit = {x.doc_id - len(taught) for x in pii.find(docs, pii.learn(docs)).collect() if x.spans and x.doc_id >= len(taught)}
    recall, wrong = sum(k < len(true) for k in hit) / len(true), sum(k >= len(true) for k in hit)
    assert recall >= 0.9 and wrong <= 0.05 * len(hit), (recall, wrong, [x for k, x in enumerate(true) if k not in hit][::9])


def test_time_grows_with_the_text():
    """Megabytes of numbers, and thousands of phones, take seconds."""
    import time

    from slicewise.llm.pii import proposed, spans_of

    r = random.Random(2)
    for text in (" ".join(str(r.randint(0, 99)) for _ in range(300_000)), " ".join(f"+1 (555) {r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(20_000)), "1 " * 500_000):
        began = time.time()
        proposed(text)
        taken = time.time() - began
        began = time.time()
        proposed(text[: len(text) // 2])
        assert taken < 12 and taken < 4 * (time.time() - began) + 0.5
    began = time.time()
    spans_of(" ".join(f"+1 (555) {r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(8_000)), None)
    assert time.time() - began < 8


def test_naming_words_do_not_make_addresses_or_phones():
    from slicewise.llm.pii import spans_of

    for text in ("Please contact us at example.com today", "write to me at home.com", "Call 2019-05-06 1000 units", "call 06.05.2019 1000 now"):
        assert spans_of(text, None)[1] == [], text
    for text, span in (("mail jan.kow at firma dot pl now", "jan.kow at firma dot pl"), ("contact: ana [at] loja.com.br", "ana [at] loja.com.br"), ("reach me at jo at site dot museum.", "jo at site dot museum"), ("call (312) 555-0199", "(312) 555-0199")):
        assert [text[s:e] for s, e, _ in spans_of(text, None)[1]] == [span], text


def test_spans_over_each_other():
    from slicewise.llm.pii import Taken

    taken = Taken([(0, 200, "secret"), (250, 260, "ip")])
    assert set(taken.over((190, 195, "card"))) == {(0, 200, "secret")} and not set(taken.over((200, 250, "card"))) and set(taken.over((0, 300, "x"))) == {(0, 200, "secret"), (250, 260, "ip")}
