"""No text of a page is lost but what its elements or its host's template explain."""

import collections
import random
import re

WORDS = "onder ther ingst anou erbe theran stou anst eran".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{seed}" for _ in range(n))


def test_short_and_linked_blocks_stay():
    from slicewise.llm.template import Template, main_text

    long = prose(200, 1)
    assert main_text(f"<body><h1>Headline</h1><div>{long}</div><div><p>Short</p></div><section><p>See <a href=/x>the linked page</a></p></section></body>", Template()) == f"Headline\n\n{long}\n\nShort\n\nSee the linked page"


def test_all_articles_are_joined():
    from slicewise.llm.template import Template, main_text

    one, two = prose(50, 2), prose(20, 3)
    assert main_text(f"<body><nav>Menu</nav><article><p>{one}</p></article><div>between</div><article><p>{two}</p></article><article class=comment>Nice</article></body>", Template()) == f"{one}\n\n{two}"


def test_an_articles_shared_heading_stays(spark):
    from slicewise.llm import template

    rows = [(k, f"http://t.example/{k}", f"<body><div>All rights</div><article><h2>Method</h2><p>{prose(40, 10 + k)}</p></article></body>") for k in range(12)]
    rows += [(k, f"http://u.example/{k}", f"<body><div>All rights</div><h2>Headline {k}</h2><div>{prose(200, 10 + k)}</div><div>Short {k}</div></body>") for k in range(20, 32)]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Method\n\n{prose(40, 10 + k)}" if k < 12 else f"Headline {k}\n\n{prose(200, 10 + k)}\n\nShort {k}" for k in got}


def site(k):
    """A page with all that surrounds an article, some of it on some pages only, and its article's text."""
    r = random.Random(k)
    menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("home", "news", "about"))
    article = [f"Title {k}", *(prose(r.randint(1, 30), 100 * k + i) for i in range(r.randint(1, 4)))]
    notice = '<div class="cookie-notice"><p>We count visits</p></div>' if k % 3 else ""
    replies = "".join(f'<div class="comment"><p>{prose(6, 1000 + 10 * k + i)}</p></div>' for i in range(k % 4))
    body = f"<h1>{article[0]}</h1>" + "".join(f"<p>{x}</p>" for x in article[1:])
    html = f'<html><body class="b{k}"><nav><ul>{menu}</ul></nav>{notice}<div class="ad">{prose(5, 5000 + k)}</div><article>{body}</article><div class="comments"><h3>Comments</h3>{replies}</div><footer>Rights {k}</footer></body></html>'
    return html, "\n\n".join(article)


def test_the_template_decides_without_class_names(spark):
    from slicewise.llm import template

    pages = [site(k) for k in range(20)]
    rows = [(k, "http://s.example/", re.sub(' class="[^"]*"', "", h)) for k, (h, _) in enumerate(pages)] + [(100 + k, "http://t.example/", h) for k, (h, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: pages[k % 100][1] for k in got} and len(got) == 40


def test_template_against_full_occurrence_vectors(spark):
    from slicewise.llm import template as t

    pages = [site(k)[0] for k in range(25)]
    events = [[e for e in t.read(p) if isinstance(e, str)] for p in pages]
    counts = [collections.Counter(e) for e in events]
    by_vector = collections.defaultdict(list)
    for token in {x for e in events for x in e}:
        vector = tuple(c[token] for c in counts)
        if sum(n > 0 for n in vector) >= t.SHARE * len(pages):
            by_vector[vector].append(token)
    root = set(max((v for v in by_vector if max(v) == 1), key=lambda v: (sum(v), len(by_vector[v]))) and by_vector[max((v for v in by_vector if max(v) == 1), key=lambda v: (sum(v), len(by_vector[v])))])
    expected = set()
    for own in by_vector.values():
        orders, places = set(), set()
        for e in events:
            seq, last = [], None
            for x in e:
                if x in own:
                    seq.append(x)
                    places.add(None if set(own) == root else last)
                last = x if x in root else last
            orders |= {tuple(seq[i : i + len(own)]) for i in range(0, len(seq), len(own))}
        if len(own) >= t.CLASS and len(orders) == 1 and len(places) == 1:
            expected |= set(own)
    rows = spark.createDataFrame([(k, "http://s.example/", p) for k, p in enumerate(pages)] + [(50 + k, "http://s.example/copy", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    (got,) = t.templates(rows).collect()
    assert set(got.tags) == {t.token_id(x) for x in expected} and root <= expected and len(expected) > len(root)


def test_articles_in_what_surrounds_them_stay_out():
    from slicewise.llm.template import Template, main_text

    main = f"<article><h1>Title</h1><p>{prose(40, 1)}</p></article>"
    want = f"Title\n\n{prose(40, 1)}"
    for extra in ('<aside class="related"><article>Teaser</article></aside>', '<div class="comments"><article>A reader comment</article></div>', '<div class="comment-list"><article><p>One</p></article><article><p>Two</p></article></div>', "<nav><section><article>Menu</article></section></nav>"):
        assert main_text(f"<body>{main}{extra}</body>", Template()) == want, extra
        assert main_text(f"<body>{extra}{main}</body>", Template()) == want, extra
    assert main_text(f'<body><div class="ad"><p>Buy{main}</body>', Template()) == want  # an advert that was left open
    assert main_text(f'<body class="with-sidebar"><form action=x><div class="content-with-sidebar">{main}</div></form></body>', Template()) == want


def test_inline_adverts_and_buttons_leave_their_paragraph():
    from slicewise.llm.template import Template, main_text

    assert main_text('<article><p>One <span class="advert">Buy <b>now</b></span>two<button>Share</button> three</p><p>Four</p></article>', Template()) == "One two three\n\nFour"


def test_hyphenated_names_in_articles():
    from slicewise.llm.template import Template, main_text

    kept = "".join(f'<div class="{c}">{c} is told</div>' for c in ("share-price", "search-methods", "menu-prices", "notice-period", "advertising-history"))
    left = "".join(f'<div class="{c}">gone</div>' for c in ("share-bar", "ad-slot", "cookie_notice", "related-links", "newsletter-box", "comments-section"))
    got = main_text(f"<article><h1>Title</h1>{kept}{left}</article>", Template())
    assert got.count("is told") == 5 and "gone" not in got
