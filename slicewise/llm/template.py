"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags (start and end, with the elements that they stand in and their own class names) and its text
blocks. Over the distinct pages of a host, tokens that share their occurrence vector (how often each stands on each page) are
an equivalence class. A class is valid if it is large and frequent enough, its tokens keep one order wherever they stand, and
it lies in one place of the class that stands once on the most pages (the root), so that valid classes nest into the host's
template: the root's tokens in order, and between two of them the classes that repeat or are optional there. What follows a
template token up to the next one is a slot, named by that token.

The template decides which slots are main text, over all of the host's pages at once; element and class names are only features
of a slot. Where most pages have text in article elements, the main slots are those whose text lies there for the greater part;
else all whose text is for the greater part not in elements that surround an article (menus, headers, footers, sidebars, notices,
adverts, forms, comments). A page's main text is the text in main slots and in its articles, without blocks that its own elements or,
outside articles, the template's own texts explain. A page without any text in main slots is judged by its elements alone, and so is a
host without a template.

Occurrence vectors are never built: their fingerprint is an exclusive or over the pages, which Spark sums up partially on each
executor, so a host of any size is counted without gathering its pages; order, places and features of slots are minima, maxima
and sums over pages too. Templates meet their pages by host; as they are small, Spark can send them to all tasks or split the
pages of a large host.

Defined cases: null html gives an empty text; a null or odd url is a host of its own kind (empty name); a host with fewer than
`LEAST` distinct pages has no template; pages of one main text count once for the template, by the least of them; repeated rows
get the same text; very long pages are read whole; an empty table gives no rows; further columns of pages are left behind. An article in a
closed aside, comment list or the like stays out, one behind an element that was just left open does not; inline adverts and buttons leave their
paragraph.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, stored

#: Distinct pages that a class must stand on, share of the host's distinct pages, and tokens in a class.
LEAST, SHARE, CLASS = 3, 0.6, 2
#: Hosts whose template a task remembers.
MEMO = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select title head object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav aside footer form button dialog menu".split())
#: Words in class, id or role that name what surrounds an article.
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup login popup modal overlay share sharing social comment comments commentlist discussion disqus replies reply respond related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar widget search skip".split()
)
#: Words that may stand beside one of these in a name, and elements whose names do not speak of their whole text.
SAYING_NOTHING = frozenset(
    "area bar block body bottom box btn button card cell center column container content footer form frame global head header holder icon inline inner item items js label layout left line link links list main module outer page panel primary right row secondary section side site slot small style sub text title top unit wrap wrapper zone".split()
)
PLAIN = frozenset("html body main".split())
INNER = frozenset("article main".split())
INNER_NAMES = frozenset(["articlebody", "article-body", "article-content", "post-content", "entry-content", "post-body", "story-body", "main-content", "content-main", "article", "post", "content", "main", "story"])
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z/][^<>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def token_id(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(100_000)
def tag_id(tag: str) -> int:
    return token_id(tag)


class Element:
    """An open element: whether its text is left out, whether it lies in an article-like element, and whether its own end came."""

    __slots__ = ("away", "closed", "inner", "opens", "tag")

    def __init__(self, tag: str, away: bool, inner: bool, opens: bool):
        self.tag, self.away, self.inner, self.opens, self.closed = tag, away, inner, opens, False


class Piece:
    """A text block: its text, whether its elements are left out, and whether it lies in an article-like element."""

    __slots__ = ("around", "away", "inner", "text")

    def __init__(self, text: str, stack: list[Element]):
        self.text = text
        first = next((k for k, e in enumerate(stack) if e.opens), len(stack))
        self.inner = bool(stack) and stack[-1].inner
        self.away = any(e.away for e in stack[first:] if not e.opens) or not self.inner and any(e.away for e in stack)
        self.around = [] if self.away else [e for e in stack if e.away and e.tag != "form"]  # of an article

    def settle(self) -> None:
        """Once the page is read: what surrounds an article leaves it out if it was closed behind it, not if it was just left open."""
        if any(e.closed for e in self.around):
            self.away, self.inner = True, False
        self.around = []


def read(page: str) -> list[str | Piece]:
    """Tag tokens and text blocks in order."""
    events: list[str | Piece] = []
    stack: list[Element] = []
    run: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            events.append(Piece(text, stack))
        run.clear()

    def write(text: str) -> None:
        """Text of inline elements that are left out is no part of the block around them."""
        if not any(e.away and e.tag not in BLOCK for e in stack):
            run.append(text)

    def say(tag: str, names: frozenset[str] = frozenset()) -> None:
        events.append("/".join([*(e.tag for e in stack if e.tag in BLOCK), tag]) + "".join(f".{n}" for n in sorted(names)))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            write(page[at:])
            break
        write(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        rest = m["rest"] or ""
        if m["end"]:
            known = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if tag in BLOCK:
                flush()
            if known is not None and (tag in BLOCK or not any(e.tag in BLOCK for e in stack[known:])):  # an inline end does not close blocks
                stack[known].closed = True
                del stack[known:]
            if tag in BLOCK:
                say(f"/{tag}")
            continue
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|(?=<body\b)", re.I).search(page, at)
            flush()
            say(tag)
            at = close.end() if close else (size if tag in ("script", "style") else at)
            continue
        names = frozenset(w for a in ATTRIBUTE.finditer(rest) for w in re.split(r"\s+", (a[2] or a[3] or a[4] or "").lower()) if w) if rest else frozenset()
        if tag in BLOCK:
            flush()
            if tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
                while stack and stack[-1].tag in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
            elif tag == "p" or tag[0] == "h":
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCK), None)
                if k is not None and stack[k].tag == "p":
                    del stack[k:]
            say(tag, names)
        if tag in VOID or rest.endswith("/"):
            if tag == "br":
                write(" ")
            continue
        within = bool(stack) and stack[-1].inner
        is_inner = tag in INNER or (tag in ("div", "section", "td") and bool(names & INNER_NAMES))
        header = tag == "header" or tag not in PLAIN and any(w == "header" for n in names for w in re.split("[-_]", n))
        away = tag in AWAY or tag not in PLAIN and any(map(says_away, names)) or header and not within
        stack.append(Element(tag, away, within or is_inner and not away, is_inner and not away))
    flush()
    for e in events:
        if isinstance(e, Piece):
            e.settle()
    return events


@lru_cache(100_000)
def says_away(name: str) -> bool:
    """Whether a class, id or role names what surrounds an article: with every part of it, but for words that say nothing."""
    parts = [w for w in re.split("[-_]", name) if w and not w.isdigit()]
    return any(w in NAMES for w in parts) and all(w in NAMES or w in SAYING_NOTHING for w in parts)


class Template:
    """What extraction needs of a host: the ids of its tag tokens, of the slots that are left out or taken, and of its texts."""

    def __init__(self, tags: list[int] | None = None, main: list[int] | None = None, texts: list[int] | None = None):
        self.tags, self.main, self.texts = frozenset(tags or ()), None if main is None else frozenset(main), frozenset(texts or ())


def main_text(page: str, template: Template) -> str:
    slot, found = 0, []
    for e in read(page):
        if isinstance(e, Piece):
            if not e.away:
                found.append((e, slot))
        elif (t := tag_id(e)) in template.tags:
            slot = t
    explained = lambda p: not p.inner and token_id(p.text) in template.texts
    own = [p for p, at in found if (at in template.main or p.inner) and not explained(p)] if template.main is not None else []
    own = own or [p for p, _ in found if p.inner] or [p for p, _ in found if not explained(p)]
    return "\n\n".join(p.text for p in own)


#: Of each token of a page: its id, the text's code points or -1 for a tag, 1 if in an article, 2 if left out by its elements.
EVENTS = "token array<long>, chars array<int>, of array<int>"
Events = tuple[list[int], list[int], list[int]]


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, events): the tokens of each distinct page of a host; pages of one main text count as one, the least."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = {"host": batch.column(0), "page": [], "token": [], "chars": [], "of": []}
            for page in batch.column(1).to_pylist():
                events = read(page or "")
                pieces = [e for e in events if isinstance(e, Piece)]
                out["page"].append(token_id("\n".join(p.text for p in pieces if p.inner) or "\n".join(p.text for p in pieces)))
                out["token"].append([token_id(e.text) if isinstance(e, Piece) else tag_id(e) for e in events])
                out["chars"].append([len(e.text) if isinstance(e, Piece) else -1 for e in events])
                out["of"].append([e.inner + 2 * e.away if isinstance(e, Piece) else 0 for e in events])
            return out

        return run

    one = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), make, f"host string, page long, {EVENTS}")
    least = F.min(F.struct(F.size("token").alias("n"), "token", "chars", "of")).alias("least")
    return one.groupBy("host", "page").agg(least).select("host", "page", *(F.col(f"least.{c}").alias(c) for c in ("token", "chars", "of")))


def classes(seen: DataFrame) -> DataFrame:
    """(host, pages, tokens array<struct<vector, token, on, once, is_text>>): the frequent tokens of each host, by occurrence vector."""
    counts = seen.select("host", "page", F.explode(F.arrays_zip("token", "chars")).alias("e")).groupBy("host", "page", "e.token").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("e.chars") >= 0).alias("is_text"))
    tokens = counts.groupBy("host", "token").agg(F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("n").alias("most"), F.max("is_text").alias("is_text"))
    many = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    frequent = tokens.join(many, "host").where((F.col("on") >= LEAST) & (F.col("on") >= SHARE * F.col("pages")))
    return frequent.groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("vector", "token", "on", (F.col("most") == 1).alias("once"), "is_text"))).alias("tokens"))


def root_of(tokens: list[dict]) -> int | None:
    """The class of tags that stands once on the most pages; of equal ones the larger."""
    size = Counter((t["on"], t["vector"]) for t in tokens if t["once"] and not t["is_text"])
    return max(((on, n, v) for (on, v), n in size.items()), default=(0, 0, None))[2]


class Classes:
    """A host's classes of tags, for a look at how they stand on a page."""

    def __init__(self, tokens: list[dict]):
        self.of = {t["token"]: t["vector"] for t in tokens if not t["is_text"]}
        self.size, self.root = Counter(self.of.values()), root_of(tokens)

    def standing(self, events: Events) -> Iterator[tuple[int, int, int, int, bool]]:
        """For each tag token of a class on a page: (class, token, its place in the class's order, the root's token before it, whether
        the class's tokens take turns and stay in one place of the root)."""
        turns: dict[int, list[int]] = {}
        slots: dict[int, set[int]] = {}
        slot, of, root = 0, self.of, self.root
        for e in events[0]:
            v = of.get(e)
            if v is not None:
                turns.setdefault(v, []).append(e)
                slots.setdefault(v, set()).add(0 if v == root else slot)
                slot = e if v == root else slot
        for v, seq in turns.items():
            k = self.size[v]
            good = len(slots[v]) == 1 and len(seq) % k == 0 and len(set(seq[:k])) == k and seq[k:] == seq[:-k]
            for place, t in enumerate(dict.fromkeys(seq)):
                yield v, t, place, min(slots[v]), good


class Slots:
    """A host's tag tokens and texts, for the features of its slots on a page."""

    def __init__(self, tags: list[int] | None, texts: list[int] | None):
        self.tags, self.texts = frozenset(tags or ()), frozenset(texts or ())

    def of(self, events: Events) -> Iterator[tuple[int, int, int, int]]:
        """For each slot of a page: (its token, code points that the template's texts do not explain, of these in articles, of these left out)."""
        slot, out = 0, {}
        for token, chars, of in zip(*events, strict=True):
            if chars < 0:
                slot = token if token in self.tags else slot
            elif of & 1 or token not in self.texts:
                x = out.setdefault(slot, [0, 0, 0])
                x[0] += chars
                x[1] += chars * (of == 1)
                x[2] += chars * (of >= 2)
        yield from ((s, *x) for s, x in out.items())


class Memo(dict):
    """What a function makes of a host's columns, made once for each host that a task meets; MEMO hosts at most."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def get(self, host: str, batch: pa.RecordBatch, row: int, columns: list[str]):
        if host not in self:
            if len(self) >= MEMO:
                self.clear()
            self[host] = self.make(*(batch[c][row].as_py() for c in columns))
        return self[host]


def per_page(seen: DataFrame, of_host: DataFrame, columns: list[str], of: Callable, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """(host, schema): the rows that a function gives for each page, from what `of` makes of its host's columns and from its tokens."""
    names = [f.name for f in pa_schema(seen.sparkSession, schema)]

    def make():
        memo = Memo(of)

        def run(batch: pa.RecordBatch) -> dict:
            hosts, found = [], []
            for k, (host, *events) in enumerate(zip(*(batch[c].to_pylist() for c in ("host", "token", "chars", "of")), strict=True)):
                before = len(found)
                found.extend(rows(memo.get(host, batch, k, columns), events))
                hosts.extend([host] * (len(found) - before))
            return {"host": hosts, **(dict(zip(names, zip(*found, strict=True), strict=True)) if found else {c: [] for c in names})}

        return run

    return map_batches(seen.join(of_host, "host").select("host", "token", "chars", "of", *columns), make, f"host string, {schema}")


def templates(pages: DataFrame) -> DataFrame:
    """(host, tags, main, texts): the tag tokens of each host's template, those that name its main slots, and its texts."""
    seen = stored(distinct_pages(pages))
    found = stored(classes(seen))
    at = per_page(seen, found, ["tokens"], Classes, Classes.standing, "vector long, token long, place int, slot long, good boolean")
    order = at.groupBy("host", "vector", "token").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.every("good").alias("good"))
    valid = order.groupBy("host", "vector").agg(F.every(F.col("good") & (F.col("low") == F.col("high")) & (F.col("first") == F.col("last"))).alias("good"), F.collect_list("token").alias("tokens"))
    tags = valid.where(F.col("good") & (F.size("tokens") >= CLASS)).groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tags"))
    texts = F.transform(F.filter("tokens", lambda t: t["is_text"]), lambda t: t["token"])
    shape = stored(found.select("host", "pages", texts.alias("texts")).join(tags, "host", "left"))

    features = per_page(seen, shape, ["tags", "texts"], Slots, Slots.of, "slot long, chars long, inner long, away long")
    slots = features.groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("chars", "inner", "away")), F.sum((F.col("inner") > 0).cast("long")).alias("on"))
    whole = slots.groupBy("host").agg(F.max("on").alias("on"), F.collect_list(F.struct("slot", "chars", "inner", "away")).alias("slots"))
    left = lambda x: x["chars"] - x["away"]
    of_article, open_ = F.filter("slots", lambda x: 2 * x["inner"] > left(x)), F.filter("slots", lambda x: 2 * left(x) > x["chars"])
    main = F.when(F.col("on") >= SHARE * F.col("pages"), of_article).otherwise(open_)
    out = shape.where("tags is not null").join(whole, "host", "left").select("host", "tags", F.array_sort(F.transform(main, lambda x: x["slot"])).alias("main"), "texts")
    return out.unionByName(shape.where("tags is null").select("host", "tags", F.lit(None).cast("array<long>").alias("main"), "texts"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""

    def make():
        memo = Memo(Template)

        def run(batch: pa.RecordBatch) -> dict:
            rows = enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True))
            text = [main_text(body or "", memo.get(host, batch, k, ["tags", "main", "texts"])) for k, (host, body) in rows]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]}

        return run

    known = stored(templates(pages))
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).join(known, "host", "left")
    return map_batches(rows.select("page_id", "url", "html", "host", "tags", "main", "texts"), make, "page_id long, url string, text string, n_chars long")
