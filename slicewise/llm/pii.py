"""Personal data: candidate generators and gradient boosted trees.

High-recall generators propose spans, which may overlap: e-mail addresses (also spelled out), IP addresses, card and phone
numbers with loose punctuation, identity numbers and secrets. Spans that obey a kind's strict form are always taken. The others are judged by boosted trees on their
format (lengths, digit groups, checksums, entropy) and the characters beside them; the naming words are kept from the trees.
These learn from at most `sample` candidates of the corpus: the naming words, the strict form and checksums teach, candidates
that none of these decides are left out, and each strict span is written in other ways that teach too (an e-mail spelled out, a
phone number without its country, a card with other punctuation, digits as an identity number, and wrong ones of each). A third
set, for each kind, the lowest threshold on the calibrated probability that gives the asked precision. A naming word counts as prior
odds of NAMED_ODDS, if the candidate is plausible beside it (no pronoun as local part, no date as a number). Candidates above the threshold are
added where no taken span lies over them; a secret may hold smaller ones (a run of its digits can be a card number).

Defined cases: null text is empty; a text is taken whole, in time that grows with its length; without candidates of both sorts only
plausible candidates beside a naming word are added; of candidates that lie over each other the likelier is taken, of equal ones
the first; rows that repeat get the same spans; an empty table gives no rows. Spans count code points, their end is exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, short_batches, smallest, stored

#: The order of kinds in lists of spans.
KINDS = ["email", "ip", "card", "phone", "secret", "identity"]
#: At most so many candidates teach the trees.
SAMPLE = 20_000

# Fixed forms of the strict kinds. A run of digits is entered at its start only, which finds the same leftmost matches.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Loose forms. A label of a domain has at most 63 characters, a local part 64.
SPELLED = re.compile(
    r"(?i)(?<=[A-Za-z0-9._%+-])(?:[\s\[(]++(?:at|@)[\s\])]++)(?:(?:[a-z0-9-]{1,63}+(?:[\s\[(]++dot[\s\])]++|[\[(]\.[\])]|\.))+|[a-z0-9-]{1,60}?dot)[a-z]{2,24}+(?![A-Za-z0-9-])"
)
DIGIT = re.compile("[0-9]")
#: Groups of digits that may belong together; every run of groups that looks like a kind is a candidate, so candidates overlap.
RUN = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9]++(?:[ ().-]{1,3}+[0-9]++)*+(?![A-Za-z])")
GROUP = re.compile("[0-9]+")
MOST_DIGITS, MOST_GROUPS = 19, 7  # of a card, the longest kind, and of a phone number, which has the most groups
SHAPES = [
    ("ip", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("card", re.compile(r"[0-9]{13,19}|(?:[0-9]{4}([ .-]{1,3})){3,4}[0-9]{1,4}|[0-9]{4}[ .-]{1,3}[0-9]{6}[ .-]{1,3}[0-9]{5}")),
    ("identity", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("phone", re.compile(r"(?:\+[0-9]{1,3}[ .-]{0,3})?\(?[0-9]{2,5}\)?(?:[ .-]{1,3}[0-9]{2,5}){1,5}|\+?[0-9]{9,15}")),
]
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])")
ASSIGNED = re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d|credential)s?[\"']?\s*[=:]\s*[\"']?$")
NAMED = {
    kind: re.compile(rf"(?i)\b(?:{words})\b(?:\W+(?:no|nr|num|number|address|is|was|me|us|at|on|to|under))*\W*$")
    for kind, words in {
        "email": "e-?mail|mail|contact|write|reach",
        "phone": "tel|telephone|phone|call|fax|mobile|cell|whatsapp",
        "identity": "ssn|social security|passport|identity|tax id|tin",
    }.items()
}
#: Characters before a candidate in which such words are looked for, and the odds that they add (as a logarithm).
BESIDE, NAMED_ODDS = 40, 4.0
#: What is no phone number: a date in front. What a spelled address needs: a mark in its local part or its dots or at spelled out.
DATED = re.compile(r"[+(]?(?:19|20)[0-9]{2}[ .-]+[01]?[0-9][ .-]+[0-3]?[0-9](?![0-9])|[+(]?[0-3]?[0-9][ .-]+[01]?[0-9][ .-]+(?:19|20)[0-9]{2}(?![0-9])")
MARKED = re.compile(r"(?i)^[a-z]*+[0-9._%+-]|[\s\])]dot[\s\[(]|[\[(]")
#: Forms that tell what a number may be.
IDENTITY = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
NATIONAL = re.compile(r"(?!(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]\b)\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}")
#: What may be drawn by lot: letters and digits in one alphabet of a key, without words put together.
RANDOM = re.compile(r"(?=[a-z]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[A-Za-z]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{16,}={0,2}")
COUNTRY = re.compile(r"\+[0-9]{1,3}(?:[ .-]+|(?=\())")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part @ domain: the local part of an @ is all that may belong to it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done, "email"
        else:
            done = max(done, start)
        at = text.find("@", max(done, at + 1))


def strict(text: str) -> list[Span]:
    """The spans that obey a strict form, by start, then kind."""
    out = list(emails(text))
    if not DIGIT.search(text):
        return ordered(out)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def numbers(text: str, start: int, groups: list[tuple[int, int]]) -> Iterator[Span]:
    """Candidates among digit groups that stand together: every run of them that has the look of a kind."""
    for i, (s, _) in enumerate(groups):
        while s > start and text[s - 1] in "+(":
            s -= 1
        digits, short = 0, 0
        for k in range(i, min(i + MOST_GROUPS, len(groups))):
            a, e = groups[k]
            digits += e - a
            short += k > i and e - a < 2
            if digits > MOST_DIGITS or short > 1 and k >= i + 4:  # only addresses of four groups have several of one digit
                break
            own = text[s:e]
            if (digits >= 9 and not (short > 1 and k != i + 3) or k == i + 3 and "." in own) and (kind := next((k for k, shape in SHAPES if shape.fullmatch(own) and (k != "phone" or 9 <= digits <= 15)), None)):
                yield s, e, kind


class Taken:
    """Spans by the stretches of text that they lie on."""

    WIDE = 64

    def __init__(self, spans: list[Span] = ()):
        self.on: dict[int, list[Span]] = {}
        for span in spans:
            self.add(span)

    def add(self, span: Span) -> None:
        for k in range(span[0] // self.WIDE, (span[1] - 1) // self.WIDE + 1):
            self.on.setdefault(k, []).append(span)

    def over(self, span: Span) -> Iterator[Span]:
        """The spans that lie over a part of this one; some come more than once."""
        s, e, _ = span
        for k in range(s // self.WIDE, (e - 1) // self.WIDE + 1):
            for own in self.on.get(k, ()):
                if own[0] < e and own[1] > s:
                    yield own


def proposed(text: str) -> list[Span]:
    """Candidates of loose form."""
    out = []
    for m in SPELLED.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        out.append((start, m.end(), "email"))
    if not DIGIT.search(text):
        return out
    for m in RUN.finditer(text):
        out += numbers(text, m.start(), [g.span() for g in GROUP.finditer(text, m.start(), m.end())])
    out += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text)]
    return out


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    s, left, right = text[span[0] : span[1]], text[max(0, span[0] - 1) : span[0]], text[span[1] : span[1] + 1]
    digits = [c for c in s if c.isdigit()]
    groups = [len(x) for x in re.findall("[0-9]+", s)] or [0]
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s).values()
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts) if s else 0.0
    return [
        len(s), len(digits), letters, len(digits) / max(len(s), 1), len(groups), max(groups), min(groups), entropy, len(counts) / max(len(s), 1),
        float(luhn("".join(digits))) if digits and all("0" <= c <= "9" for c in digits) else 0.0,
        float(max((int(x[:6]) for x in re.findall("[0-9]+", s)), default=0)), s.count("."), s.count("-") + s.count(" "), float("+" in s), float("@" in s), float("(" in s),
        float(all(c in "0123456789abcdef" for c in s)), float(bool(IDENTITY.fullmatch(s))), float(bool(NATIONAL.fullmatch(s))), float("[" in s), float("dot" in s.lower()),
        float(left.isalnum()), float(right.isalnum()), groups[0], groups[-1], KINDS.index(span[2]),
    ]


def named(text: str, span: Span) -> bool:
    """Whether the words before a candidate say what it is, and it may be that."""
    left, own = text[max(0, span[0] - BESIDE) : span[0]], text[span[0] : min(span[1], span[0] + 400)]
    if span[2] == "secret":
        return bool(ASSIGNED.search(left[-24:]))
    if span[2] == "email" and not MARKED.search(own) or span[2] == "phone" and DATED.match(own):
        return False
    return span[2] in NAMED and bool(NAMED[span[2]].search(left))


def teacher(text: str, span: Span, taken: Taken) -> bool | None:
    """Whether a candidate is of its kind; None where neither words, form nor checksum decide."""
    s, e, kind = span
    if named(text, span) or any(k == kind for _, _, k in taken.over(span)):
        return True
    if kind == "card":
        d = re.sub("[^0-9]", "", text[s:e])
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "email" or kind == "secret" and RANDOM.fullmatch(text[s:e]) or kind == "phone" and NATIONAL.fullmatch(text[s:e]) or kind == "identity" and IDENTITY.fullmatch(text[s:e]):
        return None
    return False


def rewritten(text: str, span: Span) -> Iterator[tuple[str, Span, bool]]:
    """Other ways to write a strict span, right and wrong ones: (text, candidate, whether it is of its kind)."""
    s, e, kind = span
    left, own, right = text[max(0, s - BESIDE) : s], text[s:e], text[e : e + 1]
    d = re.sub("[^0-9]", "", own)
    made: list[tuple[str, str, bool]] = []
    if kind == "email":
        local, domain = own.rsplit("@", 1)
        at, dot = [(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", ".")][crc32(own.encode()) % 3]
        made = [(local + at + domain.replace(".", dot), "email", True), ((re.findall("[A-Za-z]+", left) or ["look"])[-1] + " at " + domain, "email", False)]
    elif kind == "card":
        other = d[:-1] + str((int(d[-1]) + 1 + int(d[0]) % 9) % 10)
        made = [(".".join(x[k : k + 4] for k in range(0, len(x), 4)), "card", x == d) for x in (d, other)]
    elif kind == "phone":
        if m := COUNTRY.match(own):
            national = own[m.end() :]
            if sum(c.isdigit() for c in national) >= 9 and NATIONAL.fullmatch(national):
                made.append((national, "phone", True))
        made += [(f"{d[-9:-4]}-{d[-4:]}", "phone", False), (d[-10:], "phone", False), (f"20{d[-2:]}-0{int(d[-3]) % 9 + 1}-1{d[-4]} {d[-6:-4]}", "phone", False)]
        good = f"{int(d[-9]) % 5 + 1}{d[-8:-6]}-{int(d[-6]) % 9 + 1}{d[-5]}-{d[-4:-1]}{int(d[-1]) % 9 + 1}"
        made += [(good, "identity", True), (f"{['000', '666', '9' + good[1:3]][int(d[-1]) % 3]}{good[3:]}", "identity", False)]
    for x, k, y in made:
        yield left + x + right, (len(left), len(left) + len(x), k), y


class Trees:
    """Boosted regression trees on binned features for a yes or no, with a calibration and a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, held: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, precision: float = 0.97):
        """held: the rows that calibrate; the others grow the trees."""
        self.edges = [np.unique(np.quantile(x[~held, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self.binned(x)
        self.base, self.trees = float(np.log((y[~held].mean() + 1e-3) / (1 - y[~held].mean() + 1e-3))), []
        z = np.full(len(x), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self.grow(b[~held], (y - p)[~held], (p * (1 - p))[~held], depth)
            self.trees.append((tree, rate))
            z += rate * self.walk(tree, b)
        # calibration: a logistic curve over the held rows' scores
        self.a, self.c = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.a * z[held] + self.c, -30, 30)))
            self.a -= 0.02 * float(((p - y[held]) * z[held]).mean())
            self.c -= 0.2 * float((p - y[held]).mean())
        p = 1 / (1 + np.exp(-np.clip(self.a * z + self.c, -30, 30)))
        self.least = {}
        for k in range(len(KINDS)):
            own = held & (kind == k)
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= precision)
            if own.sum() >= 10 and len(good):
                self.least[k] = max(0.5, float(p[own][order][good[-1]]))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = float(g.sum() / (h.sum() + 1.0))
        best, cut = 1e-6, None
        if depth and len(b) >= 20:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for k in range(b.shape[1]):
                gs, hs = np.cumsum(np.bincount(b[:, k], g)), np.cumsum(np.bincount(b[:, k], h))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                if len(gain) > 1 and gain[:-1].max() > best:
                    best, cut = float(gain[:-1].max()), (k, int(gain[:-1].argmax()))
        if cut is None:
            return value
        low = b[:, cut[0]] <= cut[1]
        return (*cut, self.grow(b[low], g[low], h[low], depth - 1), self.grow(b[~low], g[~low], h[~low], depth - 1))

    def walk(self, tree, b: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(b), tree)
        out, low = np.empty(len(b)), b[:, tree[0]] <= tree[1]
        out[low], out[~low] = self.walk(tree[2], b[low]), self.walk(tree[3], b[~low])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z = self.base + sum(rate * self.walk(t, b) for t, rate in self.trees)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.c, -30, 30)))


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> Trees | None:
    """Trees from the `sample` distinct candidates of smallest hash; all texts are searched for candidates."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, of = [], [], []
            for t in batch.column(0).to_pylist():
                taken = strict(t) if t else []
                lying = Taken(taken)
                known = [(t, s, teacher(t, s, lying)) for s in proposed(t)] if t else []
                for at, s, good in (*known, *(r for s in taken for r in rewritten(t, s))):
                    if good is not None:
                        x.append(describe(at, s))
                        y.append(good)
                        of.append(at[s[0] : s[1]])
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y), pa.array(of)], names=["x", "y", "of"])

    found = docs.select(text).mapInArrow(run, "x array<double>, y boolean, of string")
    # copies of a candidate count once, and all that look alike are on one side of the calibration
    rows = smallest(stored(found.distinct().select(F.xxhash64("of").alias("h"), "x", "y")), F.col("h"), sample).collect()
    y = np.array([r.y for r in rows], float)
    if len(rows) < 30 or not 0 < y.sum() < len(y):
        return None
    x = np.array([r.x for r in rows])
    return Trees(x, y, x[:, -1].astype(int), np.array([r.h % 3 == 0 for r in rows]))


def spans_of(text: str, trees: Trees | None) -> tuple[list[Span], list[Span]]:
    """(strict spans, all spans)."""
    taken = strict(text)
    every, lying = list(taken), Taken(taken)
    if found := proposed(text):
        beside = np.array([named(text, s) for s in found])
        p = np.where(beside, 1.0, 0.0)
        least = np.full(len(found), 1.0)
        if trees:
            own = np.clip(trees.probability(np.array([describe(text, s) for s in found], float)), 1e-9, 1 - 1e-9)
            p = 1 / (1 + np.exp(-(np.log(own / (1 - own)) + NAMED_ODDS * beside)))
            least = np.array([trees.least.get(KINDS.index(kind), 0.5 if b else 2.0) for (_, _, kind), b in zip(found, beside, strict=True)])
        for k in np.argsort(-p, kind="stable"):
            s, e, kind = found[k]
            if p[k] >= least[k] and not any(not (kind == "secret" and s <= a and b <= e and b - a < e - s) for a, b, _ in lying.over(found[k])):
                every.append(found[k])
                lying.add(found[k])
    return taken, ordered(every)


def find(docs: DataFrame, trees: Trees | None, *, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with strict_spans and spans, arrays of (start, end, kind); redact puts [KIND] in the text for each stretch of spans.

    Columns of docs named strict_spans or spans are replaced.
    """
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("strict_spans", "spans")]
    kind = T.ArrayType(T.StructType.fromDDL("start int, end int, kind string"))
    schema = T.StructType([docs.schema[c] for c in kept if redact or c != text] + [T.StructField("strict_spans", kind), T.StructField("spans", kind)])
    names = [f.name for f in schema]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        for batch in batches:
            texts = batch[text].to_pylist()
            found = [spans_of(t or "", trees) for t in texts]
            made = {"strict_spans": pa.array([as_rows(a) for a, _ in found], arrow), "spans": pa.array([as_rows(b) for _, b in found], arrow)}
            if redact:
                made[text] = pa.array([None if t is None else hidden(t, b) for t, (_, b) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch[c] for c in names], names=names)

    return docs.select(*kept).mapInArrow(run, schema)


def hidden(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs with personal data replaced; n_chars, if there, follows the text."""
    free, back = aside(docs, ["strict_spans", "spans"])
    out = back(find(free, learn(docs, text=text, **options), text=text, redact=True))
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """The columns that op8 is held to."""
    count = lambda k: F.size(F.filter("strict_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(joined("strict_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: DuckDB: how many spans of each strict kind. Luhn: from the right, every second digit is doubled, less 9 above 9.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ips,
 list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[\x20-]', '', 'g'))) AS cards, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phones FROM d)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
 CAST(len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INT) ELSE 2 * CAST(x[i] AS INT) - CASE WHEN CAST(x[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
 CAST(len(list_filter(phones, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM m
"""
