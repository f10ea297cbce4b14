"""Quality rules as a learned decision list, with DataFrame functions only.

Every text gets its statistics from built-in functions. From labelled rows' statistics, sequential covering learns rules that
recognise bad documents: a rule is grown as a conjunction of thresholds by information gain on one part of the rows, pruned on
the other part, kept if it is precise there, and the rows that it covers go before the next one is grown. The list becomes one
ordered conditional expression (CASE WHEN rule THEN its number ...), which Spark runs over all documents.

Rules are learned from at most `sample` labelled rows, those of smallest hash of doc_id; all else covers all rows.

Defined cases: a null or wordless text has zeros and fails the base rule; without labels of both kinds there are no rules and
the base rule alone decides; labels that are null are not used; very long texts are taken whole; of rules that cover a document the
first counts, repeated rows are judged alike; only doc_id and text are read of documents; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest, stored

SPACES = " \t\n\x0b\f\r"
#: At most so many labelled rows teach the rules.
SAMPLE = 20_000
#: Features of a rule: statistics relative to the text's size.
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "log_words"]


def count_of(t: Column, chars: str) -> Column:
    """How many characters of t are in chars."""
    return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")


def windows_of(words: Column, size: int = 8) -> Column:
    """The hash of each run of `size` words of an array column."""
    n = F.size(words) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def covered(windows: Column, ordered: Column, size: int = 8) -> Column:
    """Words covered by windows whose hash comes twice or more; ordered: windows as sorted (hash, place)."""
    last = F.size(ordered) - 1
    twice = F.filter(ordered, lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(ordered, i + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    step = lambda acc, i: F.struct((acc["n"] + size - F.greatest(acc["end"] - i, F.lit(0))).cast("long").alias("n"), (i + size).cast("int").alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def statistics(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, further counts), a row per document."""
    t = F.coalesce(F.col(text), F.lit(""))
    # most characters are small letters, which nothing counts: without them the counts are of a short text
    one = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.translate(t, "abcdefghijklmnopqrstuvwxyz", "").alias("s"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    two = one.select(
        "doc_id",
        F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), "").alias("words"),
        lines.alias("lines"),
        (F.length("t") - count_of(F.col("s"), SPACES)).cast("long").alias("word_chars"),
        count_of(F.col("s"), "#*$%&|<>").alias("n_symbols"),
        count_of(F.col("s"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count_of(F.col("s"), "0123456789").alias("n_digits"),
        count_of(F.col("s"), "!?").alias("n_marks"),
    )
    counts = ["word_chars", "n_symbols", "n_upper", "n_digits", "n_marks"]
    three = two.select(
        "doc_id",
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows_of(F.col("words")).alias("windows"),
    )
    # only texts in which some window repeats need their windows in order
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    four = three.withColumn("ordered", ordered)
    repeats = F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(covered(F.col("windows"), F.col("ordered"))).cast("long")
    return four.select("doc_id", "n_words", *counts, "n_distinct", "n_dup_lines", repeats.alias("n_repeat_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / chars,
        "distinct_share": F.col("n_distinct") / words,
        "log_words": F.log(words.cast("double")),
    }


Condition = tuple[int, str, float]


def holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, at in rule:
        out &= x[:, f] >= at if sign == ">=" else x[:, f] < at
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    """Adds the threshold of largest gain p * (log2 precision after - log2 precision before) until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and inside.any() and not bad[inside].all():
        before = math.log2(max(bad[inside].mean(), 1e-9))
        best: tuple[float, Condition | None] = (1e-9, None)
        for f in range(x.shape[1]):
            v = x[inside, f]
            for at in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1])):
                for sign in (">=", "<"):
                    has = v >= at if sign == ">=" else v < at
                    p, n = int((has & bad[inside]).sum()), int(has.sum())
                    if p and (gain := p * (math.log2(p / n) - before)) > best[0]:
                        best = (gain, (f, sign, float(at)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = holds(x, rule)
    return rule


def prune(x: np.ndarray, bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    """The beginning of the rule with the best (p - n) / (p + n) on other rows; the shortest of equals."""

    def worth(r: list[Condition]) -> float:
        has = holds(x, r)
        return (2 * bad[has].sum() - has.sum()) / max(has.sum(), 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def learn(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.97, support: int = 10, most_rules: int = 12, most_conditions: int = 4, cuts: int = 24) -> list[list[Condition]]:
    """Ordered rules for bad rows. Every third row prunes, the others grow."""
    rules: list[list[Condition]] = []
    part = np.arange(len(x)) % 3 == 0
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left & ~part].any():
        rule = prune(x[left & part], bad[left & part], grow(x[left & ~part], bad[left & ~part], most_conditions, cuts))
        has = holds(x, rule) & left if rule else np.zeros(len(x), bool)
        if has.sum() < support or bad[has].mean() < precision or (has & part).any() and bad[has & part].mean() < precision:
            break
        rules.append(rule)
        left &= ~has
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    f = features()
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for i, sign, at in rule:
            test = test & (f[FEATURES[i]] >= at if sign == ">=" else f[FEATURES[i]] < at)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each document with base_failed, rule (that rejects it, else null) and kept."""
    stats = stored(statistics(docs, text=text, doc_id=doc_id))
    known = labels.where(F.col("quality").isNotNull()).select(F.col(doc_id).alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    joined = stored(known.join(stats, "doc_id").select("doc_id", "bad", *(c.alias(n) for n, c in features().items())))
    seen = smallest(joined, F.xxhash64("doc_id"), sample).collect()  # `sample` rows at most
    bad = np.array([r["bad"] for r in seen], bool)
    rules = learn(np.array([[float(r[n]) for n in FEATURES] for r in seen]), bad) if 0 < bad.sum() < len(bad) else []
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


#: DuckDB: the statistics of the base rule.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
wi AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS x FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
tw AS (SELECT rid, i FROM wi JOIN (SELECT rid, x FROM wi GROUP BY rid, x HAVING count(*) > 1) USING (rid, x)),
rp AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM tw) GROUP BY rid),
q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN ln USING (rid) LEFT JOIN rp USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q
"""
