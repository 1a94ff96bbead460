"""Rule-based quality verdicts as a short-circuit cascade of native expressions.

Some measures are reported of every text.  The rules, taken from published filters of web text,
read those or measures of their own.  ``plan_cascade`` estimates every rule's cost and rejection
on a sample and orders the rules by rejection per cost; the verdict is one CASE that stops at the
first rule that rejects, so a rejected text isn't measured for the rules behind it.  The order
decides time only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the characters counted as symbols.
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

WINDOW = 5
INDEX_BITS = 24
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(x, SPACES, "") != "")


def _covered(starts: Column) -> Column:
    """Positions covered by windows at the given ascending starts."""
    gaps = F.transform(starts, lambda x, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), (x - F.get(starts, j - 1)).cast("int"))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(x: Column, j: Column, s: Column, same: Callable[[Column, Column], Column]) -> Column:
    no = F.lit(False)
    return F.coalesce((j > 0) & same(x, F.get(s, j - 1)), no) | F.coalesce(same(x, F.get(s, j + 1)), no)


def n_repeat_words(w: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, from its array of words.

    Windows are sorted as longs, 40 bits of hash over 24 of position, and equal neighbours are
    compared word by word.  Where two different windows share a hash, or positions need more bits,
    the windows themselves are sorted instead.
    """
    low = (1 << INDEX_BITS) - 1
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - WINDOW)
    window = lambda w, i: F.slice(w, i.cast("int") + 1, WINDOW)
    pack = lambda w: F.sort_array(
        F.transform(starts(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    )
    at = lambda x: x.bitwiseAND(F.lit(low))
    hashed = lambda x, y: F.shiftrightunsigned(x, INDEX_BITS) == F.shiftrightunsigned(y, INDEX_BITS)

    def fast(w, s):
        clash = F.exists(F.transform(s, lambda x, j: F.coalesce(hashed(x, F.get(s, j + 1)) & (window(w, at(x)) != window(w, at(F.get(s, j + 1)))), F.lit(False))), lambda x: x)
        found = F.sort_array(F.transform(F.filter(s, lambda x, j: _repeated(x, j, s, hashed)), at))
        return F.when(~clash, let(found, _covered))

    def exact(w):
        rows = F.array_sort(F.transform(starts(w), lambda i: F.struct(window(w, i).alias("g"), i.cast("long").alias("i"))))
        found = let(rows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: _repeated(x, j, s, lambda p, q: p["g"] == q["g"])), lambda x: x["i"])))
        return let(found, _covered)

    return (
        F.when(F.size(w) <= WINDOW, F.lit(0).cast("long"))
        .when(F.size(w) >= low, exact(w))
        .otherwise(F.coalesce(let(pack(w), lambda s: fast(w, s)), exact(w)))
    )


@dataclass(frozen=True)
class Rule:
    """A named rejection: a condition on the reported measures, the words, the text and its worded lines under which a text fails."""

    name: str
    fails: Callable[[Column, Column, Column, Column], Column]


def _lines_share(pattern: str, percent: int, over: bool) -> Callable[[Column, Column, Column, Column], Column]:
    """Whether more (or fewer) than ``percent`` of the lines match a pattern."""

    def fails(m: Column, w: Column, t: Column, l: Column) -> Column:
        found = 100 * F.size(F.filter(l, lambda x: x.rlike(pattern)))
        return found > percent * m["n_lines"] if over else found < percent * m["n_lines"]

    return fails


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


# Line starts and ends, letters, and the thresholds of published filters.
BULLET, ELLIPSIS, ENDED = r"^[\x20\x09]*[-*•]", r"(\.\.\.|…)[\x20\x09\x0D]*\z", r"""[.!?…"'»”][\x20\x09\x0D]*\z"""
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BASE = (
    Rule("few_words", lambda m, w, t, l: m["n_words"] < 10),
    Rule("repeated_words", lambda m, w, t, l: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)
RULES = (
    Rule("symbols", lambda m, w, t, l: 5 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda m, w, t, l: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("duplicate_lines", lambda m, w, t, l: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("letterless_words", lambda m, w, t, l: 5 * F.size(F.filter(w, lambda x: ~x.rlike(LETTER))) > m["n_words"]),
    Rule("bullet_lines", _lines_share(BULLET, 90, over=True)),
    Rule("ellipsis_lines", _lines_share(ELLIPSIS, 30, over=True)),
    Rule("unended_lines", _lines_share(ENDED, 12, over=False)),
    Rule("capitals", lambda m, w, t, l: 10 * _removed(t, CAPITALS) > 3 * m["word_chars"]),
    Rule("exclamations", lambda m, w, t, l: 10 * _removed(t, "!?") > m["n_words"]),
    Rule("few_distinct_words", lambda m, w, t, l: 10 * F.size(F.array_distinct(w)) < m["n_words"]),
    Rule("endless_word", lambda m, w, t, l: F.exists(w, lambda x: F.length(x) > 1000)),
    Rule("filler", lambda m, w, t, l: t.rlike("(?i)lorem ipsum")),
)
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column, w: Column, lines: Column) -> Column:
    """The measures reported of every text."""
    repeated = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    found = {"n_words": F.size(w).cast("long"), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": repeated, "n_repeat_words": n_repeat_words(w), "n_lines": F.size(lines).cast("long")}
    return F.struct(*(c.alias(k) for k, c in found.items()))


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on ``sample_rows`` rows that pass the base; an empty table keeps the given order.

    Cost is the time that a rule takes on top of an empty pass, given what is measured anyway.
    """
    args = [F.col(x) for x in "mwtl"]
    some = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).limit(sample_rows)
    rows = docs.sparkSession.createDataFrame(some.collect(), some.schema).coalesce(1).withColumns({"w": words(args[2]), "l": worded_lines(args[2])})
    rows = rows.withColumn("m", measures(args[2], args[1], args[3])).persist()
    sample = rows.filter(~_any(BASE, *args))
    failed = sample.agg(*(F.sum(r.fails(*args).cast("int")).alias(str(k)) for k, r in enumerate(rules)), F.count("*").alias("all")).first()

    def took(result: Column) -> float:
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            sample.select(result).write.format("noop").mode("overwrite").save()
            ended = time.perf_counter()
        return ended - began

    empty = took(F.lit(True)) if failed["all"] else 0.0
    ranked = [(-failed[k] / max(took(rule.fails(*args)) - empty, 1e-4) if failed["all"] else 0.0, k, rule) for k, rule in enumerate(rules)]
    rows.unpersist()
    return [rule for *_, rule in sorted(ranked, key=lambda x: x[:2])]


def _any(rules, *args: Column) -> Column:
    return reduce(or_, (r.fails(*args) for r in rules), F.lit(False))


def cascade(order, *args: Column) -> Column:
    """The name of the first rule of ``order`` that rejects, else null; rules behind it aren't evaluated."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in order:
        case = case.when(rule.fails(*args), F.lit(rule.name))
    return case


def judged(text: Column, order) -> Column:
    """Struct of measures, ``base_failed`` and ``rejected_by``; the measures are taken once, rules of ``order`` only where the base holds."""

    def verdict(m: Column, w: Column, lines: Column) -> Column:
        args = (m, w, text, lines)
        failed = _any(BASE, *args)
        first = F.when(failed, cascade(BASE, *args)).otherwise(cascade(order, *args))
        return F.struct(*(m[k].alias(k) for k in (*SHOWN, "n_lines")), failed.alias("base_failed"), first.alias("rejected_by"))

    return let(words(text), lambda w: let(worded_lines(text), lambda lines: let(measures(text, w, lines), lambda m: verdict(m, w, lines))))


def first_failure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule, of the base or of the planned cascade, that rejects, else null."""
    found = judged(F.coalesce(F.col(text).cast("string"), F.lit("")), plan_cascade(docs, text, rules))
    return docs.withColumn("rejected_by", found["rejected_by"])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines), a row for each row.

    A null text counts as empty: all measures 0, base_failed.  Repeated rows are judged each for
    itself; null ids stay; other columns, of whatever name, are ignored; an empty table gives no
    rows.  Long texts are measured whole.
    """
    order = plan_cascade(docs, text, rules)
    rows = docs.select(F.col(doc_id).alias("doc_id"), judged(F.coalesce(F.col(text).cast("string"), F.lit("")), order).alias("m"))
    got = F.col("m")
    return rows.select("doc_id", *(got[k].alias(k) for k in SHOWN), got["base_failed"].alias("base_failed"), got["rejected_by"].isNull().alias("kept"), got["n_lines"].alias("n_lines"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
g AS (SELECT doc_id, i, CASE WHEN lead(x, 4) OVER v IS NOT NULL THEN
  concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) END AS g
  FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, text, w, l FROM a LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 5 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) > n_words
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 90 * n_lines
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*\z'))) > 30 * n_lines
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '[.!?…"''»”][\x20\x09\x0D]*\z'))) < 12 * n_lines
    OR 10 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * word_chars
    OR 10 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > n_words
    OR 10 * len(list_distinct(w)) < n_words OR len(list_filter(w, lambda x: length(x) > 1000)) > 0
    OR regexp_matches(text, '(?i)lorem ipsum')) AS kept, n_lines
FROM m
"""
