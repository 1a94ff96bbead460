"""Boilerplate lines by site-relative frequency, in native expressions only.

Pages are grouped by host; a line's ratio is the number of the host's pages that contain it over
the number of the host's pages; lines above a ratio are dropped.  Lines are counted by their MD5 digest,
partial counts come before the shuffle, and what joins back is one short list of hashes a host:
no more than (lines a page) / ratio of them, however many pages the host has.  The lists are
written first, so that Spark knows their size: small ones are broadcast and texts are not
shuffled; larger ones are joined by a shuffle whose hot hosts can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.01
#: Lines on fewer pages of a host stay: they can't be told from copied documents.
MIN_COUNT = 5
SPACES = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def _blank(line: Column) -> Column:
    return F.translate(line, SPACES, "") == ""


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def line_counts(pages: DataFrame, host: Column, text: str) -> DataFrame:
    """(host, h, n): pages of a host that contain a line; h null counts the host's pages."""
    found = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key))
    marked = F.array_append(F.coalesce(found, F.array().cast("array<string>")), F.lit(None).cast("string"))
    return pages.select(host.alias("host"), F.explode(marked).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))


def boilerplate(pages: DataFrame, host: Column, text: str, ratio: float = RATIO, min_count: int = MIN_COUNT) -> DataFrame:
    """(host, drop): each host's list of the hashes of its boilerplate lines."""
    counts = line_counts(pages, host, text)
    totals = counts.filter("h is null").select(F.col("host").alias("site"), F.col("n").alias("pages"))
    over = counts.filter("h is not null").filter(F.col("n") >= min_count).join(totals, F.col("host").eqNullSafe(F.col("site")))
    return over.filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("h").alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = RATIO, min_count: int = MIN_COUNT, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``, plus two columns named by ``counts``: lines, and lines dropped.

    Blank lines are neither counted nor dropped; lines compare by every character.  A null text
    stays null with no lines; pages without a host form one host; repeated rows count as pages
    each; a line at exactly the ratio stays; a text all of whose lines go becomes empty; an empty
    table gives no rows.  Other columns may have any name but those of ``counts``, which are replaced; ``spare`` finds free ones.
    """
    key = F.col(host) if isinstance(host, str) else host
    names = [c for c in pages.columns if c not in counts]
    found = materialise(boilerplate(pages, key, text, ratio, min_count), "boilerplate")
    row = F.struct(*(F.col(c) for c in names))
    joined = pages.select(row.alias("row"), key.alias("site")).join(found, F.col("site").eqNullSafe(F.col("host")), "left")
    whole, lines = F.col("row").getField(text), _lines(F.col("row").getField(text))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), _key(x)) | _blank(x)))
    n = joined.select("row", F.coalesce(F.size(F.when(whole.isNotNull(), lines)), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"))
    n = n.withColumn("n_dropped", F.when(whole.isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    cleaned = F.when(F.col("n_dropped") == 0, whole).otherwise(F.array_join("kept", "\n"))
    return n.select(*((cleaned if c == text else F.col("row").getField(c)).alias(c) for c in names), F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]))


def spare(pages: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores after those that ``pages`` has, whatever their case."""
    taken, out = {c.lower() for c in pages.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return tuple(out)


def line_dedup(pages: DataFrame, doc_id: str = "doc_id", host: str | Column = "source", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every page, the text without its host's boilerplate."""
    key = F.col(host) if isinstance(host, str) else host
    rows = pages.select(F.col(doc_id).alias("doc_id"), key.alias("host"), F.col(text).cast("string").alias("text"))
    return drop_boilerplate(rows, "host", "text").select("doc_id", F.greatest("_n_lines", F.lit(0)).alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT source, x, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09\x0B-\x0D]') GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT source, x FROM n JOIN t USING (source) WHERE n >= 5 AND n > 0.01 * pages),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(b.x) AS n_dropped, string_agg(l.x, chr(10) ORDER BY i) FILTER (b.x IS NULL) AS kept
  FROM l LEFT JOIN b ON l.source = b.source AND l.x = b.x GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN k.n_dropped > 0 THEN coalesce(k.kept, '') ELSE d.text END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
