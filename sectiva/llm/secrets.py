"""Secret scans: candidate values by native expressions, false positives removed by a random forest.

Candidates are words that look assigned or random.  Features are the length, character classes and
the transitions between them, the share covered by dictionary words, the neighbouring words and
the path.  The forest (Spark's own, on the JVM) is trained on labelled findings that SQL writes
from hashes: known kinds of credentials against look-alikes such as checksums, mail addresses,
placeholders, dates and long words.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectiva.llm.quality_rules import let, words

MIN_CHARS = 12
TREES, DEPTH, SEED = 30, 7, 5
TRAIN_FINDINGS = 6000
THRESHOLD = 0.5

# Names of credentials, provider prefixes, words of look-alikes, a small dictionary.
KEY_NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
ASSIGNED = KEY_NAME + r"[\"']?[:=]+.+"
PROVIDER = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29\.|glpat-|npm_|eyJ)"
#: Texts without any of these hold no candidate.
PREFILTER = "[0-9]|" + PROVIDER.removeprefix("^") + "|" + KEY_NAME
HARMLESS = r"(?i)(md5|sha1|sha256|checksum|digest|commit|etag|uuid|guid|hash|isbn|example|placeholder|changeme|your|dummy|sample|xxxx|<|\$\{)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
DICTIONARY = (
    "the and tion ing ent that with from this have which user name file page index item value text word line data host mail order "
    "about access account change check client config default error login number report server service session system update version "
    "ung keit lich schaft ver ein und ment eau eux que pour dans ción mente ado para como los las est"
).split()

FEATURES = ("n", "digits", "uppers", "lowers", "others", "transitions", "variety", "hexes", "known", "provider", "assigned", "near", "harmless", "tested", "address", "numeric", "grouped")


def _share(value: Column, chars: str) -> Column:
    """Share of a value's characters outside the class ``chars`` removed by a pattern."""
    return 1 - F.length(F.regexp_replace(value, chars, "")) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, word: Column, left: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs for a candidate value, the word that holds it, the words before it and its path."""
    n = F.greatest(F.length(value), F.lit(1))
    classes = reduce(lambda v, x: F.regexp_replace(v, *x), (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "9"), ("[^a-zA-Z0-9]+", "-")), value)
    low = F.lower(value)
    known = reduce(add, (F.when(F.contains(low, F.lit(w)), F.lit(len(w))).otherwise(0) for w in DICTIONARY))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "n": F.length(value).cast("double"),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "lowers": _share(value, "[a-z]"),
        "others": _share(value, "[^A-Za-z0-9]"),
        "transitions": F.length(classes) / n,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hexes": flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        "known": F.least(known / n, F.lit(1.0)),
        "provider": flag(value.rlike(PROVIDER)),
        "assigned": flag(word.rlike(ASSIGNED)),
        "near": flag(left.rlike(KEY_NAME)),
        "harmless": flag(left.rlike(HARMLESS) | word.rlike(HARMLESS)),
        "tested": flag(path.rlike(TEST_PATH)),
        "address": flag(word.rlike("@|://|^www[.]")),
        "numeric": flag(value.rlike("^[0-9 .,:/_()+-]+$")),
        "grouped": flag(value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
    }


def value_of(word: Column) -> Column:
    """The value inside a word: after an assignment, without quotes and outer punctuation."""
    return F.regexp_replace(F.regexp_replace(word, "^[A-Za-z_-]{2,24}[\"']?[:=]+", ""), "^[\"'(\\[{<,;:]+|[\"')\\]}>,;:.!?]+$", "")


def _is_candidate(word: Column, before: Column, two_before: Column) -> Column:
    random = (F.length(word) >= MIN_CHARS) & word.rlike("[0-9]") & ~word.rlike("^[^A-Za-z0-9]*[0-9]+[^A-Za-z0-9]*$")
    named = before.rlike("[:=]$") & (before.rlike(KEY_NAME) | (before.rlike("^[:=]+$") & two_before.rlike(KEY_NAME)))
    return random | ((F.length(word) >= MIN_CHARS) & word.rlike(PROVIDER)) | ((F.length(word) > 7) & word.rlike("[:=]") & word.rlike(ASSIGNED)) | F.coalesce(named & (F.length(word) >= 6), F.lit(False))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, path, word_index, word, left): words that may hold a secret, with up to three words before them."""

    def found(w: Column) -> Column:
        rows = F.transform(w, lambda x, i: F.struct(i.cast("long").alias("word_index"), x.alias("word"), F.get(w, i - 1).alias("p1"), F.get(w, i - 2).alias("p2"), F.get(w, i - 3).alias("p3")))
        return F.filter(rows, lambda r: _is_candidate(r["word"], r["p1"], r["p2"]))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    hit = rows.filter(F.col("text").rlike(PREFILTER)).select("doc_id", "path", F.explode(let(words(F.col("text")), found)).alias("c"))
    return hit.select("doc_id", "path", "c.word_index", "c.word", F.concat_ws(" ", "c.p3", "c.p2", "c.p1").alias("left"))


def with_features(found: DataFrame) -> DataFrame:
    rows = found.withColumn("value", value_of(F.col("word")))
    return rows.withColumns(features(F.col("value"), F.col("word"), F.col("left"), F.col("path")))


def labelled_findings(spark: SparkSession, n: int = TRAIN_FINDINGS) -> DataFrame:
    """(word, left, path, label): findings written from hashes, half of them secrets."""
    i = F.col("id").cast("string")
    h = lambda salt: F.sha2(F.concat(i, F.lit(salt)), 256)
    upper = F.upper(F.translate(h("u"), "0189", "GKQX"))
    mixed = F.translate(F.base64(F.unhex(h("m"))), "+/=", "xYz")
    syllables = F.concat_ws("", *(F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.abs(F.xxhash64(i, F.lit(k))) % len(DICTIONARY) + 1).cast("int")) for k in range(5)))
    cut = (F.pmod(F.xxhash64(i, F.lit(9)), F.lit(24)) + 12).cast("int")
    pos = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), "in"), (F.concat(F.lit("password="), F.left(h("a"), cut)), "st"), (F.concat(F.lit('"'), F.left(h("b"), F.lit(40)), F.lit('"')), "token ="),
        (F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), "key"), (F.concat(F.lit("secret="), F.left(mixed, cut)), "and"), (F.left(mixed, cut), "api_key ="), (F.concat(F.lit("token:"), F.left(mixed, cut)), ""), (F.concat(F.left(mixed, F.lit(40))), "secret:"),
    ]
    neg = [
        (F.concat(F.left(syllables, F.lit(7)), F.lit(".42@mail"), F.substring(h("c"), 1, 1), F.lit(".example.com")), "to"), (F.concat(F.lit("https://www."), syllables, F.lit(".com/page?id="), F.left(F.translate(h("d"), "abcdef", ""), F.lit(6))), "see"),
        (F.left(h("e"), F.lit(40)), "commit"), (F.concat(syllables, F.lit("2")), "the"), (F.lit("2024-01-15T10:22:33Z"), "at"), (F.lit("password=changeme123"), "set"), (F.concat(F.lit("token=<your_"), syllables, F.lit(">")), "a"),
        (F.concat(F.left(F.translate(h("f"), "abcdef", ""), F.lit(4)), F.lit("-"), F.substring(F.translate(h("g"), "abcdef", ""), 1, 8)), "nr"), (F.left(h("k"), F.lit(32)), "md5"), (F.concat(syllables, F.lit("%%%")), "in"),
        (F.concat(F.left(h("n"), F.lit(8)), F.lit("-"), F.substring(h("o"), 1, 4), F.lit("-"), F.substring(h("p"), 1, 4), F.lit("-"), F.substring(h("q"), 1, 12)), "uuid"), (F.concat(F.lit("192.168."), F.left(F.translate(h("r"), "abcdef", ""), F.lit(2)), F.lit(".1:8080")), "host"),
    ]
    side, k = F.pmod(F.col("id"), F.lit(2)), F.floor(F.col("id") / 2)
    pick = lambda xs, j: F.element_at(F.array(*(F.struct(w.alias("word"), F.lit(left).alias("left")) for w, left in xs)), (k % len(xs) + 1).cast("int"))
    row = F.when(side == 1, pick(pos, 0)).otherwise(pick(neg, 1))
    rows = spark.range(n).select(row.alias("r"), side.cast("double").alias("label"), F.when(F.pmod(F.xxhash64(i), F.lit(10)) == 0, F.lit("tests/example.txt")).otherwise("src").alias("path"))
    return rows.select("r.word", "r.left", "path", "label")


def train_forest(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest on labelled findings (word, left, path, label); on the generated ones if none are given."""
    rows = with_features(labelled_findings(spark) if findings is None else findings)
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label").repartition(1)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(x)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, word_index, value, score, is_secret): every candidate of every document.

    ``word_index`` counts words from 0, ``score`` is the forest's probability, rounded to six
    places.  Null and empty texts have no candidate; a null path counts as no hint; repeated rows
    give their candidates again; null ids are kept; other columns are ignored.
    """
    forest = train_forest(docs.sparkSession)
    rows = with_features(candidates(docs, doc_id, text, path).withColumn("path", F.coalesce("path", F.lit(""))))
    scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "word_index", "value", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
