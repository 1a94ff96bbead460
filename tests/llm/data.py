"""Small documents with the cases every operator must handle, and brute-force helpers."""

import random

random.seed(4)
WORDS = "the of and to in haus wald über école niño river stone light market window garden paper music".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def documents():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows."""
    base = [sentence(60) for _ in range(12)]
    texts = [None, "", "   \n\t ", "word", "two words", base[0], base[0], base[0].replace("the", "THE"), base[1] + "\n" + base[2], base[2], base[3] + " tail", "x" * 400, "ab " * 300, sentence(6000), *base]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base[5], None, None, 3)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
