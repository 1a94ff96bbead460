"""Collocations against counting every phrase, and bitmaps against counting in a shard."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sectiva.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, f int"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [p for p in (re.findall(r"[^ \t]+", x) for x in re.split(r"[.,;:!?\n-\r]", low)) if p]


def brute(rows, min_count, top=2000, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in split(text):
            n[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, le, r, n[lang], s) for i, (s, a, p, le, r) in enumerate(found[:top])]
    return sorted(out)


def corpus(n=90, seed=2, words=14):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "a", "x-ray", "ñ", "AND", "İx", "é", "日本", "c d", "it's", "(so)", "z"][:words]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(vocabulary, weights)[0] + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "?! ", " .")) for _ in range(rng.randrange(80)))
        rows.append((text, rng.choice(("en", "en", "en", "de", "und", None))))
    rows += [("the of a the of a the of a", "en")] * 30 + [(None, "en"), ("", None), (" . ,\t", "de"), ("a " * 4000, "de"), ("word", "xx")]
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, la, "p", 1, 2) for i, (t, la) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.mark.parametrize("min_count", [4, 25])
def test_equals_brute_force(spark, min_count):
    rows = corpus()
    expected = brute(rows, min_count)
    assert expected and run(spark, rows, min_count=min_count) == expected


def test_top_is_by_score_count_and_bytes(spark):
    rows = corpus(60, 5)
    assert run(spark, rows, min_count=3, top=7) == brute(rows, 3, 7)


def test_small_shards_and_full_filters_change_nothing(spark, monkeypatch):
    """Shards of a few slots, counts sent on early, and filters that let everything through."""
    rows = corpus(50, 9)
    monkeypatch.setattr(phrases, "SLOTS", 64)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "WORDS_A_BLOCK", 20)
    monkeypatch.setattr(phrases, "MEMO", 5)
    monkeypatch.setattr(phrases, "WORD_COUNTERS", 8)
    monkeypatch.setattr(phrases, "LEAST_COUNTERS", 8)
    monkeypatch.setattr(phrases, "MOST_COUNTERS", 8)
    assert run(spark, rows, min_count=5) == brute(rows, 5)


def test_nothing_to_find(spark):
    assert run(spark, [], min_count=2) == []
    assert run(spark, [(None, None), ("", "en"), ("one two", "en")], min_count=2) == []


def test_mined_counts_of_a_shard():
    """Packed and sorted bitmaps, and both mixed, give the counts of all phrases within pieces."""
    rng = np.random.default_rng(4)
    packed = 0
    for n, words in ((1, 1), (64, 2), (1000, 3), (5000, 60), (3000, 400)):
        ids = np.where(rng.random(n) < 0.1, -1, (words * rng.random(n) ** 3).astype(int)).astype(np.int32)
        after = np.where(np.concatenate(([False], ids[:-1] >= 0)), ids, -1).astype(np.int32)
        maps = phrases.Bitmaps(ids, after, after)
        expected, at = Counter(), ids.tolist()
        for m in range(2, 6):
            expected.update(tuple(at[i : i + m]) for i in range(n - m + 1) if min(at[i : i + m]) >= 0)
        found = list(phrases.mined(maps, 5))
        assert dict(found) == expected and len(found) == len(expected)
        packed += sum(b.dtype == np.uint64 for _, b in maps.firsts())
    assert packed and maps.layers[0].rest is not None


def test_filters_admit_every_frequent_key(spark):
    rng = np.random.default_rng(1)
    often, rare = rng.integers(0, 1 << 63, 300, np.uint64), rng.integers(0, 1 << 63, 30_000, np.uint64)

    def counted(batches):
        for b in batches:
            for _ in range(b.num_rows):
                yield phrases.counter_rows(2, np.repeat(often, 3), 1 << 18, 9)
                yield phrases.counter_rows(3, rare, 1 << 18, 9, np.ones(len(rare), np.int64))

    rows = spark.range(0, 3, 1, 3).mapInArrow(counted, phrases.COUNTERS)
    two, three = map(phrases.Filter, phrases.filters(rows, 1 << 18, [2, 3], 9))
    assert two.has(often).all() and all(two.holds(int(h)) for h in often) and two.has(rare).mean() < 0.01
    assert three.has(rare).mean() < 0.05, "3 of 9 is not enough, but for counters that several keys share"


def test_long_texts_are_cut_at_ends_of_pieces():
    text = ("Word two. " * 3000).encode()
    parts = list(phrases.chunks(text, 100))
    assert len(parts) > 100 and b"".join(parts) == text.translate(phrases.TABLE)
    whole = b"a " * 500
    assert list(phrases.chunks(whole, 100)) == [whole]
