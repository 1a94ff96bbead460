"""Substring, near-duplicate and line deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sectiva.llm import line_dedup, simhash, substring_dedup
from tests.llm.data import SCHEMA, documents, frame, sentence


def brute_substrings(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def overlapping(n=120):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(3000))
    shared = "".join(rng.choice("xyz ") for _ in range(160))
    rows = []
    for i in range(n):
        a = rng.randrange(2600)
        t = list(base[a : a + rng.randrange(400)] + (shared[rng.randrange(40) :] if rng.random() < 0.4 else ""))
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = "é"
        rows.append((i, "".join(t) if i % 17 else "ab" * 120, "en", "s", 1))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
        monkeypatch.setattr(substring_dedup, "HOT_ROWS", 5)
        monkeypatch.setattr(substring_dedup, "frequent_anchors", lambda rows, schema: [r.h for r in rows.mapInArrow(substring_dedup._anchor_rows, schema).filter("h is not null").groupBy("h").count().filter("count > 3").collect()])
    rows = [r for r in documents() if r[0] is not None] + [(1000 + r[0], *r[1:]) for r in overlapping()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == brute_substrings(rows)


def test_substrings_null_id_and_empty(spark):
    text = sentence(50)
    got = substring_dedup.substring_dedup(frame(spark, [(None, text, "en", "s", 1), (1, text, "en", "s", 1)])).collect()
    assert {(r.doc_id, r.n_removed > 0) for r in got} == {(None, False), (1, True)}
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(10):
        t = np.concatenate([np.append(rng.integers(0, 2, rng.integers(1, 40)), 256 + k) for k in range(4)]).astype(np.int64)
        values, sa = t.tolist(), substring_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: values[i:])
        lcp = substring_dedup.common_prefixes(t, sa)
        for i in range(1, len(t)):
            a, b = values[sa[i - 1] :], values[sa[i] :]
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(1)
    base = [sentence(40) for _ in range(30)]
    rows = documents() + [(100 + i, b, "en", "s", 1) for i, b in enumerate(base)] + [(200 + i, b[:-1] + rng.choice("abc"), "en", "s", 1) for i, b in enumerate(base)]
    fps = {}
    for r in rows:
        fps.setdefault(brute_fingerprint(r[1]), set()).add(r[0])
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in keys:
        least[find(k)] += [x for x in fps[k] if x is not None]
    want = Counter((r[0], f"{brute_fingerprint(r[1]):016x}", min(least[find(brute_fingerprint(r[1]))])) for r in rows)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect())
    assert got == want
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_dense_buckets(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    same = lambda x: np.equal.outer(x, x).tolist()
    assert same(simhash.bucket_labels(fps, list(range(64)))) == same(label)
    monkeypatch.setattr(simhash, "SPLIT", 8)
    assert same(simhash.bucket_labels(fps, list(range(64)))) == same(label)


@pytest.mark.parametrize("members", [4096, 6])
def test_near_duplicates_against_brute_force(spark, monkeypatch, members):
    """The pipeline's near-duplicate stage against every pair's Jaccard similarity of five-word shingles."""
    import corpus_pipeline
    from sectiva.llm import near_dup

    monkeypatch.setattr(near_dup, "MEMBERS", members)
    monkeypatch.setattr(near_dup, "SMALL", min(near_dup.SMALL, members))
    rng = random.Random(9)
    texts = [r[1] for r in documents() if r[0] is not None and r[0] != 5]
    for n in (8, 20, 60, 150):
        for _ in range(12):
            words = [f"w{rng.randrange(500)}" for _ in range(n)]
            texts.append(" ".join(words))
            for k in (0, 1, 2, 3):
                own = words[:]
                for i in rng.sample(range(n), k):
                    own[i] = "changed"
                texts.append(" ".join(own[rng.randrange(3) :]))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    near = 0
    for j in range(len(rows)):
        for i in range(j):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                near += sets[i] != sets[j]
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert near > 40
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, frame(spark, rows), "").collect()}
    assert got == set(label)


def test_lines(spark):
    rows = [(i, f"header\nbody {i}\n\nfooter" if i % 2 else f"body {i}", "en", "a", 1) for i in range(30)] + [(99, None, "en", "a", 0), (100, "header", "en", "b", 0), (101, "header\nheader", "en", None, 0), (102, "", "en", "a", 0)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(frame(spark, rows + rows[:1])).collect()}
    assert got[1] == (4, 2, "body 1\n") and got[2] == (1, 0, "body 2")
    assert got[99] == (0, 0, None) and got[100] == (1, 0, "header") and got[101] == (2, 0, "header\nheader") and got[102] == (1, 0, "")
    edge = [(i, "same\n" * 3000 if i < 5 else f"l{i}", "en", "a", 1) for i in range(500)]
    assert line_dedup.line_dedup(frame(spark, edge)).filter("n_dropped > 0").count() == 0
    assert {r.n_dropped for r in line_dedup.line_dedup(frame(spark, edge[:-1])).filter("doc_id < 5").collect()} == {3000}
    clash = frame(spark, edge[:-1]).withColumnsRenamed({"lang": "host", "n_chars": "drop"}).selectExpr("*", "1 AS row", "2 AS site", "3 AS kept", "4 AS _n_lines")
    got = line_dedup.drop_boilerplate(clash)
    assert got.columns == [*clash.columns[:-1], "_n_lines", "_n_dropped"] and got.filter("_n_dropped > 0").count() == 5
    # A small site's footer goes as well, whatever the number of its pages.
    small = [(i, f"page {i}\nfooter", "en", "tiny", 1) for i in range(5)]
    assert all(r.n_dropped == 1 for r in line_dedup.line_dedup(frame(spark, small)).collect())
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_url_host(spark):
    df = spark.createDataFrame([("https://A.example.com:80/x?y",), ("http://u@b.org",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(line_dedup.url_host(df.u)).collect()] == ["a.example.com", "b.org", None, None]


def test_extra_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    df = frame(spark).withColumns({"fp": F.lit(1), "h": F.lit(2), "tkey": F.lit(3), "root": F.lit(4)})
    assert simhash.simhash_groups(df).count() == substring_dedup.substring_dedup(df).count() == len(documents())
    assert SCHEMA.count(",") == 4


def test_bit_sliced_counters():
    from sectiva.llm import near_dup

    rng = np.random.default_rng(8)
    prints = rng.integers(0, 256, (70, near_dup.BITS // 8), dtype=np.uint8)
    prints[1::2] = prints[::2] ^ (rng.random((35, near_dup.BITS // 8)) < 0.5).astype(np.uint8)
    apart = np.unpackbits(prints[:, None] ^ prints[None], axis=2).sum(axis=2)
    for radius in (3, 14, 72, 128):
        for i in range(70):
            planes = near_dup._vertical(prints ^ prints[i])
            assert near_dup._unpacked(near_dup.within(planes, radius), 70).tolist() == (apart[i] <= radius).tolist()


def test_repeated_rows_leave_one(spark):
    """Rows that share an id but not a text are told apart; repeated rows leave one; a null id gives way to any other."""
    from sectiva.llm import near_dup

    a, b = sentence(40), sentence(40)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, a, "en", "s", 1), (None, "alone " + sentence(20), "en", "s", 1)]
    df = frame(spark, rows).withColumn("n", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = near_dup.keep_one_per_group(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, rows[-1][1]), (1, a), (1, b)])
    assert near_dup.keep_one_per_group(frame(spark, [])).count() == 0
