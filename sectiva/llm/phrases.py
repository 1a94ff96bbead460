"""Collocations: phrases of adjacent words, counted with position bitmaps and mined depth-first.

A shard is some documents' words laid out in slots, an empty slot between pieces.  Each frequent word
has a bitmap of its slots, compressed: packed 64-bit words where it is dense, sorted slots
where it is sparse.  A phrase's bitmap (of its last words) is shifted by one slot and
ANDed with the bitmaps of the words that may follow; popcounts are the counts of the longer phrases,
and those that any are left of are extended first (depth-first).  The empty slots stop a phrase at the end of
its piece.  A sparse bitmap is ANDed with all word bitmaps at once, by looking up which word holds each slot.

Counts of shards are added up.  What is worth extending is known from two passes before the one
that mines: words, then pairs and triples of frequent words, are counted by hash in a table of
counters over all documents, and counters that reach the threshold set bits in a filter of bounded size that is
broadcast.  Keys that share a counter let through more than needed, never less; the mined
counts themselves are of the phrases, so the result is exact.  Tasks send on the counters that they touched, in
blocks, as two bytes of place and one of count (a count of the threshold is enough).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectiva.llm._common import drop_stage, materialise, small_batches

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Slots of a shard, and bytes of a text that are split at a time; a single longer piece makes a longer shard.
SLOTS, CHUNK = 1 << 21, 1 << 22
#: Counted keys that a task holds before it sends them on.
HELD = 1 << 21
#: Words that a task remembers at most between shards.
MEMO = 400_000
#: Packed when at least one slot in so many is set: then a slot's bit costs less than a four-byte number.
DENSE = 32
#: Counters for words, and for pairs and for triples: a power of two near a quarter of the words, at least and at most; counters of a block.
WORD_COUNTERS, LEAST_COUNTERS, MOST_COUNTERS, BLOCK = 1 << 24, 1 << 18, 1 << 28, 1 << 16
#: Ranges that a language's candidates are ranked in before the last ranking.
SALTS = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(ord(".") if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTERS = "kind int, block bigint, places binary, counts binary"
MINED = "lang string, block int, phrases binary, counts binary"
#: Blocks that mined phrases are dealt to, a row each for a task and language: one for so many words of the corpus, at least and at most.
WORDS_A_BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 16, 1 << 16


# ---- shards ----


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``.`` (never a word) for each end of a piece."""
    return text.translate(TABLE).replace(b".", b" . ").split()


def chunks(text: bytes, size: int = CHUNK):
    """A long text cut at ends of pieces."""
    if len(text) <= size:
        yield text
        return
    text, start = text.translate(TABLE), 0
    while start < len(text):
        end = text.find(b".", start + size)
        end = len(text) if end < 0 else end + 1
        yield text[start:end]
        start = end


def parts(batches):
    """(lang, tokens) of the texts of a task's (lang, text) rows, long texts in parts; each ends with the end of a piece."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in chunks(text.as_buffer().to_pybytes()):
                found = tokens(part)
                found.append(b".")
                yield lang, found


class Words(dict):
    """Number of a word in a shard's language, -1 for words that the filter rejects and for ends of pieces."""

    def __init__(self, lang: str, keep: Filter):
        self.seed, self.keep = lang_seed(lang), keep
        self.words, self.hashes = [], []
        self[b"."] = -1

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = found = len(self.words) if self.keep.holds(h) else -1
        if found >= 0:
            self.words.append(word)
            self.hashes.append(h)
        return found

    def ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the phrases without the last word and of the last words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


# ---- counters ----


class Filter:
    """Which hashes have a counter that reached the threshold."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask, self.raw = bits, np.uint64(8 * len(bits) - 1), memoryview(bits)

    def holds(self, h: int) -> bool:
        at = h & int(self.mask)
        return bool(self.raw[at >> 3] >> (at & 7) & 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counter_rows(kind: int, h: np.ndarray, counters: int, most: int, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """The counters that hashes touch, a row for each block; a count beyond ``most`` is sent as ``most``."""
    at = h & np.uint64(counters - 1)
    if counts is None:
        at, n = np.unique(at, return_counts=True)
    else:
        at, back = np.unique(at, return_inverse=True)
        n = np.bincount(back, counts)
    n = np.minimum(n, most).astype(np.uint8)
    block = (at // np.uint64(BLOCK)).astype(np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    places = (at % np.uint64(BLOCK)).astype(np.uint16)
    cut = lambda x: pa.array([y.tobytes() for y in np.split(x, first[1:])] if len(first) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(block[first]), cut(places), cut(n)], names=["kind", "block", "places", "counts"])


def _reached(batches, least: int):
    """Bits of the counters that reach ``least``, from all rows of each block."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for kind, block, places, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            own = total.setdefault((kind, block), np.zeros(BLOCK, np.uint16))
            at = np.frombuffer(places.as_buffer(), np.uint16)
            own[at] = np.minimum(own[at] + np.frombuffer(counts.as_buffer(), np.uint8).astype(np.uint16), least)
    bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int64()), pa.array(bits, pa.binary())], names=["kind", "block", "bits"])


def filters(counted: DataFrame, counters: int, kinds: list[int], least: int) -> list[np.ndarray]:
    """The bits of a Filter for each kind of key; their size is that of the tables of counters, whatever was counted."""
    found = {k: np.zeros(max(counters, BLOCK) // 8, np.uint8) for k in kinds}
    parts = max(len(kinds), len(kinds) * counters // BLOCK // 16)
    for r in counted.repartition(parts, "kind", "block").mapInArrow(lambda it: _reached(it, least), "kind int, block bigint, bits binary").collect():
        found[r.kind][r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return [found[k][: counters // 8] for k in kinds]


# ---- bitmaps ----


class Layer:
    """Words by slot (-1: none) that may extend a phrase ending in the slot before, and packed bitmaps of the dense ones."""

    def __init__(self, words: np.ndarray):
        self.n, self.words = len(words), words
        dense = np.bincount(words[words >= 0], minlength=1) * DENSE >= max(self.n, 1)
        self.dense = {int(w): pack(np.flatnonzero(words == w), self.n) for w in np.flatnonzero(dense)}
        self.rest = pack(np.flatnonzero((words >= 0) & ~dense[words]), self.n) if self.dense else None


def pack(slots: np.ndarray, n: int) -> np.ndarray:
    """The bitmap of a shard's slots as 64-bit words."""
    flags = np.zeros((n + 63) // 64 * 64, bool)
    flags[slots] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def unpack(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def compressed(bits: np.ndarray, count: int, n: int) -> np.ndarray:
    return bits if count * DENSE >= n else unpack(bits)


class Bitmaps:
    """Bitmaps of a shard's words.

    ``ids`` has the word of each slot or -1, ``second`` and ``later`` the same where the word may be a phrase's second, or any later, word after what stands before it.
    """

    def __init__(self, ids: np.ndarray, second: np.ndarray, later: np.ndarray):
        self.n, self.ids = len(ids), ids
        self.layers = Layer(second), Layer(later)

    def firsts(self):
        """(word, bitmap) of the words that another may follow, at those slots."""
        begins = np.where(np.append(self.layers[0].words[1:] >= 0, False), self.ids, -1) if self.n else self.ids
        for w, slots in zip(*_grouped(begins), strict=True):
            yield w, pack(slots, self.n) if self.layers[0].dense and len(slots) * DENSE >= self.n else slots

    def extend(self, bitmap: np.ndarray, length: int):
        """(word, count, bitmap) of each word that follows a phrase of ``length`` words with that bitmap."""
        layer = self.layers[length > 1]
        if bitmap.dtype == np.uint64:
            moved = bitmap << np.uint64(1)
            moved[1:] |= bitmap[:-1] >> np.uint64(63)
            for w, own in layer.dense.items():
                both = moved & own
                if count := int(np.bitwise_count(both).sum()):
                    yield w, count, compressed(both, count, self.n)
            if layer.rest is not None:
                moved = moved & layer.rest
            moved = unpack(moved)
            moved = moved[moved < self.n]
        else:
            moved = bitmap + 1
            if len(moved) and moved[-1] >= self.n:
                moved = moved[:-1]
        held = layer.words[moved]
        if len(moved) == 1:
            if held[0] >= 0:
                yield int(held[0]), 1, moved
            return
        for w, own in zip(*_grouped(held, moved), strict=True):
            yield w, len(own), own


def _grouped(words: np.ndarray, slots: np.ndarray | None = None) -> tuple[list[int], list[np.ndarray]]:
    """Distinct words (not -1) and the sorted slots of each."""
    kept = np.flatnonzero(words >= 0)
    order = kept[np.argsort(words[kept], kind="stable")]
    if not len(order):
        return [], []
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    return words[order[first]].tolist(), np.split(order if slots is None else slots[order], first[1:])


def mined(maps: Bitmaps, most: int = MAX_WORDS):
    """(phrase as a tuple of word numbers, count) of every phrase of two or more words that the layers admit, depth-first."""
    for w, bitmap in maps.firsts():
        open_ = [((w,), bitmap)] if most > 1 else []
        while open_:
            phrase, bitmap = open_.pop()
            for x, n, longer in maps.extend(bitmap, len(phrase)):
                yield (*phrase, x), n
                if len(phrase) + 1 < most:
                    open_.append(((*phrase, x), longer))


# ---- passes over the documents ----


def _words(batches, most: int):
    """Counters of words; a row of kind 0 has the number of words in ``block``."""
    total, n = defaultdict(Counter), 0
    for k, (lang, found) in enumerate(parts(batches)):
        total[lang].update(found)
        n += len(found) - found.count(b".")
        if not k % 64 and sum(map(len, total.values())) > HELD:
            yield _word_rows(total, most)
            total = defaultdict(Counter)
    yield _word_rows(total, most)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([b""]), pa.array([b""])], names=["kind", "block", "places", "counts"])


def _word_rows(total, most: int) -> pa.RecordBatch:
    hashes, counts = [], []
    for lang, own in total.items():
        own.pop(b".", None)
        seed = lang_seed(lang)
        hashes += [xxhash.xxh64_intdigest(w, seed) for w in own]
        counts += own.values()
    return counter_rows(1, np.array(hashes, np.uint64), WORD_COUNTERS, most, np.array(counts, np.int64))


def shards(batches, keep: np.ndarray):
    """(lang, words, ids, number of words) for each shard, words numbered that pass the filter; the languages of a task share the size limit."""
    keep, known, held, size, n = Filter(keep), {}, defaultdict(list), 0, Counter()
    for lang, found in parts(batches):
        if lang not in known:
            known[lang] = Words(lang, keep)
        held[lang].append(known[lang].ids(found))
        n[lang] += len(found) - found.count(b".")
        size += len(found)
        if size >= SLOTS:
            yield from ((x, known[x], np.concatenate(ids), n[x]) for x, ids in held.items())
            held, size, n = defaultdict(list), 0, Counter()
            if sum(map(len, known.values())) > MEMO:
                known = {}
    yield from ((x, known[x], np.concatenate(ids), n[x]) for x, ids in held.items())


def runs(words: Words, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, hashes) of the last words and hashes of pairs, then of triples, of numbered words in adjacent slots."""
    own = np.array([*words.hashes, 0], np.uint64)[ids]
    at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
    pairs = joined(own[at - 1], own[at])
    longer = np.flatnonzero(np.diff(at) == 1)
    return [(at, pairs), (at[longer + 1], joined(pairs[longer], own[at[longer + 1]]))]


def _runs(batches, keep: np.ndarray, counters: int, most: int):
    """Counters of pairs (kind 2) and triples (kind 3) of words that pass the filter."""
    held, size = ([], []), 0
    for _, words, ids, _ in shards(batches, keep):
        for own, (_, hashes) in zip(held, runs(words, ids), strict=True):
            own.append(hashes)
            size += len(hashes)
        if size > HELD:
            yield from (counter_rows(2 + i, np.concatenate(x), counters, most) for i, x in enumerate(held))
            held, size = ([], []), 0
    yield from (counter_rows(2 + i, np.concatenate(x), counters, most) for i, x in enumerate(held) if x)


def _phrases(batches, keep: np.ndarray, pairs: np.ndarray, triples: np.ndarray, most: int, blocks: int):
    """Counts of words and of phrases whose adjacent pairs and triples all pass their filters; block -1 counts all words of a language."""
    filters, total, size = (Filter(pairs), Filter(triples)), defaultdict(Counter), 0
    for lang, words, ids, n in shards(batches, keep):
        layers = []
        for accepts, (at, hashes) in zip(filters, runs(words, ids), strict=True):
            layers.append(np.full(len(ids), -1, np.int32))
            at = at[accepts.has(hashes)]
            layers[-1][at] = ids[at]
        own, counts = words.words, total[lang]
        counts[None] += n
        each = np.bincount(ids[ids >= 0], minlength=1)
        for w in np.flatnonzero(each).tolist():
            counts[own[w]] += int(each[w])
        for phrase, c in mined(Bitmaps(ids, *layers), most):
            counts[b" ".join([own[x] for x in phrase])] += c
        if sum(map(len, total.values())) > HELD // 4:
            yield from _phrase_rows(total, blocks)
            total = defaultdict(Counter)
    yield from _phrase_rows(total, blocks)


def _phrase_rows(total, blocks: int):
    for lang, counts in total.items():
        dealt = defaultdict(list)
        for phrase, c in counts.items():
            dealt[-1 if phrase is None else zlib.crc32(phrase) % blocks].append((phrase or b"", c))
        rows = [(lang, block, b"\n".join(p for p, _ in own), np.array([c for _, c in own], np.int64).tobytes()) for block, own in dealt.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "block", "phrases", "counts"])


def _summed(batches, least: int):
    """(lang, phrase, f) of the phrases of each block that reach ``least``; a null phrase counts all words."""
    total = defaultdict(Counter)
    for b in batches:
        for lang, block, phrases, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            own = total[lang, block < 0]
            for phrase, c in zip(phrases.split(b"\n"), np.frombuffer(counts.as_buffer(), np.int64).tolist(), strict=True):
                own[phrase] += c
    for (lang, whole), own in total.items():
        kept = [(None if whole else p, c) for p, c in own.items() if whole or c >= least]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, most: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, f): exact counts of every word and phrase of up to ``most`` words that occurs ``min_count`` times; phrase null counts all words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    enough = min(min_count, 255)
    counted = materialise(rows.mapInArrow(lambda it: _words(it, enough), COUNTERS), "words")
    n = counted.filter("kind = 0").agg(F.sum("block")).first()[0] or 0
    (words,) = filters(counted.filter("kind = 1"), WORD_COUNTERS, [1], enough)
    drop_stage(counted)
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (n // 4).bit_length()))
    keep = spark.sparkContext.broadcast(words)
    pairs, triples = map(spark.sparkContext.broadcast, filters(rows.mapInArrow(lambda it: _runs(it, keep.value, counters, enough), COUNTERS), counters, [2, 3], enough))
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, n // WORDS_A_BLOCK))
    found = rows.mapInArrow(lambda it: _phrases(it, keep.value, pairs.value, triples.value, most, blocks), MINED)
    return materialise(found.repartition(blocks, "lang", "block").mapInArrow(lambda it: _summed(it, min_count), "lang string, phrase string, f bigint"), "phrases")


# ---- scores ----


def _part(words: str, start, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with the cut that scores lowest: (lang, phrase, a, l, r, n, score)."""
    n = counts.filter("phrase is null").select(F.col("lang").alias("lang_"), F.col("f").alias("n"))
    known = counts.filter("phrase is not null").withColumn("words", F.split("phrase", " "))
    whole = known.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", 1, F.col("k")).alias("left"), _part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda name, f: known.select(F.col("lang").alias(f"lang_{f}"), F.col("phrase").alias(f"{name}_"), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("left_")))
    cuts = cuts.join(part("right", "r"), (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("right_")))
    cuts = cuts.join(n, F.col("lang") == F.col("lang_"))
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x"))
    return best.select("lang", "phrase", "x.*")


def _covered(counts: DataFrame) -> DataFrame:
    """(lang_, inner, longest): the highest count of a longer candidate around each phrase."""
    longer = counts.filter("phrase is not null").withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    parts = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _part("words", i, m))))
    return longer.select(F.col("lang").alias("lang_"), F.explode(F.array_distinct(parts)).alias("inner"), "f").groupBy("lang_", "inner").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and text.

    Null texts are empty, null languages are ``und``; empty texts and empty pieces have no words; repeated
    rows count each; texts of any length are read whole; ties go by count, then by the phrase's bytes.  An empty
    table, or one in which no phrase is frequent, gives no rows.  Other columns are ignored.  A language's
    candidates are ranked in ranges first, so that its last ranking is of a bounded number of rows.
    """
    counts = phrase_counts(docs, text, lang, min_count, most)
    found = _scored(counts).join(_covered(counts), (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inner")), "left")
    kept = found.filter(F.coalesce(100 * F.col("around") < 100 * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "l", "r", "n", "score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(ws, i, i + m - 1) AS ws, m FROM w, range(1, {MAX_WORDS + 1}) AS q(m), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)),
f AS (SELECT lang, ws, m, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
k AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, i AS k, CAST((CAST(1000 AS HUGEINT) * c.f * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM f c, LATERAL (SELECT unnest(range(1, c.m)) AS i) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, i), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, i + 1, c.m), ' ') JOIN n ON n.lang = c.lang WHERE c.m > 1),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND len(q.phrase) > len(b.phrase) AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.f >= 100 * b.a))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM s QUALIFY rank <= {TOP}
"""
