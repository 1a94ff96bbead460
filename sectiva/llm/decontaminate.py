"""Benchmark decontamination by spaced-seed hashing.

Both sides become token sequences.  A fixed mask reads some positions and ignores the others, so
a substituted token spoils only the seeds that read it.  Hashes of the benchmark are joined with
hashes of the documents; around every hit the benchmark item is laid along the same diagonal, and
the longest stretch that meets length and identity is taken.  The benchmark is read in blocks of
bounded size, each a pass over all documents.

The seeds miss no stretch of at least 13 tokens of which at most a fifth are substituted: with s
substitutions and no four equal tokens in a row it has at most 3 (s + 1) + s tokens and at least
5 s, so s is 3, the length 15 and every run 3 long, which the second mask reads.  A shorter item
is cut into one part more than it may have substitutions; one of the parts is left whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise, rows_kept, ship, shipped, small_batches

#: Fixed masks: 1 reads a token, 0 ignores it.
MASKS = ("1111", "1110111")
#: A verified stretch has at least this many tokens (or the whole of a shorter item) ...
MIN_TOKENS = 13
#: ... of which at least this share are equal.
MIN_IDENTITY = 0.8
#: Score of a substitution where an equal token scores 1: a stretch is equal enough if its sum isn't negative.
PENALTY = 4
#: Score of a position outside the document; no stretch can make up for it.
OUTSIDE = -(1 << 40)
#: Hits that are held at once, and positions that one block of diagonals compares.
BLOCK_CELLS = 1 << 20
#: Benchmark words that one pass holds; a larger benchmark takes more passes.
BLOCK_WORDS = 4_000_000
#: ASCII punctuation becomes a blank.
BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, ASCII punctuation blanked."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANKS).split()


def _seeds(masks=MASKS) -> list[np.ndarray]:
    return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in masks]


def _weights(n: int) -> np.ndarray:
    """Odd multipliers, one a position."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


class Index:
    """Seeds of a block of benchmark items, by hash."""

    def __init__(self, items: list[tuple], masks=MASKS):
        self.ids, self.vocab, self.seqs = [], {}, []
        for item_id, text in items:
            own = [self.vocab.setdefault(t, len(self.vocab) + 1) for t in tokens(text)]
            if own:
                self.ids.append(item_id)
                self.seqs.append(np.array(own, np.int64))
        self.sizes = np.array([len(s) for s in self.seqs], np.int64)
        self.words = np.concatenate([*self.seqs, np.zeros(0, np.int64)])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        short = sorted({len(s) for s in self.seqs if len(s) < MIN_TOKENS})
        parts = ((part, n) for n in short for part in np.array_split(np.arange(n), n // (PENALTY + 1) + 1))
        self.seeds = [*((x, len(m), False) for m, x in zip(masks, _seeds(masks), strict=True)), *((x, n, True) for x, n in parts)]
        self.weights = _weights(MIN_TOKENS)
        self.tables = []
        for pos, span, whole in self.seeds:
            h, item, at = [], [], []
            for k, s in enumerate(self.seqs):
                if len(s) == span if whole else len(s) >= MIN_TOKENS:
                    own = self.hashes(s, pos, span)
                    h.append(own), item.append(np.full(len(own), k)), at.append(np.arange(len(own)))
            h, item, at = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((h, np.uint64), (item, np.int64), (at, np.int64)))
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], item[order], at[order]))

    def hashes(self, ids: np.ndarray, pos: np.ndarray, span: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(ids) - span + 1) if at is None else at
        h = np.zeros(len(at), np.uint64)
        for p in pos:
            h += ids[at + p].view(np.uint64) * self.weights[p]
            h ^= h >> np.uint64(31)
        return h

    def hits(self, ids: np.ndarray):
        """(positions read, item, offset in the item, offset in ids), every seed that both hold."""
        for (pos, span, _), (table, item, at) in zip(self.seeds, self.tables, strict=True):
            if len(ids) < span or not len(table):
                continue
            read = np.ones(len(ids) - span + 1, bool)
            for p in pos:
                read &= ids[p : len(ids) - span + 1 + p] > 0
            where = np.flatnonzero(read)
            h = self.hashes(ids, pos, span, where)
            low, high = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            some = np.flatnonzero(high > low)
            block = np.cumsum((high - low)[some]) // BLOCK_CELLS
            for own in np.split(some, np.flatnonzero(np.diff(block)) + 1) if len(some) else ():
                n = (high - low)[own]
                k = np.repeat(low[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                yield pos, item[k], at[k], np.repeat(where[own], n)

    def verify(self, doc: np.ndarray, k: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """Longest stretch of item ``k`` laid on ``doc`` at ``diagonal`` that meets length and identity: (start in doc, in item, tokens, equal)."""
        s = self.seqs[k]
        lo, hi = max(0, -diagonal), min(len(s), len(doc) - diagonal)
        same = s[lo:hi] == doc[lo + diagonal : hi + diagonal]
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
        start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        sizes = np.arange(len(total)) - start
        if sizes.max() < min(MIN_TOKENS, len(s)):
            return None
        ends = np.flatnonzero(sizes == sizes.max())
        end = int(ends[np.argmax((total[ends] - total[start[ends]]))])
        start = int(start[end])
        return lo + diagonal + start, lo + start, end - start, int(same[start:end].sum())

    def worth(self, ids: np.ndarray, item: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which items laid at ``at`` in ``ids``, within ``low`` to ``high``, hold a stretch that meets length and identity."""
        keep = np.zeros(len(item), bool)
        order = np.argsort(self.sizes[item], kind="stable")
        sizes = self.sizes[item[order]]
        i = 0
        while i < len(order):
            j = int(np.searchsorted(sizes, sizes[i], "right"))
            j = min(j, i + max(1, BLOCK_CELLS // int(sizes[i])))
            own, n = order[i:j], np.arange(sizes[i])
            spot = at[own, None] + n
            inside = (spot >= low[own, None]) & (spot < high[own, None])
            same = ids[np.where(inside, spot, 0)] == self.words[self.first[item[own], None] + n]
            total = np.zeros((j - i, len(n) + 1), np.int64)
            np.cumsum(np.where(inside, np.where(same, 1, -PENALTY), OUTSIDE), axis=1, out=total[:, 1:])
            least = min(MIN_TOKENS, len(n))
            keep[own] = (total[:, least:] >= np.minimum.accumulate(total, axis=1)[:, :-least]).any(axis=1)
            i = j
        return keep

    def search(self, texts: list[str | None]):
        """(row, item id, stretch) of each text and item that overlap, the longest stretch of each."""
        get = self.vocab.get
        seqs = [np.fromiter(map(get, t, repeat(0)), np.int64, len(t)) for t in map(tokens, texts)]
        gap = np.zeros(MIN_TOKENS, np.int64)
        ids = np.concatenate([x for s in seqs for x in (s, gap)]) if seqs else gap
        starts = np.concatenate(([0], np.cumsum([len(s) + MIN_TOKENS for s in seqs]))).astype(np.int64)
        found: dict[tuple[int, int], tuple] = {}
        for pos, item, at, where in self.hits(ids):
            row, item, at = np.unique(np.stack((np.searchsorted(starts, where + pos[0], "right") - 1, item, where - at)), axis=1)
            keep = self.worth(ids, item, at, starts[row], starts[row + 1] - MIN_TOKENS)
            for r, k, x in zip(row[keep].tolist(), item[keep].tolist(), at[keep].tolist(), strict=True):
                got = self.verify(seqs[r], k, x - int(starts[r]))
                if got and got[2:] > found.get((r, k), (0, 0, 0, 0))[2:]:
                    found[r, k] = got
        for (r, k), got in sorted(found.items()):
            yield r, self.ids[k], got


def _search(batches, index):
    for batch in batches:
        got = list(index.search(batch.column(1).to_pylist()))
        rows = batch.column(0).take(pa.array([r for r, *_ in got], pa.int64()))
        cols = [pa.array([x[2][i] for x in got], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([rows, pa.array([x[1] for x in got], pa.int64()), *cols], names=["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_equal"])


def _indexes(benchmark: DataFrame, block_words: int):
    """(index that every task gets, whether it is the last), one for about ``block_words`` words; the one before is given up."""
    words = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    for k in range(n):
        index = ship(benchmark.sparkSession, Index([tuple(r) for r in benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]))
        yield index, k == n - 1
        if k < n - 1:
            index.destroy()


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_token, item_token, n_tokens, n_equal): each document and item that overlap.

    The longest verified stretch of each pair is given, once even where rows repeat.  Null or empty
    texts and items hold no seed; an item of fewer than 13 tokens matches only whole; rows
    with a null doc_id are left out, since a pair must name its document; other columns are
    ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id bigint, doc_token bigint, item_token bigint, n_tokens bigint, n_equal bigint"
    found = None
    for index, last in _indexes(items, block_words):
        part = rows.mapInArrow(lambda it, index=index: _search(it, shipped(index)), schema)
        if not last or found is not None:
            part = materialise(part, "overlaps")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_tokens", "n_equal", "doc_token", "item_token")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.doc_token", "b.item_token", "b.n_tokens", "b.n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows whose own text overlaps no benchmark item, whatever their id; null and empty texts stay."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null")
    for index, last in _indexes(items, block_words):

        def keep(index=index):
            own = shipped(index)

            def judge(texts):
                hit = {r for r, *_ in own.search(texts)}
                return [r not in hit for r in range(len(texts))]

            return judge

        docs = rows_kept(docs, text, keep)
        if not last:
            docs = materialise(docs, "uncontaminated")
    return docs
