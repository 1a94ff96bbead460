"""Exact removal of repeated byte strings by suffix arrays.

A byte goes if some ``LENGTH``-byte string over it also starts earlier in the corpus.  Each window
of LENGTH bytes is assigned to one anchor, the least-hashed ``GRAM``-byte string inside it, so equal
windows share an anchor at the same place.  The windows of an anchor lie in one stretch of text,
its context.

1. Contexts that are equal as a whole, by a 128-bit BLAKE2 digest of their bytes, are settled by
   order alone: all but the first are repeats.  Batches settle their own first, so a frequent
   passage is sent once a batch at most.
2. The first context of each kind still may share windows with other contexts around the same
   anchor.  Those contexts, the edges of repeated passages, are dealt to shards by anchor; frequent
   anchors are dealt to several.  A shard sorts all suffixes of its contexts (Larsson-Sadakane
   refinement in numpy), takes common prefixes (Kasai's, in its form by irreducible positions) and
   reads repeated windows off runs of prefixes of LENGTH or more.
3. Where an anchor went to several shards, what a shard has found no earlier copy of is merged
   with the others by a search over how far a window reaches left of its anchor: a row for each
   stretch of windows, cut into ranges a quarter as wide (two steps of a binary search), is dealt by
   the bytes that all windows of its range share, and solved again.  Stretches that agree with no
   other are alone after a round; ranges end at single windows.  Rows are linear in contexts.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise, row_key, small_batches

LENGTH = 100
GRAM = 32
#: Bytes of contexts that one suffix array covers.
SHARD_BYTES = 2_000_000
#: Anchors over this share of the anchors of a sample of documents are dealt to several shards.
FREQUENT, SAMPLE, SALTS = 1 / 3000, 64, 64
#: Rows of one key in a round of the merge that go to one shard: so many, or this share of all.
HOT_ROWS, HOT_SHARE = 500, 1 / 10_000
#: Rows of a batch that a shard sends on.
SENT = 5000

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first window, last window, anchor offset in the context, anchor hash, both halves of the context's digest) of a text's anchors."""
    data, n = np.frombuffer(raw, np.uint8), len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    value = BYTES[data]
    g, width = value.copy(), 1
    while width < gram:
        g = g[:-width] * (M1 + np.uint64(2 * width)) + g[width:]
        width *= 2
    g = mix(g)
    least = (g >> np.uint64(32)).astype(np.uint32)
    at = np.arange(len(least), dtype=np.int32)
    span, want = 1, length - gram + 1
    while span < want:
        step = min(span, want - span)
        left, right = least[:-step], least[step:]
        take = right < left
        least, at, span = np.where(take, right, left), np.where(take, at[step:], at[:-step]), span + step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    p = at[first].astype(np.int64)
    digest = b"".join(hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True))
    low, high = np.frombuffer(digest, "<u8").reshape(-1, 2).T
    return first, last, p - first, g[p], low, high


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _pack(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return np.stack((lo, hi), axis=1).astype("<i4").tobytes()


ROW = "doc_id {0}, tkey bigint, lo int, hi int, off int, h bigint, c bigint, d bigint, packed binary"


def _anchor_rows(batches):
    """A row for each first context of a batch, and a row of packed window ranges for a text's repeats in it."""
    for batch in batches:
        order = pc.sort_indices(pa.table(batch), sort_keys=[("doc_id", "ascending"), ("tkey", "ascending")], null_placement="at_start").to_numpy()
        keys = batch.column(1).to_numpy()
        texts, ids = batch.column(2), batch.column(0)
        parts, before = [], None
        for i in order:
            now = (ids[int(i)].as_py(), keys[i])
            if now != before:
                found = anchors(_bytes(texts[int(i)].as_py()))
                parts.append((np.full(len(found[0]), i), *found))
            before = now
        row, lo, hi, off, h, c, d = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 7
        by = np.lexsort((np.arange(len(c)), d, c))
        new = np.concatenate(([True], (c[by][1:] != c[by][:-1]) | (d[by][1:] != d[by][:-1]))) if len(by) else np.zeros(0, bool)
        first = np.zeros(len(c), bool)
        first[by[new]] = True
        own = np.flatnonzero(first)
        again = np.flatnonzero(~first)
        cut = np.flatnonzero(np.diff(row[again])) + 1
        packs = [_pack(lo[x], hi[x]) for x in np.split(again, cut) if len(x)]
        heads = again[np.concatenate(([0], cut)).astype(int)] if len(again) else again
        at = pa.array(np.concatenate((row[own], row[heads])).astype(np.int64))
        none = pa.nulls(len(heads))
        ints = [pa.chunked_array([pa.array(x[own], pa.int32()), none.cast(pa.int32())]).combine_chunks() for x in (lo, hi, off)]
        longs = [pa.chunked_array([pa.array(x[own].view(np.int64)), none.cast(pa.int64())]).combine_chunks() for x in (h, c, d)]
        packed = pa.chunked_array([pa.nulls(len(own), pa.binary()), pa.array(packs, pa.binary())]).combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(at), batch.column(1).take(at), *ints, *longs, packed], names=["doc_id", "tkey", "lo", "hi", "off", "h", "c", "d", "packed"])


def _settle(batches, frequent):
    """Rows sorted by (h, c, d, document, place): ``state`` 1 for a repeat of a whole context, 2 for a first one to look into.

    The last context of a batch is held back, until it is known whether its anchor has another one;
    where that would hold back more than a batch, it is looked into at once.
    """
    frequent = np.array(sorted(frequent), np.int64)
    held = None
    last_h = last_c = last_d = last_doc = None
    was_shared = False

    def out(t, keep, state):
        t = t.append_column("state", pa.array(state, pa.int32())).filter(pa.array(keep))
        return t.select(["doc_id", "tkey", "lo", "hi", "off", "h", "state", "packed"]).combine_chunks().to_batches()

    def solve(t, more):
        nonlocal last_h, last_c, last_d, last_doc, was_shared
        through = pc.is_valid(t["packed"]).to_numpy(zero_copy_only=False)
        if through.all():
            return out(t, through, np.ones(len(through), np.int32))
        h, c, d = (t[x].combine_chunks().fill_null(0).to_numpy() for x in ("h", "c", "d"))
        new_h = np.concatenate(([last_h is None or h[0] != last_h], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([last_c is None or c[0] != last_c or d[0] != last_d], (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        first_of = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        keys = [t[x].combine_chunks() for x in ("doc_id", "tkey", "lo")]
        same = np.ones(len(h), bool)
        for x in keys:
            code = pc.dictionary_encode(x.fill_null(-1) if pa.types.is_integer(x.type) else x.fill_null("")).indices.to_numpy(zero_copy_only=False)
            same &= code == code[np.maximum(first_of, 0)]
        if first_of[0] < 0:
            own = np.flatnonzero(first_of < 0)
            same[own] = [tuple(x[int(i)].as_py() for x in keys) == last_doc for i in own]
        kinds = np.add.reduceat(new_c.astype(int), np.flatnonzero(new_h)) if new_h.any() else np.zeros(0, int)
        group = np.cumsum(new_h) - 1
        shared = np.where(group >= 0, kinds[np.maximum(group, 0)] > 1, was_shared) if len(kinds) else np.full(len(h), was_shared)
        if not new_h[0]:
            lead = group < 0
            shared[lead] = was_shared or bool(new_c[lead].any())
        if more is not None and more[0] == h[-1]:
            shared[h == h[-1]] = True
        if len(frequent):
            shared |= np.isin(h, frequent)
        # The first of each kind is looked into; equal rows of the same place are no repeats of it.
        state = np.where(same, 2, 1)
        state[through] = 1
        keep = through | (state == 1) | (shared & new_c)
        last = int(np.flatnonzero(~through)[-1])
        was_shared = bool(shared[last])
        last_h, last_c, last_d = h[last], c[last], d[last]
        if first_of[last] >= 0:
            last_doc = tuple(x[int(first_of[last])].as_py() for x in keys)
        return out(t, keep, state.astype(np.int32))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = pa.concat_tables([held, t]) if held is not None else t
        if t.num_rows == 1:
            held = t
            continue
        h, c, d = (t[x].combine_chunks().fill_null(0).to_numpy() for x in ("h", "c", "d"))
        change = np.flatnonzero(np.concatenate(([False], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]))))
        cut = int(change[-1]) if len(change) else t.num_rows - 1
        yield from solve(t.slice(0, cut).combine_chunks(), (h[cut], c[cut]))
        held = t.slice(cut).combine_chunks()
    if held is not None:
        yield from solve(held, None)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by Larsson-Sadakane refinement: groups of equal prefixes are sorted by
    the group of the suffix behind the prefix, whose length doubles; finished groups are left alone."""
    n = len(text)
    padded = np.concatenate((text + 1, np.zeros(2, np.int64)))
    key = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2 : n + 2]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    start = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    h = 3
    slots = np.flatnonzero(~(start & np.concatenate((start[1:], [True]))))
    while len(slots):
        own = sa[slots]
        pair = (rank[own] << 32) | (rank[np.minimum(own + h, n)] + 1)
        order = np.argsort(pair, kind="stable")
        sa[slots] = own = own[order]
        pair = pair[order]
        begins = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[own] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(slots)), 0))]
        slots = slots[~(begins & np.concatenate((begins[1:], [True])))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it.

    By text position i with predecessor phi(i), the value is that of i - 1 less one wherever the
    characters before both are equal (Kasai); elsewhere it is found by comparing, all at once.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    i = np.arange(n)
    fresh = (phi <= 0) | (i == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = text[rest - 1] != text[phi[rest] - 1]
    live = np.flatnonzero(fresh & (phi >= 0))
    at, length = live, np.zeros(n, np.int64)
    k = 0
    while len(at):
        a, b = at + k, phi[at] + k
        ok = (a < n) & (b < n)
        at = at[ok]
        at = at[text[a[ok]] == text[b[ok]]]
        k += 1
        length[at] = k
    reach = np.maximum.accumulate(np.where(fresh, length + i, -1))
    return np.maximum(reach - i, 0)[sa]


class Shard:
    """Contexts gathered for one suffix array."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, row):
        self.rows.append(row)
        self.bytes += len(row[4])

    def solve(self, length: int = LENGTH):
        """(row, place, whether it repeats) of every window of every context."""
        starts, text, at = [], [], 0
        for k, r in enumerate(self.rows):
            starts.append(at)
            text += [np.frombuffer(r[4], np.uint8).astype(np.int64), np.array([256 + k])]
            at += len(r[4]) + 1
        text, starts = np.concatenate(text), np.array(starts)
        sa = suffix_array(text)
        run_of = np.empty(len(text), np.int64)
        run_of[sa] = np.cumsum(common_prefixes(text, sa) < length)
        n = np.array([r[3] for r in self.rows])
        row = np.repeat(np.arange(len(n)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = run_of[starts[row] + window]
        rank = {}
        for r in sorted({(r[0] is not None, r[0], r[1]) for r in self.rows}, key=lambda x: (x[0], x[1] if x[0] else 0, x[2])):
            rank[r[1], r[2]] = len(rank)
        doc = np.array([rank[r[0], r[1]] for r in self.rows])[row]
        place = np.array([r[2] for r in self.rows])[row] + window
        order = np.lexsort((place, doc, run))
        new = np.concatenate(([True], np.diff(run[order]) != 0))
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = np.zeros(len(order), bool)
        again[order] = (doc[order] != doc[head]) | (place[order] != place[head])
        return row, place, again


LEVEL = "key bigint, salt int, doc_id {0}, tkey bigint, lo int, off int, n int, data binary"


def _contexts(batches, frequent):
    """Contexts with their bytes: windows ``lo`` to ``lo + n - 1`` of a document, their anchor ``off`` bytes from the first."""
    for batch in batches:
        out = []
        for doc, tkey, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = _bytes(text)
            for x in found:
                salt = zlib.crc32(f"{doc} {tkey} {x['lo']}".encode()) % SALTS if x["h"] in frequent else -1
                out.append((x["h"], salt, doc, tkey, x["lo"], x["off"], x["hi"] - x["lo"] + 1, data[x["lo"] : x["hi"] + LENGTH]))
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.int32(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "salt", "doc_id", "tkey", "lo", "off", "n", "data"])


def ranges_of(row, first: int, last: int, width: int):
    """Rows (key, lo, off, n, data) for the windows ``first`` to ``last`` of a row, one for each range of ``width``.

    A window that starts ``j`` bytes left of the anchor is in the range of ``j // width``; equal
    windows have an equal ``j``, and all windows of a range share the bytes that make its key.
    """
    _, _, lo, _, data, _, off = row
    at = lo + off
    while first <= last:
        low = (at - first) // width * width
        end = min(last, at - low)
        shared = data[at - low - lo : at - low - lo + LENGTH + 1 - width]
        key = int.from_bytes(hashlib.blake2b(shared + bytes([low]), digest_size=8).digest(), "little", signed=True)
        yield key, first, at - first, end - first + 1, data[first - lo : end - lo + LENGTH]
        first = end + 1


def _shards(batches, doc_type, width):
    """Contexts sorted by (key, salt): repeated windows as ranges (lo, hi); rows of the next round for what is left of keys in several shards."""

    def runs(row, place, chosen):
        at = np.flatnonzero(chosen)
        cut = np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(place[at]) != 1)) + 1
        for part in np.split(at, cut):
            if len(part):
                yield row[part[0]], int(place[part[0]]), int(place[part[-1]])

    def solve(shard, split):
        row, place, again = shard.solve()
        rows = shard.rows
        for k, a, b in runs(row, place, again):
            yield rows[k][0], rows[k][1], a, b, None, None, None, None
        if split:
            whole = np.array([r[5] in split for r in rows])
            for k, a, b in runs(row, place, ~again & whole[row]):
                for key, lo, off, n, data in ranges_of(rows[k], a, b, width):
                    yield rows[k][0], rows[k][1], lo, None, key, off, n, data

    def emitted(rows):
        """Batches of at most SENT rows: a shard may have a row for each window, and each holds LENGTH bytes."""
        while out := list(islice(rows, SENT)):
            yield emit(out)

    def emit(out):
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (doc_type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "tkey", "lo", "hi", "key", "off", "n", "data"])

    shard, split, current = Shard(), set(), None
    for batch in batches:
        for key, salt, doc, tkey, lo, off, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard.bytes >= SHARD_BYTES:
                whole = (key, salt) != current
                if not whole:
                    split.add(key)
                yield from emitted(solve(shard, split))
                shard, split = Shard(), set() if whole else {key}
            current = (key, salt)
            if salt >= 0:
                split.add(key)
            shard.add((doc, tkey, lo, n, data, key, off))
    if shard.rows:
        yield from emitted(solve(shard, split))


def merged(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, tkey, lo, hi): repeated windows of contexts (the columns of LEVEL), round by round.

    Each round deals rows by key, hot keys to as many shards as they need; a round without a key
    in several shards is the last.  The list of hot keys has at most 1 / HOT_SHARE entries.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"doc_id {kind}, tkey bigint, lo int, hi int, key bigint, off int, n int, data binary"
    found, width = None, LENGTH - GRAM + 1
    while True:
        width = -(-width // 4)
        dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
        solved = materialise(dealt.mapInArrow(lambda it, width=width: _shards(it, arrow, width), schema), "shards")
        marks = solved.filter("key is null").select("doc_id", "tkey", "lo", "hi")
        found = marks if found is None else found.unionByName(marks)
        left = solved.filter("key is not null").drop("hi")
        counts = left.groupBy("key").agg(F.count("*").alias("rows"))
        total = counts.agg(F.sum("rows")).first()[0] or 0
        if not total:
            return found
        many = max(HOT_ROWS, total * HOT_SHARE)
        hot = F.broadcast(counts.filter(F.col("rows") > many).select(F.col("key").alias("k"), F.ceil(F.col("rows") / many).alias("shards")))
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "tkey", "lo"), F.col("shards")).cast("int"), F.lit(-1))
        rows = left.join(hot, F.col("key") == F.col("k"), "left").withColumn("salt", salt).select("key", "salt", "doc_id", "tkey", "lo", "off", "n", "data")


def removed_runs(n: int, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under the given windows: (starts, ends)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi + length, n), -1)
    gone = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    step = np.diff(gone)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _results(batches):
    for batch in batches:
        out = []
        for text, ranges, packs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data = _bytes(text)
            parts = [np.array([(r["lo"], r["hi"]) for r in ranges or ()], np.int64).reshape(-1, 2)]
            parts += [np.frombuffer(p, "<i4").reshape(-1, 2).astype(np.int64) for p in packs or ()]
            both = np.concatenate(parts)
            if len(both):
                starts, ends = removed_runs(len(data), both[:, 0], both[:, 1])
            else:
                starts = ends = np.zeros(0, np.int64)
            kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)]
            out.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept, spans))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tkey, text): ``tkey`` tells rows apart that share an id, and is 0 where none do."""
    shared = docs.groupBy(F.col(doc_id).alias("k")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    key = row_key(doc_id, text) if shared else F.lit(0).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), key.alias("tkey"), F.col(text).cast("string").alias("text"))


def frequent_anchors(rows: DataFrame, schema: str) -> list[int]:
    """Anchors of a sample of documents above a share of all its anchors: at most 1 / FREQUENT of them.

    It only decides how rows are dealt to tasks, never what is found.
    """
    some = rows.filter(F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(SAMPLE)) == 0).mapInArrow(_anchor_rows, schema).filter("h is not null")
    counts = some.groupBy("h").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.h for r in counts.filter(F.col("n") > max(20.0, FREQUENT * total)).collect()]


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, tkey, lo, hi, packed) from (doc_id, tkey, text): ranges of the starts of repeated windows, or such ranges packed."""
    kind = dict(rows.dtypes)["doc_id"]
    frequent = set(frequent_anchors(rows, ROW.format(kind)))
    dealt = F.col("h")
    if frequent:
        dealt = F.when(F.col("h").isin(*frequent), F.col("c")).otherwise(F.col("h"))
    dealt = F.coalesce(dealt, F.xxhash64("doc_id", "tkey"))
    found = rows.mapInArrow(_anchor_rows, ROW.format(kind))
    found = found.repartition(dealt).sortWithinPartitions("h", "c", "d", "doc_id", "tkey", "lo")
    settled = materialise(found.mapInArrow(lambda it: _settle(it, frequent), f"doc_id {kind}, tkey bigint, lo int, hi int, off int, h bigint, state int, packed binary"), "settled")
    open_ = settled.filter("state = 2").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("h", "lo", "hi", "off")).alias("found"))
    joined = rows.join(open_.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "found"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")))
    context = joined.select("doc_id", "tkey", "text", "found").mapInArrow(lambda it: _contexts(it, frequent), LEVEL.format(kind))
    whole = settled.filter("state = 1").select("doc_id", "tkey", "lo", "hi", "packed")
    return whole.unionByName(merged(context, kind).withColumn("packed", F.lit(None).cast("binary")))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for every row.

    ``kept`` are the remaining bytes, ``spans`` the removed runs.  Null texts count as empty.  A
    null doc_id comes before all others; rows that share a doc_id are ordered by a hash of id and
    text, and rows that repeat both are one document, each with its result.  Other columns are
    ignored; an empty table gives no rows.  doc_id may be int, bigint or string.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, doc_id, text)
    marks = repeated_windows(rows)
    per_doc = marks.groupBy("doc_id", "tkey").agg(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))).alias("ranges"), F.collect_list("packed").alias("packs"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "ranges", "packs")
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left").select("doc_id", "text", "ranges", "packs")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(_results, schema)
