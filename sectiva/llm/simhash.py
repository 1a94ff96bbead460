"""Near-duplicate documents by SimHash fingerprints within a Hamming radius.

Fingerprints that differ in at most ``RADIUS`` = 2 of 64 bits agree on at least three of five
blocks, so ten tables of three-block keys hold every link.  Inside a bucket, XORed bit planes lie
vertically (one bit per compared fingerprint) and carry-save counters add them for all comparisons
at once; a block of comparisons is abandoned as soon as each of them has passed the radius.
Each bucket sends on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise, small_batches
from sectiva.llm._graph import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
#: Buckets over this many fingerprints are dealt again by the bits outside their key.
SPLIT = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _blocks(positions: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(positions), n)]


def _mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def table_masks() -> list[int]:
    """Ten masks: every choice of three of the five blocks."""
    edges = np.cumsum((0, *WIDTHS))
    blocks = [range(edges[i], edges[i + 1]) for i in range(len(WIDTHS))]
    return [_mask(b for i in keep for b in blocks[i]) for keep in combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS)]


def gram_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's word shingles in order; a text of fewer words is one, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8").astype("<u8")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words or a null one."""
    h = gram_hashes(text, n)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches, n):
    for batch in batches:
        fps = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def within(planes, radius: int = RADIUS) -> np.ndarray:
    """Lanes whose set bits over all planes number at most ``radius`` (at most 3), as packed bytes.

    ``planes`` yields XOR planes, one bit a lane.  Two bit-sliced counters and a sticky overflow
    are updated by carry-save addition, two planes at a time.
    """
    ones = twos = over = None
    planes = iter(planes)
    for k, x in enumerate(planes):
        y = next(planes)
        if ones is None:
            ones, twos, over = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
        low = ones ^ x ^ y
        carry = (ones & x) | (y & (ones ^ x))
        ones = low
        over |= twos & carry
        twos = twos ^ carry
        if k % 4 == 3 and (over == 255).all():
            return np.zeros_like(over)
    for bad in range(radius + 1, 4):
        over = over | (ones if bad & 1 else ~ones) & (twos if bad & 2 else ~twos)
    return ~over


def _vertical(x: np.ndarray) -> np.ndarray:
    """64 bit planes of the values, packed along the values."""
    return np.packbits(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, bitorder="little").T


def _flat_links(fps, left, right, radius):
    """Links among candidate pairs, in blocks of lanes."""
    for at in range(0, len(left), 1 << 16):
        i, j = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        near = np.unpackbits(within(np.ascontiguousarray(_vertical(fps[i] ^ fps[j])), radius), count=len(i), bitorder="little").astype(bool)
        yield i[near], j[near]


def _merge(label, i, near):
    labels = np.unique(label[near])
    if len(labels) > 1 or labels[0] != label[i]:
        labels = np.append(labels, label[i])
        label[np.isin(label, labels)] = labels.min()


def _dense(fps, radius):
    """Component labels among the fingerprints of one large bucket: its planes against each member."""
    planes, label = np.ascontiguousarray(_vertical(fps)), np.arange(len(fps))
    for i, fp in enumerate(fps):
        bits = (fp >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        near = np.flatnonzero(np.unpackbits(within((p ^ np.uint8(255) if b else p for p, b in zip(planes, bits, strict=True)), radius), count=len(fps), bitorder="little"))
        _merge(label, i, near)
    return label


def bucket_labels(fps: np.ndarray, free: list[int], radius: int = RADIUS) -> np.ndarray:
    """Component labels (indices) in a bucket of distinct fingerprints that may differ in ``free`` bits only.

    A large bucket is dealt again by thirds of the free bits, one of which a link leaves equal.
    """
    if len(fps) <= SPLIT or len(free) < 2 * (radius + 1):
        return _dense(fps, radius)
    label = np.arange(len(fps))
    for keep in _blocks(free, radius + 1):
        key = fps & np.uint64(_mask(keep))
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                own = bucket_labels(fps[part], [b for b in free if b not in keep], radius)
                for root in np.unique(own):
                    _merge(label, part[root], part[own == root])
    return label


def _edges(batches, masks, radius):
    """Rows (t, k, fp) sorted by bucket to tree edges; a bucket may span batches."""

    def solve(t, k, fps):
        fps = fps.view(np.uint64)
        cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
        sizes = ends - starts
        a, b = [], []
        small = (sizes > 1) & (sizes <= 64)
        for size in np.unique(sizes[small]):
            p, q = np.triu_indices(size, 1)
            at = starts[small & (sizes == size)][:, None]
            for i, j in _flat_links(fps, (at + p).ravel(), (at + q).ravel(), radius):
                a.append(fps[i]), b.append(fps[j])
        for s, e in zip(starts[sizes > 64], ends[sizes > 64], strict=True):
            own = fps[s:e]
            label = bucket_labels(own, [x for x in range(64) if not masks[t[s]] >> x & 1], radius)
            moved = label != np.arange(len(own))
            a.append(own[moved]), b.append(own[label[moved]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield solve(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield solve(*held)


def simhash_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed form of each whole text's fingerprint, one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, fp bigint")


def fingerprint_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``fp`` to (fp, root): linked ones share a root; unlinked ones are absent."""
    masks = table_masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed))))
    keyed = fps.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    edges = keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(lambda it: _edges(it, masks, radius), "a bigint, b bigint")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest doc_id reachable over
    links.  Texts that are null, empty or without words have fingerprint zero and link like any
    other; equal fingerprints are one node, so copies cost one comparison.  Rows repeated in
    ``docs`` are returned as often; a null doc_id is kept and never the smallest unless all are
    null.  Other columns of ``docs``, of whatever name, are ignored; an empty table gives no rows.
    """
    rows = materialise(simhash_fingerprints(docs, doc_id, text), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = fingerprint_components(nodes.select("fp"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
