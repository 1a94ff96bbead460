"""Near-duplicate documents by SimHash at a similarity: five-word shingle sets with a Jaccard similarity of 0.8 or more.

At that similarity fingerprints differ in about 15 of 100 bits, too many for tables of equal
blocks.  So fingerprints of BITS bits are compared inside buckets that similar texts share: pairs
of minimum hashes of the shingle set.  Bit planes lie vertically, carry-save counters add many
distances at once, and a comparison is abandoned once every lane has passed the radius (the radius
is over five deviations from the mean distance at 0.8; a pair of that similarity has no common
bucket with a probability of 0.36 ** KEYS, 8e-8).  Links of a bucket only make families of
candidates: the members of a family are compared by their exact similarity.

Buckets and families send on an edge a member, to the first of its class, never all pairs.  A member is compared with all
others only until it is in the largest class, so dense groups cost little.  Large ones are dealt in
blocks, a task for each pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise, row_key, small_batches
from sectiva.llm._graph import connected_components
from sectiva.llm.simhash import gram_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and bits that may differ between candidates.
BITS, RADIUS = 256, 72
#: Buckets of a text, each keyed by two minimum hashes.
KEYS = 16
#: Members of a bucket or family, and elements of a family, that one task holds; more are dealt in blocks.
MEMBERS, ELEMENTS = 4096, 4_000_000
#: Buckets and families of at most so many members are compared many at once.
SMALL = 48
#: Shingles that are sketched at once.
CHUNK = 1 << 13
#: Guards bounds against rounding.
EPS = 1e-9
STEPS = np.random.default_rng(5).integers(1, 1 << 63, 2 * KEYS, dtype=np.uint64) | np.uint64(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a whole text, sorted; none without words."""
    return np.unique(gram_hashes(text, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29))


def sketch(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(keys of the buckets, fingerprint) of a shingle set; none and zero for an empty one."""
    if not len(own):
        return np.zeros(0, np.int64), bytes(BITS // 8)
    least, ones = np.full(2 * KEYS, ~np.uint64(0)), np.zeros(BITS, np.int64)
    for at in range(0, len(own), CHUNK):
        h = own[at : at + CHUNK]
        spread = h ^ (h >> np.uint64(32))
        least = np.minimum(least, (spread[None] * STEPS[:, None]).min(axis=1))
        streams = np.stack([_mixed(h + M1 * np.uint64(k)) for k in range(BITS // 64)], axis=1)
        ones += np.unpackbits(streams.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = _mixed(least[::2] * M1 + least[1::2]) ^ np.arange(KEYS, dtype=np.uint64)
    return keys.view(np.int64), np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def _node(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _sketches(batches, n):
    for batch in batches:
        sets = [shingle_set(t, n) for t in batch.column(2).to_pylist()]
        keys, prints = zip(*map(sketch, sets), strict=True) if sets else ((), ())
        cols = [pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "tkey", "node", "n", "keys", "fp"])


def _sets(batches, n):
    for batch in batches:
        sets = [shingle_set(t, n) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "own"])


def above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter exceeds ``radius``, as packed bytes."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 255)
    for k in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        c = counters[k] if k < len(counters) else np.zeros_like(more)
        if radius >> k & 1:
            equal &= c
        else:
            more |= equal & c
            equal &= ~c
    return more


def within(planes, radius: int = RADIUS) -> np.ndarray:
    """Lanes whose set bits over all planes (an even number of XOR planes, one bit a lane) number at most ``radius``, as packed bytes.

    Two planes at a time enter the lowest counter by carry-save addition, whose carry ripples on.
    """
    planes, counters = iter(planes), []
    for k, x in enumerate(planes):
        y = next(planes)
        if not counters:
            counters.append(np.zeros_like(x))
        ones = counters[0]
        carry = (ones & x) | (y & (ones ^ x))
        counters[0] = ones ^ x ^ y
        at = 1
        while carry.any():
            if at == len(counters):
                counters.append(np.zeros_like(x))
            counters[at], carry, at = counters[at] ^ carry, counters[at] & carry, at + 1
        if k % 16 == 15 and 2 * k > radius and (above(counters, radius) == 255).all():
            return np.zeros_like(x)
    return ~above(counters, radius)


def _vertical(prints: np.ndarray) -> np.ndarray:
    """Bit planes of rows of bytes, packed along the rows."""
    return np.ascontiguousarray(np.packbits(np.unpackbits(prints, axis=1, bitorder="little"), axis=0, bitorder="little").T)


def _unpacked(lanes: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(lanes, count=n, bitorder="little").astype(bool)


def classes(n: int, linked) -> list[tuple[int, int]]:
    """An edge from every member to the first of its class; ``linked(i)`` says which of ``n`` members are linked with member i.

    Every pair of members in different classes has been compared in the end: all outside the largest class were asked.
    """
    label, asked = np.arange(n), np.zeros(n, bool)
    while True:
        largest = np.bincount(label, minlength=n).argmax()
        open_ = np.flatnonzero(~asked & (label != largest))
        if not len(open_):
            least = np.unique(label, return_index=True, return_inverse=True)
            first = least[1][least[2]]
            return [(i, int(first[i])) for i in np.flatnonzero(first != np.arange(n)).tolist()]
        i = int(open_[0])
        asked[i] = True
        label[np.isin(label, label[linked(i)])] = label[i]


def _stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An edge from every member of the pairs to the least of its class."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def _sizes_fit(a, b, similarity):
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - EPS


def bucket_edges(prints: np.ndarray, n: np.ndarray, sizes: np.ndarray, similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (row, first row of its class) in consecutive buckets of the given sizes; links are within the radius and of possible sizes."""
    starts, out = np.cumsum(sizes) - sizes, []
    few = (sizes > 1) & (sizes <= SMALL)
    for size in np.unique(sizes[few]):
        p, q = np.triu_indices(size, 1)
        at = starts[few & (sizes == size)][:, None]
        left, right = (at + p).ravel(), (at + q).ravel()
        fit = _sizes_fit(n[left], n[right], similarity)
        left, right = left[fit], right[fit]
        for k in range(0, len(left), 1 << 15):
            i, j = left[k : k + (1 << 15)], right[k : k + (1 << 15)]
            near = _unpacked(within(_vertical(prints[i] ^ prints[j]), radius), len(i))
            out += zip(i[near].tolist(), j[near].tolist(), strict=True)
    out = _stars(out)
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own, planes, bits = n[s : s + m], _vertical(prints[s : s + m]), np.unpackbits(prints[s : s + m], axis=1, bitorder="little")

        def linked(i, own=own, planes=planes, bits=bits, m=m):
            lanes = within((x ^ np.uint8(255) if b else x for x, b in zip(planes, bits[i], strict=True)), radius)
            return _unpacked(lanes, m) & _sizes_fit(own, own[i], similarity)

        out += [(s + a, s + b) for a, b in classes(m, linked)]
    return out


def family_edges(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (member, first member of its class) of one family by the exact similarity of its sets."""
    n = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    mark = np.zeros(int(codes.max()) + 1, bool)

    def linked(i):
        own = codes[ends[i] - n[i] : ends[i]]
        mark[own] = True
        common = np.add.reduceat(mark[codes], ends - n, dtype=np.int64)
        mark[own] = False
        return common >= similarity * (n + n[i] - common) - EPS

    return classes(len(n), linked)


def _groups(batches, keys: int):
    """Tables of whole groups from rows sorted by their first ``keys`` columns: (table, sizes of its groups)."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not t.num_rows:
            continue
        cols = [t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if len(cut):
            yield t.slice(0, int(cut[-1])).combine_chunks(), np.diff(cut, prepend=0)
            held = t.slice(int(cut[-1]))
        else:
            held = t
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([held.num_rows])


def _edges(t: pa.Table, pairs) -> pa.RecordBatch:
    node = t.column("node").combine_chunks()
    a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([node.take(a), node.take(b)], names=["a", "b"])


def _bucket_links(batches, similarity):
    for t, sizes in _groups(batches, 2):
        prints = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        yield _edges(t, bucket_edges(prints, t.column("n").to_numpy(), sizes, similarity))


def _family_links(batches, similarity):
    for t, sizes in _groups(batches, 2):
        own, at, pairs = t.column("own").combine_chunks(), 0, []
        for m in sizes.tolist():
            if m > 1:
                sets = [own[at + k].values.to_numpy() for k in range(m)]
                pairs += [(at + a, at + b) for a, b in family_edges(sets, similarity)]
            at += m
        yield _edges(t, pairs)


def dealt(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """``rows`` with ``pair``: 0, or for keys in ``parts`` (key, parts) a copy for every pair of blocks that a row's block is in."""
    joined = rows.join(parts, key, "left")
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts").cast("int") - 1)
    pairs = F.transform(other, lambda x: F.least(x, block) * F.col("parts").cast("int") + F.greatest(x, block) + 1)
    return joined.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("parts")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tkey, component_id, first) for every row: the smallest doc_id reachable over pairs that are similar enough.

    ``tkey`` hashes id and text and ``first`` is the tkey of the group's first row: the one with the
    smallest doc_id, null last, then the smallest tkey.  Words are split at white space and
    lower-cased; a text of fewer words than a shingle is one shingle; texts that are null, empty or
    without words are copies of each other.  Texts with equal sets are one node.  Rows repeated in
    ``docs`` are returned as often; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("tkey"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    known = materialise(rows.mapInArrow(lambda it: _sketches(it, shingle), f"doc_id {kind}, tkey bigint, node binary, n int, keys array<bigint>, fp binary"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    nodes = materialise(known.groupBy("node").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    keyed = nodes.select(F.explode("keys").alias("k"), "n", "node", "fp")
    large = nodes.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") > MEMBERS)
    keyed = dealt(keyed, "k", large.select("k", F.ceil(F.col("m") / (MEMBERS // 2)).alias("parts")))
    keyed = keyed.select("k", "pair", "n", "node", "fp").repartition("k", "pair").sortWithinPartitions("k", "pair", "n", "node")
    family = materialise(connected_components(keyed.mapInArrow(lambda it: _bucket_links(it, similarity), "a binary, b binary")).join(nodes.select("node", "n", "least"), "node"), "families")
    large = family.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / ELEMENTS)).alias("m")).filter("m > 1")
    # Sets are rebuilt from one text of a node.
    reps = family.select(F.col("least.doc_id").alias("d"), F.col("least.tkey").alias("k")).distinct()
    some = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left_semi").select("text")
    sets = some.mapInArrow(lambda it: _sets(it, shingle), "node binary, own array<bigint>").dropDuplicates(["node"]).join(family.select("node", "root"), "node")
    sets = dealt(sets, "root", large.select("root", (2 * F.col("m")).alias("parts"))).select("root", "pair", "node", "own")
    edges = sets.repartition("root", "pair").sortWithinPartitions("root", "pair", "node").mapInArrow(lambda it: _family_links(it, similarity), "a binary, b binary")
    rooted = nodes.select("node", "least").join(connected_components(edges), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("least"))
    component = rooted.select("node", "root").join(smallest, "root").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.tkey").alias("first"))
    return known.select("doc_id", "tkey", "node").join(component, "node").select("doc_id", "tkey", "component_id", "first")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: that of the smallest doc_id, null last; of rows that share it, that of the smallest hash of the text.

    Rows that repeat id and text count as copies, of which one stays: the first by its columns as JSON.  Columns may have any name.
    """
    groups = materialise(near_duplicate_groups(docs, doc_id, text, shingle, similarity), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tkey") == F.col("first"))
    gone = groups.filter(~first).select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key")).distinct()
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(doc_id).alias("id"), row_key(doc_id, text).alias("key"))
    kept = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if groups.filter(first).groupBy("doc_id", "tkey").count().filter("count > 1").limit(1).count():
        kept = kept.groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")
