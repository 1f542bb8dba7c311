"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints of 64 bits link at MAX_BITS or fewer differing bits. The index is a forest over distinct fingerprints in Gray
order, which puts long shared bit patterns next to each other: leaves of LEAF consecutive fingerprints, FAN children to a
node, and in each node the bits that all its members share (mask and pattern). The self-join walks pairs of nodes from the
roots; at each level the differences in bits that both nodes have come to fix are added to what the levels above have
found, and whole groups beyond the limit are pruned. Pairs of groups that already belong to one component are skipped: a
tree yields a spanning forest of its links, never all pairs, and loses no connection.

Trees are dealt to tasks by segments of about SEGMENT fingerprints: two that differ in at most 3 bits agree in one of 4
blocks of 16 bits, so each goes to 4 segments, one for each block's low bits, as many as the count asks for. A segment
that many similar fingerprints make larger than CROWDED is dealt again, first by its block's other bits, then by 4 blocks
of the bits that are still free, and so on. No member is left out, and after the last deal a segment has 2**21 members at
most, because no more bits are free.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any other; rows with
equal texts share one fingerprint; null doc_ids never name a component unless it has no other member; an empty table
gives an empty result; other columns are ignored by near_duplicates and kept by keep_one, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolith.llm.common import free_name
from octolith.llm.components import components
from octolith.llm.units import text_slices
from octolith.session import materialize, release

MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: Members of a leaf, children of a node.
LEAF, FAN = 4, 4
#: Members of a segment that dealing aims at, and beyond which a segment is dealt again.
SEGMENT, CROWDED = 1 << 12, 1 << 16
#: Shingles hashed at once, pairs of nodes looked at together, members of trees built together.
BLOCK, PAIRS, TOGETHER = 1 << 18, 1 << 14, 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, gap + 1], np.r_[gap, len(joined)]
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, ones = len(starts), np.zeros(64, np.int64)
    for a in range(0, n, BLOCK):
        h = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a : a + BLOCK].tolist(), ends[a : a + BLOCK].tolist(), strict=True)]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a BIGINT)."""

    def run(batches):
        for batch in batches:
            for first, piece in text_slices(batch.column("text")):
                fps = np.array([fingerprint(t, shingle) for t in piece.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(piece)), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """All rows with all columns and the fingerprint under a name."""

    def run(batches):
        for batch in batches:
            for first, piece in text_slices(batch.column("text").cast(pa.string())):
                fps = np.array([fingerprint(t, shingle) for t in piece.to_pylist()], np.uint64).view(np.int64)
                own = batch.slice(first, len(piece))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(fps)], names=[*own.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, shifted so that signed order is the order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give members that links (a, b) connect one label, their least; in place."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (up := parent[parent]) is not None and (up != parent).any():
            parent = up
        labels[:] = parent[labels]


class GrayIndex:
    """A tree for each segment of fingerprints in Gray order. f: ordered by segment and Gray rank; seg: each one's segment."""

    def __init__(self, f: np.ndarray, seg: np.ndarray | None = None):
        self.f = f
        self.pruned = self.compared = 0  # pairs of nodes cut by their differences, pairs of members looked at
        seg = np.zeros(len(f), np.int64) if seg is None else seg
        begin = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(f) else np.empty(0, np.int64)
        tree = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(f)]))
        some, every, size, self.levels = f, f, LEAF, []
        while True:
            # Nodes are runs of `size` entries of the level below, and none reaches into another tree.
            own = np.arange(len(tree)) - np.searchsorted(tree, tree)
            first = np.flatnonzero(own % size == 0)
            some, every = np.bitwise_or.reduceat(some, first), np.bitwise_and.reduceat(every, first)
            below = np.diff(np.r_[first, len(tree)])
            member = first if not self.levels else self.levels[-1]["member"][first]
            self.levels.append({"first": first, "count": below, "mask": ~(some ^ every), "pattern": every, "member": member})
            tree, size = tree[first], FAN
            if len(tree) == len(begin):
                break

    def uniform(self, level: int, labels: np.ndarray) -> np.ndarray:
        """The label that all members of a node have, or -1 less its number."""
        first = self.levels[level]["member"]
        low, high = np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)
        return np.where(low == high, low, -1 - np.arange(len(first)))

    def join(self) -> np.ndarray:
        """Labels of the components under links within MAX_BITS."""
        labels, top = np.arange(len(self.f)), len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["first"]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
        while stack:
            level, a, b, found, seen = stack.pop()
            if len(a) > PAIRS:
                stack += [(level, *(x[k : k + PAIRS] for x in (a, b, found, seen))) for k in range(0, len(a), PAIRS)][::-1]
                continue
            node = self.levels[level]
            both = node["mask"][a] & node["mask"][b]
            found = found + np.bitwise_count((node["pattern"][a] ^ node["pattern"][b]) & both & ~seen)
            near, own = found <= MAX_BITS, self.uniform(level, labels)
            self.pruned += int((~near).sum())
            live = near & (own[a] != own[b]) | (a == b) & (own[a] < 0)
            a, b, found, seen = a[live], b[live], found[live], both[live]
            if not len(a):
                continue
            if level:
                i, j = np.divmod(np.arange(FAN * FAN), FAN)
                x, y = node["first"][a][:, None] + i, node["first"][b][:, None] + j
                ok = (i < node["count"][a][:, None]) & (j < node["count"][b][:, None]) & (x <= y)
                at = np.nonzero(ok)[0]
                stack.append((level - 1, x[ok], y[ok], found[at], seen[at]))
            else:
                self.leaves(a, b, labels)
        return labels

    def leaves(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> None:
        first, count = self.levels[0]["first"], self.levels[0]["count"]
        i, j = np.divmod(np.arange(LEAF * LEAF), LEAF)
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            ok = (i < count[x][:, None]) & (j < count[y][:, None]) & ((x != y)[:, None] | (i < j))
            u, v = (first[x][:, None] + i)[ok], (first[y][:, None] + j)[ok]
            self.compared += len(u)
            hit = np.bitwise_count(self.f[u] ^ self.f[v]) <= MAX_BITS
            if hit.any():
                unite(labels, u[hit], v[hit])


def segment_links(f: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (member, representative) of whole segments; rows are ordered by segment and Gray rank."""
    labels = GrayIndex(f, seg).join()
    at = np.flatnonzero(labels != np.arange(len(f)))
    return f[at], f[labels[at]]


def without(free: Column, offset: int, width: int) -> Column:
    """The bits left when `width` bits at `offset` are taken out."""
    return free.bitwiseAND(F.lit((1 << offset) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(free, offset + width), offset) if offset + width < 64 else F.lit(0).cast("bigint"))


def deal(rows: DataFrame, bits_left: int) -> DataFrame:
    """rows (fp, seg, free) dealt by 4 blocks of their free bits; two that differ in 3 of these at most agree in a block."""
    edges = [bits_left * k // 4 for k in range(5)]
    parts = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned("free", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        parts.append(F.struct(F.xxhash64("seg", F.lit(k), value).alias("seg"), without(F.col("free"), a, b - a).alias("free")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.seg", "p.free")


def segments(distinct: DataFrame, count: int, segment: int = SEGMENT, crowded: int = CROWDED) -> DataFrame:
    """distinct (fp), so many -> fp, seg: any two that differ in MAX_BITS at most meet in one segment or more."""
    low = min(16, max(0, math.ceil(math.log2(max(1, count) / min(segment, crowded)))))
    blocks = []
    for k in range(4 if low else 1):
        value = F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
        part = value.bitwiseAND(F.lit((1 << low) - 1))
        blocks.append(F.struct(F.xxhash64(F.lit(k), part).alias("seg"), F.xxhash64(F.lit(k), value).alias("whole"), without(F.col("fp"), 16 * k, 16).alias("free")))
    rows = distinct.select("fp", F.explode(F.array(*blocks)).alias("p")).select("fp", "p.*")
    # How a crowded segment is dealt: by its whole block, then by blocks of 48, 36 and 27 free bits.
    ways = [lambda r: r.select("fp", F.col("whole").alias("seg"), "free"), *(lambda r, w=w: deal(r, w) for w in (48, 36, 27))]
    done = None
    rows = materialize(rows, "segments")
    for way in ways:
        large = materialize(rows.groupBy("seg").count().where(F.col("count") > crowded).select("seg"), "crowded-segments")
        if large.isEmpty():
            break
        small = rows.join(large, "seg", "left_anti").select("fp", "seg")
        done = small if done is None else done.unionByName(small)
        rows = materialize(way(rows.join(large, "seg", "left_semi")), "segments")
    rows = rows.select("fp", "seg")
    return rows if done is None else done.unionByName(rows)


def links(distinct: DataFrame, segment: int = SEGMENT, crowded: int = CROWDED) -> DataFrame:
    """distinct (fp) -> links (u, v) that connect all fingerprints within MAX_BITS of each other."""
    rows = segments(distinct, distinct.count(), segment, crowded).repartition("seg").sortWithinPartitions("seg", gray_rank(F.col("fp")))

    def run(batches):
        held_f, held_s = [], []

        def emit(f, s):
            if len(f):
                u, v = segment_links(f, s)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_f.append(batch.column("fp").to_numpy().view(np.uint64))
            held_s.append(batch.column("seg").to_numpy())
            if sum(map(len, held_f)) >= TOGETHER and held_s[-1][-1] != held_s[0][0]:
                f, s = np.concatenate(held_f), np.concatenate(held_s)
                cut = int(np.flatnonzero(s != s[-1])[-1]) + 1  # the last segment may go on
                yield from emit(f[:cut], s[:cut])
                held_f, held_s = [f[cut:]], [s[cut:]]
        if held_f:
            yield from emit(np.concatenate(held_f), np.concatenate(held_s))

    return rows.select("fp", "seg").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach) for every row."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    near = materialize(links(distinct), "fingerprint-links")
    roots = materialize(components(near), "components")
    release(near)
    linked = distinct.join(roots, distinct.fp == roots.node)
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = roots.join(names, "root").select(F.col("node").alias("fp"), "name")
    # Written, so that both sides are dealt by fp for the last join alone and a large group is split at run time.
    of = materialize(distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "component-names")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows that stay: of each component the document that names it; rows without a doc_id can't be named and stay.

    Rows go by doc_id and fingerprint, so that of rows that share a doc_id only those in another's component go.
    """
    own, doc, fp = (free_name(docs.columns, n) for n in ("own_fp", "gone_doc", "gone_fp"))
    gone = near_duplicates(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias(doc), F.col("fp").alias(fp)).distinct()
    rows = with_fingerprint(docs, own, shingle)
    return rows.join(gone, (rows["doc_id"] == F.col(doc)) & (rows[own] == F.col(fp)), "left_anti").drop(own)


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
