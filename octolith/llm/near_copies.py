"""SimHash near-dedup at a given similarity: texts whose Jaccard similarity is LEAST or more, on shingles of SHINGLE words.

Candidates come from two searches over all texts. The Gray-order index of simhash.py links texts whose fingerprints differ
in 3 bits at most. At a similarity of 0.8, however, fingerprints of 64 bits differ in about 10 bits, beyond what any
index can search at scale, and most near copies would stay. MinHash signatures of BANDS * ROWS values, cut into bands,
find the others. Two texts of similarity s share a band with
probability 1 - (1 - s**ROWS)**BANDS, which is 0.999995 at 0.8 and more above. The connected groups of texts that share
bands or fingerprint links are blocks; each candidate's text is dealt to its block once, and there overlaps are counted
exactly (by 64-bit hashes of the shingles). A block of more than CHUNK texts is split into chunks, each with the block's
guests, so that large groups of copies become one component in work that grows with their texts. Then only texts of
different components still meet, by chunks of the block or of those that share a key. Links of LEAST or more make the components; no
candidate is left out because of a block's size.

Defined results: a null text is empty; texts without words are alike; a text of fewer than SHINGLE words is one shingle;
upper case counts as lower case in ASCII; of each component the rows with the least doc_id (null last) and, among its
texts, the least text key stay; rows that are equal in both all stay; other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.llm import simhash
from octolith.llm.common import free_name
from octolith.llm.components import components
from octolith.llm.simhash import unite
from octolith.llm.units import text_slices
from octolith.session import materialize

LEAST, SHINGLE, SEED = 0.8, 5, 42
BANDS, ROWS = 40, 6
#: Texts of a block that one task takes, and shingles that are permuted at once.
CHUNK, STEP = 1000, 2048
#: Texts of a crowded block that meet all of its chunks.
GUESTS = 8


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, ascending."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(text.lower().split())
    gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, gap + 1], np.r_[gap, len(joined)]
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
    return draw(), draw() | np.uint64(1)


def bands(h: np.ndarray, flip: np.ndarray, times: np.ndarray) -> list[int]:
    """A key for each band of the set's signature."""
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(h), STEP):
        low = np.minimum(low, ((h[a : a + STEP] ^ flip) * times).min(axis=1))
    return [xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is set if more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), simhash.BLOCK):
        ones += np.unpackbits(h[a : a + simhash.BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (the text's key), fp (the SimHash of its set of shingles), keys (one for each band)."""

    def run(batches):
        flip, times = permutations()
        for batch in batches:
            for first, piece in text_slices(batch.column("text")):
                sets = [shingles(t) for t in piece.to_pylist()]
                fps = np.array([fingerprint(h) for h in sets], np.uint64).view(np.int64)
                keys = np.array([bands(h, flip, times) for h in sets], np.uint64).view(np.int64)
                at = pa.array(np.arange(len(piece) + 1) * BANDS, pa.int32())
                own = [batch.column(c).slice(first, len(piece)) for c in ("doc_id", "node")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fps), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["doc_id", "node", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("node"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, node bigint, fp bigint, keys array<bigint>")


def keys(signed: DataFrame) -> DataFrame:
    """node, key: texts that share a key are candidates. Keys are the bands, the fingerprint, and the star that links it in the Gray index."""
    least = materialize(signed.groupBy("fp").agg(F.min("node").alias("node")), "least-by-fingerprint")
    near = materialize(simhash.links(least.select("fp")), "fingerprint-links")
    ends = near.select(F.col("u").alias("fp"), "v").union(near.select(F.col("v").alias("fp"), "v").distinct())
    stars = materialize(ends.join(least, "fp").select("node", F.xxhash64(F.lit("star"), "v").alias("key")), "fingerprint-stars")
    banded = signed.select("node", F.explode("keys").alias("key"))
    return banded.union(signed.select("node", F.xxhash64(F.lit("equal"), "fp").alias("key"))).union(stars)


def blocks(keyed: DataFrame) -> DataFrame:
    """node, root: the texts that share a key with another text, and the least text that such steps reach."""
    # Written, so that the join deals both of its sides and a key of very many texts is split at run time.
    shared = materialize(keyed.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select("key", "m"), "shared-keys")
    stars = keyed.join(shared, "key").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    return materialize(components(materialize(stars.distinct(), "stars")), "blocks")


def similar(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Labels of the components under similarity of least or more; overlaps are counted, all of a set's at once."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(word, kind="stable")
    holders, start = owner[order], np.r_[0, np.cumsum(np.bincount(word))]
    at, labels = np.r_[0, np.cumsum(size)], np.arange(n)
    for i in range(n - 1):
        if (labels[i + 1 :] == labels[i]).all():
            continue
        own = word[at[i] : at[i + 1]]
        count = start[own + 1] - start[own]
        place = np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(holders[place], minlength=n)
        # In whole numbers, so that exactly LEAST is not lost in rounding.
        hit = np.flatnonzero(1000 * both >= round(1000 * least) * (size + size[i] - both))
        hit = hit[hit > i]
        unite(labels, np.full(len(hit), i), hit)
    return labels


def meet(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (root, node, task) -> links (u, v) that connect all texts of a task that are similar."""
    placed = materialize(placed, "near-tasks")
    texts = docs.select(text_key().alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(placed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rows = texts.join(placed, "node").repartition("root", "task").sortWithinPartitions("root", "task", "node")

    def run(batches):
        held, now = [], None

        def emit():
            if len(held) > 1:
                nodes = np.array([k for k, _ in held], np.int64)
                labels = similar([s for _, s in held])
                at = np.flatnonzero(labels != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[labels[at]])], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "task", "node")]
            for first, piece in text_slices(batch.column("text")):
                for i, text in enumerate(piece.to_pylist(), first):
                    if (group := (columns[0][i], columns[1][i])) != now:
                        yield from emit()
                        held, now = [], group
                    held.append((columns[2][i], shingles(text)))
        yield from emit()

    return materialize(rows.select("root", "task", "node", "text").mapInArrow(run, "u bigint, v bigint"), "near-links")


def own_chunk(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), chunks).cast("bigint")


def links(docs: DataFrame, keyed: DataFrame, block: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """links (u, v) that connect all candidates that are similar."""
    crowded = block.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    crowded = materialize(crowded.select("root", F.ceil(F.col("n") * 2 / chunk).cast("bigint").alias("chunks")), "crowded-blocks")
    small = block.join(crowded, "root", "left_anti").select("root", "node", F.lit(0).cast("bigint").alias("task"))
    if crowded.isEmpty():
        return meet(docs, small)
    # Each text of a crowded block meets one chunk of it and the block's guests, who come to all chunks.
    large = materialize(block.join(crowded, "root").select("root", "node", "chunks"), "crowded-texts")
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("draw"), "node")).alias(f"guest{i}") for i in range(GUESTS)]
    guests = large.groupBy("root", "chunks").agg(*draws)
    guests = guests.select("root", "chunks", F.explode(F.array_distinct(F.array(*[F.col(f"guest{i}.node") for i in range(GUESTS)]))).alias("node"))
    visits = guests.select("root", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("task"))
    stay = large.select("root", "node", own_chunk(F.col("chunks")).alias("task"))
    first = meet(docs, small.union(stay.union(visits).distinct()))
    return first.union(meet(docs, unsettled(keyed, large, components(first), chunk)))


def unsettled(keyed: DataFrame, large: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """root, node, task: what has to meet yet so that all candidates of crowded blocks have met or are in one component.

    Groups are a block's keys, or the block as a whole, whichever takes fewer copies of texts. Those whose texts are all in
    one component (a part) are settled. Of the others the largest part's texts need not meet each other again, so that they
    are copied once for each chunk of the rest.
    """
    named = roots.select("node", F.col("root").alias("name"))
    parts = materialize(large.join(named, "node", "left").select("root", "node", F.coalesce("name", "node").alias("part")), "parts")
    whole = parts.select("root", F.col("root").alias("key"), "node", "part", F.lit(True).alias("whole"))
    rows = keyed.join(parts, "node").select("root", "key", "node", "part", F.lit(False).alias("whole")).distinct()
    rows = materialize(rows.union(whole), "crowded-groups")
    group = ["root", "whole", "key"]
    counts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.groupBy(*group).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    several = lambda n: F.when(F.col("n") > chunk, F.ceil(n * 2 / chunk)).otherwise(1).cast("bigint")
    plan = plan.select(*group, "main", "most", "n", several(F.col("most")).alias("a"), several(F.col("n") - F.col("most")).alias("b"))
    copies = F.when(F.col("n") > chunk, F.expr("most * b + (n - most) * (a + b - 1)")).otherwise(F.col("n")).cast("double")
    plan = materialize(plan.withColumn("copies", copies), "unsettled-groups")
    total = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("copies"))), F.lit(0.0))
    chosen = plan.groupBy("root").agg((total(F.col("whole")) <= total(~F.col("whole"))).alias("whole"))
    rows = rows.join(plan.join(chosen, ["root", "whole"]).drop("root", "n"), ["whole", "key"])
    a, b, is_main, zero = F.col("a"), F.col("b"), F.col("part") == F.col("main"), F.lit(0).cast("bigint")
    own = own_chunk(F.when(is_main, a).otherwise(b))
    to_rest = F.transform(F.sequence(zero, b - 1), lambda i: i * a + own)
    to_main = F.transform(F.sequence(zero, a - 1), lambda j: own * a + j)
    others = F.filter(F.sequence(zero, b - 1), lambda k: k != own)
    among = F.transform(others, lambda k: a * b + F.least(k, own) * b + F.greatest(k, own))
    tasks = F.when(is_main, to_rest).otherwise(F.concat(to_main, among))
    return rows.select(F.col("key").alias("root"), "node", F.explode(tasks).alias("task"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay: of each component of near copies one document."""
    doc, node = (free_name(docs.columns, n) for n in ("gone_doc", "gone_node"))
    signed = materialize(signatures(docs), "signatures")
    keyed = keys(signed)
    roots = materialize(components(links(docs, keyed, blocks(keyed))), "near-components")
    placed = materialize(signed.select("doc_id", "node").join(roots, "node"), "near-rows")
    # Structs order by doc_id, null last, then by text key.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = materialize(placed.groupBy("root").agg(F.min(rank).alias("first")), "near-first")
    gone = placed.join(first, "root").where(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(doc), F.col("node").alias(node)).distinct()
    gone = materialize(gone, "near-gone")
    return docs.join(gone, (text_key() == F.col(node)) & docs["doc_id"].cast("bigint").eqNullSafe(F.col(doc)), "left_anti")
