import re

import numpy as np
import pytest
import xxhash

from octolith.llm import components, simhash

SF = "/root/testdata/sf0.01"


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Least index reachable, by all pairs of distinct values."""
    u = sorted(set(fps))
    a = np.array(u, np.uint64)
    label = np.arange(len(u))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    return {f: int(label[k]) for k, f in enumerate(u)}


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {k: brute_fp(t) for k, t in docs.items()}
    of = brute_components(list(fps.values()))
    least = {}
    for k in sorted(docs):
        least.setdefault(of[fps[k]], k)
    got = simhash.op9_simhash_gray(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", least[of[fps[r.doc_id]]])


def test_native_hash_agrees(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def ball(rng, centre, n, reach):
    out = {centre}
    while len(out) < n:
        f = centre
        for k in rng.integers(0, 64, rng.integers(1, reach + 1)):
            f ^= 1 << int(k)
        out.add(f)
    return out


def gray(values):
    """The values in Gray order."""
    return np.array(sorted(values, key=lambda x: np.bitwise_xor.accumulate([int(b) for b in f"{x:064b}"]).tolist()), np.uint64)


def same_groups(values, labels, want):
    groups = {}
    for x, k in zip(values, labels, strict=True):
        groups.setdefault(k, set()).add(want[int(x)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


@pytest.mark.parametrize("reach", [2, 6, 30])
def test_index_equals_all_pairs(reach):
    f = gray(ball(np.random.default_rng(reach), 0x0123456789ABCDEF, 700, reach))
    same_groups(f, simhash.GrayIndex(f).join().tolist(), brute_components([int(x) for x in f]))


def test_index_prunes_groups_of_real_fingerprints(spark):
    """The query's own fingerprints: whole groups are cut, few members are compared, all components are found."""
    f = gray({int(r.fp) % 2**64 for r in simhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).select("fp").distinct().collect()})
    index = simhash.GrayIndex(f)
    labels = index.join().tolist()
    assert len(index.levels) >= 4 and index.pruned > len(f) and 2 * index.compared < len(f) * (len(f) - 1) / 2
    same_groups(f, labels, brute_components([int(x) for x in f]))


def test_trees_of_many_segments_stay_apart():
    rng = np.random.default_rng(4)
    parts = [gray({int(x) for x in rng.integers(0, 2**63, n, np.uint64)} | ball(rng, int(rng.integers(2**62)), n, 3)) for n in (1, 3, 60, 9, 200)]
    seg = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    labels = simhash.GrayIndex(np.concatenate(parts), seg).join()
    for k, p in enumerate(parts):
        own = labels[seg == k]
        assert (seg[own] == k).all()
        same_groups(p, own.tolist(), brute_components([int(x) for x in p]))


@pytest.mark.parametrize(("segment", "crowded"), [(4096, 65536), (60, 65536), (64, 40), (8, 3)])
def test_dealing_loses_no_link(spark, segment, crowded):
    rng = np.random.default_rng(1)
    fps = sorted(ball(rng, 5, 300, 5) | ball(rng, 2**64 - 9, 300, 9) | {0} | {int(x) for x in rng.integers(0, 2**63, 300, np.uint64)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    want = brute_components(fps)
    root = {r.node % 2**64: r.root for r in components.components(simhash.links(df, segment, crowded)).collect()}
    same_groups(fps, [root.get(x, ("alone", x)) for x in fps], want)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (4, "a b"), (5, "A  b"), (None, "only null here x y z"), (7, "w " * 60_000), (7, "w " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (4, 4), (5, 4), (None, None), (7, 7), (7, 7)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 7, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
