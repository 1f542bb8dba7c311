import random
import re

import numpy as np
import pytest

import corpus_pipeline as C
from octolith.llm import near_copies as N
from octolith.session import materialize

STAGE = dict(C.STAGES)["near_dedup"]


def brute_set(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """(doc_id, text) that stay, by all pairs of distinct texts that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    sets, holders, of = [brute_set(t) for t in texts], {}, list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, own in enumerate(sets):
        seen = {}
        for s in own:
            for j in holders.setdefault(s, []):
                seen[j] = seen.get(j, 0) + 1
            holders[s].append(i)
        for j, both in seen.items():
            if 10 * both >= 8 * (len(own) + len(sets[j]) - both):
                of[top(i)] = top(j)
    at, groups = {t: i for i, t in enumerate(texts)}, {}
    for k, t in rows:
        groups.setdefault(top(at[t or ""]), []).append(k)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stage_against_all_pairs(spark, sf):
    docs = materialize(C.exact_duplicates(spark, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), ""), "t")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = STAGE(spark, docs, "")
    want = brute_kept(rows)
    assert len(want) < len(rows) and got.columns == docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want


def edited(rng, words, share):
    return " ".join(f"n{rng.random()}" if rng.random() < share else w for w in words)


def test_large_block_loses_no_copy(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, edited(rng, base, 0.015 + 0.03 * (k % 3))) for k in range(150)] + [(1000 + k, " ".join(f"q{rng.random()}" for _ in range(60))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    assert 50 < len(want) < 200
    whole = N.links
    for chunk in (1000, 40, 6):
        monkeypatch.setattr(N, "links", lambda *tables, c=chunk: whole(*tables, c))
        assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == want


def test_exact_bound():
    shared = np.arange(8, dtype=np.uint64)
    assert len(set(N.similar([np.r_[shared, np.uint64(20)], np.r_[shared, np.uint64(30)]]).tolist())) == 1  # 8 of 10
    assert len(set(N.similar([np.r_[shared, np.uint64(20), np.uint64(21)], np.r_[shared, np.uint64(30)]]).tolist())) == 2


def test_rows(spark):
    long = " ".join(f"w{k}" for k in range(200))
    other = " ".join(f"v{k}" for k in range(200))
    rows = [(1, None), (2, ""), (None, " \n"), (4, "a b"), (5, "A  b"), (7, long), (7, long), (8, long + " x"), (8, other), (None, long + " y"), (9, "the " * 500 + long), (10, "the " * 500 + other)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, node string")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, None), (4, "a b"), (7, long), (7, long), (8, other)], key=str)
    assert N.keep_one(docs.limit(0)).count() == 0
