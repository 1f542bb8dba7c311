import zlib
from collections import Counter, defaultdict

import pytest

from octolith.llm import sharding as S

SF = "/root/testdata/sf0.01"


def law_holds(rows, n, shards):
    count = Counter(r.shard for r in rows)
    assert sum(count.values()) == n and max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(rows):
    """Groups in more shards than they need."""
    places = defaultdict(Counter)
    for r in rows:
        places[bytes(r.group)][r.shard] += 1
    quota = len(rows) // 16 or 1
    return sum(len(c) > -(-sum(c.values()) // quota) for c in places.values()), sum(sum(c.values()) > 1 for c in places.values())


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.op2_balanced_labels(spark, SF).collect()
    law_holds(rows, len(docs), 16)
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
    full = S.shard_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    broken, groups = cut(full)
    assert groups > 50 and broken == 0


def test_large_group_and_edges(spark):
    rows = [(i, "hot") for i in range(600)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(2000 + i, f"t{i}") for i in range(600)] + [(None, None), (1, ""), (1, "")]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id bigint, text string, group string, shard int").repartition(4)
    out = S.shard_rows(docs).collect()
    law_holds(out, len(rows), 16)
    hot = Counter(r.shard for r in out if r.text_crc32 == zlib.crc32(b"hot"))
    assert max(hot.values()) > 60
    pairs = [r for r in out if r.doc_id and 1000 <= r.doc_id < 2000]
    place = defaultdict(set)
    for r in pairs:
        place[bytes(r.group)].add(r.shard)
    assert sum(len(v) > 1 for v in place.values()) <= 5


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(i, "x") for i in range(n)], "doc_id bigint, text string")
    rows = S.shard_rows(docs).collect()
    assert len(rows) == n
    if n:
        law_holds(rows, n, 16)
