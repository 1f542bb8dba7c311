import zlib

import numpy as np
import public_tokenizers
import pytest

from octolith.llm import packing, units
from octolith.session import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "don't  stop\n\nit's 12 3é", "x <|endoftext|> y", "中文 b 😀\u0085 z", "word " * 5000, "same", "same"]


def brute(text, tok):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_hold_each_id_once(spark):
    tok = units.load_tokenizer(units.tokenizer_spec(PATH))
    rows = [(None if i == 3 else i, t, "clash", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, part int").repartition(3)
    out = packing.pack(docs, PATH).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= 1024 for n in out.length)
    for i, t in enumerate(TEXTS):
        own = (out[out.doc_id.isna()] if i == 3 else out[out.doc_id == i]).sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in own.ids]).tolist()
        assert ids == brute(t, tok) and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]


def test_query_and_empty(spark):
    """Every document of the table, and every piece of each."""
    tok = units.load_tokenizer(units.tokenizer_spec(PATH))
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in packing.op7_pack_pow2(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        ids = np.array(brute(r.text, tok), "<u4")
        own = sorted(got[r.doc_id], key=lambda x: x.start)
        assert [x.start for x in own] == [0, *np.cumsum([x.length for x in own]).tolist()[:-1]] and sum(x.length for x in own) == len(ids)
        assert all(zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32 and x.doc_tokens == len(ids) for x in own)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, PATH, longest=1000)


def test_buckets_hold_one_length_each(spark):
    folder = work_path(spark, "buckets")
    pieces = packing.pack(spark.createDataFrame([(1, "word " * 3000), (2, "a b c"), (3, None)], "doc_id bigint, text string"), PATH)
    packing.write_buckets(pieces, folder)
    assert sorted(packing.read_buckets(spark, folder).collect()) == sorted(pieces.collect())
    ones = packing.read_buckets(spark, folder, 1)
    assert {r.length for r in ones.collect()} == {1} and "PartitionFilters: [isnotnull(length" in ones._jdf.queryExecution().executedPlan().toString()
    empty = work_path(spark, "buckets")
    packing.write_buckets(pieces.limit(0), empty)
    assert packing.read_buckets(spark, empty).count() == 0
