import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from octolith.llm import token_files as T
from octolith.llm import units
from octolith.session import work_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_values_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = T.encode_values(v)
    assert len(control) == -(-len(v) // 4) and (T.decode_values(control, data, len(v)) == v).all()


def expected(docs):
    tok = units.load_tokenizer(units.tokenizer_spec(PATH))
    before, out = 0, []
    for k, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((k, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, T.op6_token_files(spark, SF).collect())) == expected(docs)


def test_edges(spark):
    docs = [(None, "first"), (1, None), (2, ""), (3, " \n"), (4, "ÉÀ İ ſ don't 12"), (5, "x" * 50_000 + " word" * 50_000), (6, "中文 <|endoftext|>b"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in reversed(docs)], "doc_id bigint, text string, ids string, start int")
    folder = work_path(spark, "t")
    T.write_corpus(df, PATH, folder)
    got = T.read_corpus(spark, folder)
    rows = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got.collect()), key=lambda r: r[1])
    assert rows == expected(docs)
    folder = work_path(spark, "t")
    assert T.write_corpus(df.limit(0), PATH, folder) == [] and T.read_corpus(spark, folder).count() == 0
