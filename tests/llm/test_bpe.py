import hashlib
import json

import numpy as np
import public_tokenizers
import pytest

from octolith.llm import bpe, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "don't  stop\n\nit's 12 3é \t", "x <|endoftext|> y <|endoftext|>", "中文 b 😀 \u0085 z　 q", "word " * 20_000, "same", "same", "A\r\nb" + " " * 300 + "c"]


@pytest.fixture(scope="module")
def tok():
    return units.load_tokenizer(units.tokenizer_spec(PATH))


@pytest.mark.parametrize("chunk", [3, 500_000])
def test_edges(spark, tok, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", chunk)
    rows = [(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string, chunk int").repartition(3)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()), key=str)
    want = []
    for k, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k, ids, tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_each_word_is_in_one_bucket(spark, monkeypatch):
    """What is remembered within a bucket is all that a word needs to be encoded once."""
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 50)
    docs = spark.createDataFrame([(i, f"w{i % 7} same words x{i}" * 5) for i in range(300)], "doc_id bigint, text string").repartition(4)
    bucket_of, chunks = {}, set()
    for r in bpe.split(docs, 16).collect():
        chunks.add(r.chunk)
        for w in bpe.unpack_words(bytes(r.body))[0] if r.key < 0 else ():
            assert bucket_of.setdefault(w, r.key) == r.key
    assert len(chunks) >= 4 and len(bucket_of) > 300 and any(len(bpe.unpack_words(bytes(r.body))[0]) < 50 for r in bpe.split(docs, 16).where("key < 0").collect())


def test_tokenizers_that_cross_white_space_are_refused(spark, tmp_path):
    spec = json.loads(units.tokenizer_spec(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="white space"):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), str(tmp_path / "t.json"))


def test_query_against_library(spark, tok):
    got = {r.doc_id: r for r in bpe.op3_bpe_words(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert x.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def test_lossy_decoding_as_the_library(spark, tok):
    ids = [tok.token_to_id(t) for t in ("Ã", "a", "©", "Ġb")]
    df = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes()))], "doc_id bigint, ids binary")
    assert bpe.decode(df, PATH).first().text == tok.decode(ids, skip_special_tokens=False)
