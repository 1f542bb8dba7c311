import numpy as np
import public_tokenizers

import corpus_pipeline as C
from octolith.llm import units
from octolith.session import materialize
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = materialize(C.quality_rules(spark, docs, SF), "t")
    after = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and not any(brute_quality(t)[5] for t in after.values())
    good = [k for k in before if labels.get(k) == 1 and not brute_quality(before[k])[5]]
    assert sum(k in after for k in good) >= 0.98 * len(good)

    docs = materialize(C.exact_duplicates(spark, docs, SF), "t")
    want = {}
    for k in sorted(after):
        want[after[k]] = k
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(want.values())

    rows = {r.doc_id: r.text for r in docs.collect()}
    docs = materialize(C.near_duplicates(spark, docs, SF), "t")
    kept = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and sorted(kept) == brute_kept(list(rows.items()))

    rows = {r.doc_id: r.text for r in docs.collect()}
    docs = materialize(C.secret_scan(spark, docs, SF), "t")
    clean = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and clean.keys() == rows.keys()
    for k, r in clean.items():
        assert ("[SECRET]" in r.text) >= bool(brute_secrets(rows[k])) and not brute_secrets(r.text) and r.n_chars == len(r.text)

    pieces = C.pack_sequences(spark, docs, SF).toPandas()
    tok = units.load_tokenizer(units.tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json")))
    assert set(pieces.doc_id) == set(clean)
    for k in list(clean)[:50]:
        own = pieces[pieces.doc_id == k].sort_values("start")
        assert np.concatenate([np.frombuffer(b, "<u4") for b in own.ids]).tolist() == tok.encode(clean[k].text, add_special_tokens=False).ids + [0]


def test_run_and_repeated_rows(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 100
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twice = docs.union(docs).union(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    kept = C.exact_duplicates(spark, materialize(twice, "t"), "")
    texts = docs.select("text").distinct().count()
    assert kept.count() == texts and kept.where("doc_id IS NULL").count() == 0


def test_stages_on_nothing_and_on_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, digest string"
    odd = [(None, None, None, None, None, None, None), (1, "", "", "", 0, True, "d"), (2, " \n", "x", "y", 2, False, None), (3, "word " * 100_000, "x", "y", 500_000, None, "e"), (3, "word " * 100_000, "x", "y", 500_000, None, "e")]
    for rows in ([], odd):
        docs = materialize(spark.createDataFrame(rows, schema), "t")
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
