from octolith.llm import simhash


def test_rows_go_by_doc_id_and_fingerprint(spark):
    rows = [(1, "one text of some words"), (5, "One  text of some words"), (5, "something else that nobody copies here"), (None, "one text of some words")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(*r,) for r in (rows[0], rows[2], rows[3])], key=str)


def test_columns_of_any_name(spark):
    names = ["own_fp", "gone_doc", "gone_fp", "__gone", "__fp", "GONE_FP_1"]
    docs = spark.createDataFrame([(k, t, *names) for k, t in ((1, "a b c"), (2, "A b  c"), (3, "other words here"))], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
