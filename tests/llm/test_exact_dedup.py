import hashlib

import pytest

from octolith.llm import exact_dedup as D


def rows(spark, data):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in data], "doc_id bigint, text string, digest string, keep_id int")


def test_batches_meet_the_index(spark):
    index = D.DigestIndex(spark, buckets=4)
    first = D.dedup_batch(rows(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "c"), (6, "a"), (6, "a")]), index)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()), key=str)
    want = [(1, 6, 4, False), (2, 6, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (6, 6, 4, True), (6, 6, 4, True)]
    assert got == sorted(want, key=str)
    second = D.dedup_batch(rows(spark, [(9, "a"), (10, "new"), (11, "new")]), index)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect()) == [(9, 6, False), (10, 11, False), (11, 11, True)]
    assert index.entries().count() == 5
    again = D.DigestIndex(spark, index.path, 4)
    kept = D.keep_first_rows(rows(spark, [(20, "b"), (21, "z"), (22, "z"), (22, "z")]), again)
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(22, "z")] and kept.columns == ["doc_id", "text", "digest", "keep_id"]


def test_bucket_count_belongs_to_the_index(spark):
    texts = rows(spark, [(i, f"t{i}") for i in range(200)])
    index = D.DigestIndex(spark, buckets=4)
    assert D.keep_first_rows(texts, index).count() == 200
    with pytest.raises(ValueError, match="4 buckets"):
        D.DigestIndex(spark, index.path, 16)
    spark.sql(f"DROP TABLE {index.name}")  # as in a new session, which knows the path alone
    again = D.DigestIndex(spark, index.path)
    assert again.buckets == 4 and D.keep_first_rows(texts, again).count() == 0
    again.drop()


def test_a_batch_can_be_run_again(spark):
    index = D.DigestIndex(spark, buckets=4)
    D.keep_first_rows(rows(spark, [(1, "old")]), index, "a")
    batch = rows(spark, [(i, f"t{i % 60}") for i in range(200)] + [(500, "old")])
    runs = [sorted(D.keep_first_rows(batch, index, "b").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 60 and index.entries().count() == 61


def test_columns_of_any_name_and_repeats_that_differ(spark):
    names = ["__copies", "__digest", "__keep", "digest", "row", "fresh", "copies", "batch"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)
    data = [(1, "a", *[c] * len(names)) for c in "zyx"] + [(2, "b", *["q"] * len(names))]
    results = []
    for order in (data, data[::-1]):
        kept = D.keep_first_rows(spark.createDataFrame(order, schema).repartition(3), D.DigestIndex(spark, buckets=4))
        assert kept.columns == ["doc_id", "text", *names]
        results.append(sorted(kept.collect()))
    assert results[0] == results[1] and [r.doc_id for r in results[0]] == [1, 2]


def test_empty_and_plan(spark):
    index = D.DigestIndex(spark, buckets=4)
    assert D.dedup_batch(rows(spark, []), index).count() == 0
    groups = D.groups_of(rows(spark, [(1, "a")]))
    plan = groups.select("digest").join(index.before("x").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 2


@pytest.mark.parametrize("n", [3000])
def test_large_group(spark, n):
    out = D.dedup_batch(rows(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(n)]), D.DigestIndex(spark))
    assert out.where("kept").count() == n // 3 + 1 and out.count() == n


def test_query_decides_over_two_batches(spark, tmp_path, monkeypatch):
    """Odd rows through the query; the index refuses texts of the first batch in the second."""
    data = [(1, "a"), (100, "a"), (40, "a"), (40, "a"), (None, "a"), (None, None), (3, ""), (99, "late"), (2, "early"), (7, None)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, plain = [], D.decide
    monkeypatch.setattr(D, "decide", lambda g, i, b: seen.append((b, out := plain(g, i, b))) or out)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in D.op8_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    group = lambda t: [k for k, x in data if (x or "") == (t or "")]
    keep = lambda t: max((k for k in group(t) if k is not None), default=None)
    assert got == sorted(((k, keep(t), len(group(t)), k == keep(t), sha(t)) for k, t in data), key=str)
    assert [(b, df.where("NOT fresh").count()) for b, df in seen] == [("greater", 0), ("lesser", 1)]
