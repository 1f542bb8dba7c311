import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from octolith.llm import quality as Q
from octolith.llm.units import text_slices

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


ODD = [None, "", " \n\t ", "a b c", "x\n\nx\nx \ny\x0bz\n", "a " * 40, "é# ü* \x85 ß|" * 9, "\n", "one two\n" * 30, "w" * 100_000]


def test_statistics_equal_brute_force():
    texts = pa.array(ODD)
    for _, piece in text_slices(texts):
        s = Q.statistics(piece)
        failed = Q.base_failed(s)
        got = [tuple(int(s[c][i]) for c in Q.COUNTS) + (bool(failed[i]),) for i in range(len(ODD))]
        assert got == [brute(t) for t in ODD]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.op10_quality_forest(spark, SF).toPandas()
    assert len(out) == len(docs)
    for r in out.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(out, on="doc_id")
    good, bad = labels[labels.quality == 1], labels[labels.quality == 0]
    judged, spoiled = good[~good.base_failed], bad[~bad.base_failed]
    assert judged.kept.mean() >= 0.98 and spoiled.kept.mean() <= 0.5  # few labels here; see the test at sf0.1


def test_edges(spark):
    rows = [(None if i == 1 else i, t, "clash", 1) for i, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = Q.fit(docs, none)
    assert model.forest is None and Q.judge(docs, model).count() == len(rows)
    assert Q.filter_quality(docs, model).columns == docs.columns
    assert Q.judge(docs.limit(0), model).count() == 0


def test_rows_that_the_fit_has_not_seen(spark):
    """Recall and precision on labelled rows beyond the sample, at sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, 2000)
    seen = {r.doc_id for r in labels.selectExpr("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2000).collect()}
    out = Q.judge(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    out = out[~out.base_failed & ~out.doc_id.isin(seen)]
    assert len(out) > 1000
    assert out[out.quality == 1].kept.mean() >= 0.99 and out[out.quality == 0].kept.mean() <= 0.1


def test_threshold_uses_good_and_bad_rows():
    score, good = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9]), np.array([1, 1, 1, 1, 0, 0], bool)
    assert 0.4 < Q.cut(score, good) < 0.8
    assert Q.cut(score, np.ones(6, bool)) == 0.9
    assert 0.4 < Q.cut(np.r_[score, 0.95], np.r_[good, True], 0.2) < 0.8
    assert Q.cut(np.r_[score, 0.95], np.r_[good, True], 0.1) == 0.95


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (2000, 4)), rng.normal(9, 1, (20, 4))]
    score = Q.IsolationForest(x).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)


def test_every_labelled_row_counts(spark):
    """The forest and the threshold are those of all labelled rows together, however these are dealt."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    known = labels.where("quality IS NOT NULL").selectExpr("doc_id", "quality").withColumn("held", F.expr("pmod(xxhash64(doc_id, 'half'), 2) = 1"))
    rows = Q.measure(docs).where(Q.PASSED).join(known, "doc_id").toPandas()
    good, held = rows.quality.to_numpy() == 1, rows.held.to_numpy()
    s = {c: rows[c].to_numpy() for c in Q.COUNTS + Q.MORE}
    prior = Q.usual({c: v[good & ~held] for c, v in s.items()})
    x = Q.features(s, prior)
    forest = Q.IsolationForest(x[good & ~held], x[~held])
    assert model.prior == prior and (model.forest.path == forest.path).all() and (model.forest.split == forest.split).all()
    assert model.threshold == Q.cut(forest.score(x[held]), good[held])
    assert (model.forest.visits(x[good & ~held]).sum(axis=1) == (good & ~held).sum()).all()
    again = Q.fit_measured(Q.measure(docs.repartition(13)), labels.repartition(3))
    assert (again.forest.path == forest.path).all() and again.threshold == model.threshold


def test_good_rows_beyond_the_smallest_hashes(spark):
    """Good rows in capitals, none of them among the 8192 labels with the smallest hashes, are known as good."""
    order = spark.range(12000).selectExpr("id AS doc_id", "row_number() OVER (ORDER BY xxhash64(id), id) AS place").toPandas()
    rng, rows = random.Random(1), []
    for doc_id, place in zip(order.doc_id.tolist(), order.place.tolist(), strict=True):
        words = ["abcdefghij"[: rng.randint(3, 9)] + str(rng.random())[2:4] for _ in range(40)]
        bad, late = place % 10 == 0, place > 8192
        text = " ".join(w.upper() if (late or bad) and rng.random() < 0.5 else w for w in words)
        rows.append((doc_id, text + " #$%&|" * 12 if bad else text, int(not bad), late))
    rows = spark.createDataFrame(rows, "doc_id long, text string, quality int, late boolean")
    out = Q.judge(rows, Q.fit(rows, rows.select("doc_id", "quality"))).join(rows.select("doc_id", "quality", "late"), "doc_id").toPandas()
    assert not out.base_failed.any() and not out[out.quality == 0].kept.any()
    assert out[(out.quality == 1) & out.late].kept.mean() >= 0.97 and out[(out.quality == 1) & ~out.late].kept.mean() >= 0.97
