import gzip
import random

import pytest

from octolith.llm import warc as W
from octolith.llm.common import open_fs
from octolith.session import work_path


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 33])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(([rng.randint(0, 9)], (i, j)) for j in range(rng.randint(0, 20))) for i in range(k)]
    got = list(W.LoserTree(runs))
    assert got == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1][0])) or sorted(got) == sorted(x for r in runs for x in r)
    assert [x[0] for x in got] == sorted(x[0] for x in got)


def test_url_keys():
    assert W.url_key("https://www.Blog.Example.com:80/A?b=C#d") == "com,example,blog)/a?b=c"
    assert W.url_key("") == ")" and W.url_key("http://u@h.org?x") == "org,h)/?x"


ROWS = [
    (1, "http://b.org/x", "same"), (2, "http://a.org/x", "same"), (3, "http://a.org/x", "same"), (4, None, None), (5, "http://c.org/\r\nq", ""),
    (None, "http://a.org/x", "same"), (None, "u", "no page"), (6, "http://a.org/x", "é" * 70_000), (7, "x", "once"), (7, "x", "once"),
]


@pytest.mark.parametrize("fan_in", [2, 32])
def test_histories_are_ordered_and_read_back(spark, monkeypatch, fan_in):
    monkeypatch.setattr(W, "FAN_IN", fan_in)
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, offset int").repartition(5)
    folder = work_path(spark, "w")
    bounds = W.boundaries_of(pages, 3)
    index = W.merge_runs(spark, folder, W.write_archives(pages, folder, bounds), bounds, fan_in).collect()
    keys = [W.sort_key(r.asDict()) for r in sorted(index, key=lambda r: r.part)]
    assert keys == sorted(keys) and len(index) == len(ROWS)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.read_records(spark.createDataFrame(index), folder).collect()), key=str)
    want = [(1, "revisit", 3, 4), (2, "revisit", 3, 4), (3, "response", None, 4), (4, "revisit", 5, 0), (5, "response", None, 0), (None, "revisit", 3, 4), (None, "response", None, 7), (6, "response", None, 140_000), (7, "response", None, 4), (7, "response", None, 4)]
    assert got == sorted(want, key=str)


def test_archives_are_plain_gzip_members(spark):
    pages = spark.createDataFrame([r for r in ROWS if r[0]], "page_id bigint, url string, html string")
    folder = work_path(spark, "w")
    index = W.write_and_index(pages, folder, 2)
    name = index.first().file
    fs, path = open_fs(f"{folder}/{name}")
    with fs.open_input_stream(path, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def test_records_have_unique_ids_and_attempts_own_files(spark):
    pages = spark.createDataFrame([(*r,) for r in ROWS], "page_id bigint, url string, html string").coalesce(1)
    folder, ids = work_path(spark, "w"), []
    W.write_archives(pages, folder, [])
    W.write_archives(pages, folder, [])  # as a second attempt of the same tasks
    fs, path = open_fs(folder)
    from pyarrow.fs import FileSelector

    archives = [f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".warc.gz")]
    for a in archives:
        with fs.open_input_stream(a, compression=None) as f:
            ids += [x for x in gzip.decompress(f.read()).split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 2 * len(ROWS) and len(archives) >= 2


def test_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy"), (3, "b", "long"), (4, "b", "long")], "page_id bigint, url string, html string")
    folder = work_path(spark, "w")
    out = W.read_records(W.write_and_index(pages, folder, 2, least=3), folder)
    assert sorted((r.page_id, r.refers_to) for r in out.collect()) == [(1, None), (2, None), (3, 4), (4, None)]
    folder = work_path(spark, "w")
    assert W.read_records(W.write_and_index(pages.limit(0), folder, 2), folder).count() == 0
