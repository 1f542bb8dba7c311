"""Where intermediate tables live and how they go again."""

import pytest

from octolith import session


def test_tables_are_written_read_and_released(spark):
    kept, gone = (session.materialize(spark.range(5), n) for n in ("kept", "gone"))
    session.release(gone, None, spark.range(1))
    assert kept.count() == 5 and session.path_exists(spark, kept.written_to) and not session.path_exists(spark, gone.written_to)


def test_paths_get_their_scheme(spark):
    assert session.qualified(spark, "/some/where/") == "file:/some/where"
    assert session.work_path(spark, "x").startswith(session.shared_dir(spark))


def test_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    sc = spark.sparkContext
    monkeypatch.setattr(type(sc), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(sc, "master", "spark://host:7077")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            session.shared_dir(spark)
