import pytest

from octolith.session import work_path
from octolith.sources import journal


def test_records_round_trip(spark):
    df = spark.createDataFrame([(3, True, "a;b")], "value int, condition boolean, label string")
    path = work_path(spark, "journal")
    journal.write_records(df, path)
    assert journal.read_records(spark, path, "value int, condition boolean, label string").collect() == df.collect()
    journal.write_records(df.select("label"), path, "text")
    assert spark.read.text(path).first().value == "a;b"
    with pytest.raises(ValueError):
        journal.write_records(df, path, "binary")


def test_rates():
    j = journal.ThroughputJournal()
    assert j.mean_rate() == 0.0
    j.rows = [{"rows": 100, "processed_per_sec": 50.0}, {"rows": 300, "processed_per_sec": 300.0}]
    assert j.mean_rate() == 300.0 and round(j.mean_rate(2), 3) == round(400 / 3, 3)
