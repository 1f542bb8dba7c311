"""Journals: records of a run as text or CSV files, and throughput of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

KINDS = ("csv", "text")


def write_records(records: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with semicolons and a header, or lines of text from the only column."""
    if kind not in KINDS:
        raise ValueError(f"journals are {' or '.join(KINDS)}, not {kind!r}")
    writer = records.write.mode("overwrite")
    if kind == "csv":
        writer.option("sep", ";").option("header", True).csv(path)
    else:
        writer.text(path)


def read_records(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def counted(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the rows which have passed once an action has run (Q11)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class ThroughputJournal(StreamingQueryListener):
    """Rows a second of each micro-batch, read and processed."""

    def __init__(self):
        self.rows: list[dict] = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows.append({"batch": p.batchId, "rows": p.numInputRows, "read_per_sec": p.inputRowsPerSecond, "processed_per_sec": p.processedRowsPerSecond})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def mean_rate(self, last: int = 1) -> float:
        """Rows over the time of the last batches."""
        rows = [r for r in self.rows[-last:] if r["rows"] and r["processed_per_sec"]]
        seconds = sum(r["rows"] / r["processed_per_sec"] for r in rows)
        return sum(r["rows"] for r in rows) / seconds if seconds else 0.0
