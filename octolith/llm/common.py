"""What the corpus operators share: table access, null handling and files in the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract here: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """The name, or the first of name_1, name_2, ... that no column has."""
    lower, k, out = {c.lower() for c in taken}, 0, name
    while out.lower() in lower:
        k, out = k + 1, f"{name}_{k + 1}"
    return out


def about(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About four times so many rows, those with the smallest hashes of the keys; all rows if there are fewer.

    What follows (an order and a limit) then meets few rows, however many partitions df has.
    """
    total = df.count()
    if total <= 4 * rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int((1 << 40) * 4 * rows / total)))


def open_fs(uri: str):
    """(file system, path) for a URI of the shared folder, for executors that read or write plain files there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def release_memory() -> None:
    """Give memory back at the end of a task: Python workers stay, and idle ones would keep what they once needed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def open_output(uri: str):
    """Yields a function that opens the file at its first call and returns the stream.

    The file gets its name at the end, so that a repeated task leaves the same single file and a failed one none.
    """
    fs, path = open_fs(uri)
    part, opened = f"{path}.{uuid.uuid4().hex}.tmp", []

    def late():
        if not opened:
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            opened.append(fs.open_output_stream(part, compression=None))
        return opened[0]

    yield late
    if opened:
        opened[0].close()
        fs.move(part, path)


def write_file(uri: str, data: bytes) -> None:
    with open_output(uri) as late:
        late().write(data)
