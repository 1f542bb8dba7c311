"""Packing by power-of-two decomposition.

A document's ids, with an end id, are cut into pieces of power-of-two lengths: blocks of the sequence length first, then
one piece for each set bit of what remains. Every piece is a sequence of its own, so that no sequence crosses documents
and none is padded; training draws batches from buckets of equal length.

write_buckets() puts pieces into a folder for each length, and read_buckets() reads one length or all of them: a training
job opens the lengths that it wants and finds nothing else there.

Sequence ids order by bucket: 4 bits of the length's exponent, 26 bits of the partition, 32 bits of the number in it.
They need no second pass and no shuffle, and a repeated task gives the same ones.

Defined results: a null text is empty, and an empty text is the end id alone (one piece of length 1); rows with equal or
null doc_id are packed each for itself; a text of any length is encoded whole; an empty table gives no pieces; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolith.llm.units import encoder, spread, tokenizer_spec
from octolith.session import work_path

SEQUENCE = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def decompose(sizes: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents with these sizes, in order, and each piece's document."""
    top = longest.bit_length() - 1
    blocks = sizes >> top
    bits = (sizes[:, None] >> np.arange(top - 1, -1, -1)) & 1  # of what the blocks leave, largest first
    per = np.concatenate([blocks[:, None], bits], axis=1)
    lengths = np.broadcast_to(1 << np.arange(top, -1, -1), per.shape)
    doc = np.broadcast_to(np.arange(len(sizes))[:, None], per.shape)
    return np.repeat(lengths.ravel(), per.ravel()), np.repeat(doc.ravel(), per.ravel())


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    spec = tokenizer_spec(tokenizer)

    def run(batches):
        from pyspark import TaskContext

        enc, part, given = encoder(spec, end_id), TaskContext.get().partitionId(), np.zeros(64, np.int64)
        for batch in batches:
            for first, ids, ends in enc.encode(batch.column("text")):
                sizes = np.diff(ends, prepend=0)
                lengths, doc = decompose(sizes, longest)
                stop = np.cumsum(lengths)
                start = stop - lengths
                power = np.round(np.log2(lengths)).astype(np.int64)
                order = np.argsort(power, kind="stable")
                found, times = np.unique(power, return_counts=True)
                rank = np.empty(len(power), np.int64)
                rank[order] = spread(given[found], times)
                given[found] += times
                for a in range(0, len(lengths), 50_000):
                    s = slice(a, a + 50_000)
                    m = len(lengths[s])
                    offs = np.r_[start[s][:1], stop[s]] * 4
                    if offs[-1] - offs[0] >= 1 << 31:
                        raise ValueError("a batch of pieces is too large")
                    body = ids[start[s][0] : stop[s][-1]].astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(first, len(sizes)).take(pa.array(doc[s])).cast(pa.int64()),
                            pa.array(start[s] - (ends - sizes)[doc[s]]),
                            pa.array(lengths[s]),
                            pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((offs - offs[0]).astype(np.int32)), pa.py_buffer(body)]),
                            pa.array(sizes[doc[s]]),
                            pa.array((power[s] << 58) | (part << 32) | rank[s]),
                            pa.array(np.zeros(m, np.int64)),
                        ],
                        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Pieces by length: a folder of Parquet files for each power of two."""
    pieces.write.partitionBy("length").parquet(folder)


def read_buckets(spark: SparkSession, folder: str, length: int | None = None) -> DataFrame:
    """Pieces of one length, whose files alone are read, or of all."""
    fields = T._parse_datatype_string(SCHEMA)
    pieces = spark.read.schema(fields).parquet(folder).select(*fields.names)
    return pieces if length is None else pieces.where(F.col("length") == length)


def op7_pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut at powers of two up to 1024, dealt to buckets of equal length and read back from them."""
    import public_tokenizers

    folder = work_path(spark, "packed")
    write_buckets(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")), folder)
    pieces = read_buckets(spark, folder)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
