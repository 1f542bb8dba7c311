"""Token ids in binary files: frequency-ranked, byte-aligned variable-length, control bytes apart from data.

Ids are replaced by their frequency rank in the corpus, so that common ones take one byte. A value takes 1 to 4 bytes; two
bits give its length less one, and four of them make a control byte. A block's control bytes stand together before its
data bytes, and numpy decodes a block by looking up its control bytes in a table of lengths.

A corpus is a folder of files part-NNNNNN.ids in ascending order of doc_id, with `ranks` (the ids in order of rank) and
`manifest` (one line of JSON per file with the ids and documents before it). A file is a sequence of blocks:

    magic "OIDS", then little-endian: uint32 documents, uint64 ids, uint64 data bytes,
    int64 doc_id per document, uint8 per document (1: doc_id is null), uint64 ids per document,
    control bytes (ids / 4, rounded up), data bytes

Texts are tokenized once, into a table in the shared folder, from which ids are counted and files are written.

Defined results: a null text is empty, and an empty text is the end id alone; null doc_ids come first; rows that share a
doc_id are written one after the other in order of their ids' hash; an empty table gives a folder without parts; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import open_fs, open_output, write_file
from octolith.llm.units import encoder, tokenizer_spec
from octolith.session import materialize, qualified, work_path

MAGIC, HEAD = b"OIDS", struct.Struct("<4sIQQ")
#: Ids to a block, about; a document lies in one block.
BLOCK_IDS = 1 << 20
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = v.astype("<u4")
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = more
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= more[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(lengths) - lengths
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = d[start]
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        out[at] |= d[start[at] + k] << np.uint32(8 * k)
    return out


def write_block(out, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
    control, data = encode_values(values)
    out.write(HEAD.pack(MAGIC, len(doc_ids), len(values), len(data)))
    out.write(doc_ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(stream):
    """(doc_ids, null, counts, values) of each block."""
    while head := stream.read(HEAD.size):
        magic, docs, ids, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids, null = np.frombuffer(stream.read(8 * docs), "<i8"), np.frombuffer(stream.read(docs), np.uint8)
        counts = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        yield doc_ids, null, counts, decode_values(stream.read(-(-ids // 4)), stream.read(size), ids)


def binary_rows(ends: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    """One binary value per document: its little-endian values."""
    body = np.ascontiguousarray(values.astype(kind))
    offs = np.r_[0, ends] * body.itemsize
    if offs[-1] >= 1 << 31:
        raise ValueError("a batch of ids is too large")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(body)])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit where the vocabulary allows, else 32-bit), the end id last."""
    spec, kind = tokenizer_spec(tokenizer), id_type(tokenizer)

    def run(batches):
        enc = encoder(spec, end_id)
        for batch in batches:
            for first, ids, ends in enc.encode(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ends)), binary_rows(ends, ids, kind)], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def id_type(tokenizer: str) -> str:
    spec = json.loads(tokenizer_spec(tokenizer))
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def frequency_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling frequency, ties by id. The counts have one row per id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                seen = np.bincount(np.frombuffer(value.as_buffer(), kind))
                if len(seen) > len(total):
                    seen[: len(total)] += total
                    total = seen
                else:
                    total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], np.uint32)


def write_corpus(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> list[dict]:
    """Write all documents; returns the manifest."""
    kind, folder = id_type(tokenizer), qualified(docs.sparkSession, folder)
    tokens = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    ids_by_rank = frequency_ranks(tokens, kind)
    rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    write_file(f"{folder}/ranks", ids_by_rank.astype("<u4").tobytes())

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        held, ids_held, docs_in, ids_in, out = [], 0, 0, 0, None
        path = f"{folder}/{name}"

        def flush():
            col = pa.chunked_array([h["doc_id"] for h in held]).combine_chunks()
            counts = np.concatenate([h["counts"] for h in held])
            write_block(out, col.fill_null(0).to_numpy(), col.is_null().to_numpy(zero_copy_only=False), counts, rank[np.concatenate([h["ids"] for h in held])])
            held.clear()

        with open_output(path) as late:
            for batch in batches:
                values = batch.column("ids").to_pylist()
                counts = np.array([len(v) for v in values]) // np.dtype(kind).itemsize
                a = 0
                while a < len(values):  # about BLOCK_IDS ids at a time
                    b = a + max(1, int(np.searchsorted(np.cumsum(counts[a:]), BLOCK_IDS)))
                    out = late()
                    held.append({"doc_id": batch.column("doc_id").slice(a, b - a), "counts": counts[a:b], "ids": np.frombuffer(b"".join(values[a:b]), kind)})
                    docs_in += len(counts[a:b])
                    ids_in += int(counts[a:b].sum())
                    ids_held += int(counts[a:b].sum())
                    if ids_held >= BLOCK_IDS:
                        flush()
                        ids_held = 0
                    a = b
            if held:
                flush()
        if docs_in:
            yield pa.RecordBatch.from_pylist([{"file": name, "docs": docs_in, "ids": ids_in}], pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    files = sorted(ordered.mapInArrow(run, "file string, docs bigint, ids bigint").collect(), key=lambda r: r["file"])
    manifest, ids, seen = [], 0, 0
    for r in files:
        manifest.append({"file": r["file"], "ids_before": ids, "docs_before": seen, "ids": r["ids"], "docs": r["docs"]})
        ids, seen = ids + r["ids"], seen + r["docs"]
    write_file(f"{folder}/manifest", "".join(json.dumps(m) + "\n" for m in manifest).encode())
    return manifest


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    folder = qualified(spark, folder)
    fs, path = open_fs(f"{folder}/manifest")
    with fs.open_input_stream(path) as f:
        manifest = [json.loads(x) for x in f.read().decode().splitlines()]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def run(batches):
        fs, path = open_fs(f"{folder}/ranks")
        with fs.open_input_stream(path) as f:
            ids_by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(f"{folder}/{row['file']}")
                before = row["ids_before"]
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for doc_ids, null, counts, values in read_blocks(f):
                        ends = np.cumsum(counts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, mask=null > 0), pa.array(before + ends - counts), pa.array(counts), binary_rows(ends, ids_by_rank[values], "<u4")],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        before += int(ends[-1])

    files = spark.createDataFrame([(m["file"], m["ids_before"]) for m in manifest], "file string, ids_before bigint")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written in ascending doc_id order and read back."""
    import public_tokenizers

    folder = work_path(spark, "token-files")
    write_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_corpus(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
