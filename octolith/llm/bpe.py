"""BPE encoding and decoding through a table of distinct words.

Split: every task cuts its texts into words (see units.py), numbers the distinct words of a chunk of CHUNK_WORDS or so, and
emits packed rows: of documents with their words' numbers in order, and, per bucket of words, of words with numbers. One
exchange deals document rows by chunk and word rows by bucket.
Encode: each word meets in its bucket all chunks that have it and is encoded once.
Join back: documents and encoded words of a chunk meet by chunk, and ids go to the words' positions by number.
Decode: ids are joined to the table of pieces, whose key is dense, so that the join is a gather.

A word crosses the network once per chunk, however often it occurs; a chunk is bounded in distinct words and in bytes,
whatever the input's size, but for a single text that is longer. A lost
task numbers its chunks again in the same way, since chunks are named by partition and order.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that share a doc_id and null doc_ids
are encoded each for itself; a text of any length is encoded whole; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import release_memory
from octolith.llm.token_files import binary_rows
from octolith.llm.units import byte_letters, load_tokenizer, plain_pattern, spread, text_slices, tokenizer_spec, units_of

#: Distinct words, or bytes of text, at which a chunk is closed.
CHUNK_WORDS, CHUNK_BYTES = 120_000, 64 << 20


def planes(codes: np.ndarray) -> bytes:
    """32-bit numbers, lowest bytes of all first; higher bytes compress well."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(*parts: bytes) -> bytes:
    """Byte strings as one, compressed."""
    return zstandard.compress(struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts), 3)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def pack_words(words: list[bytes], numbers: np.ndarray) -> bytes:
    return pack(planes(numbers), planes(np.array([len(w) for w in words])), b"".join(words))


def unpack_words(blob: bytes) -> tuple[list[bytes], bytes]:
    """Words and their packed numbers."""
    numbers, sizes, body = unpack(blob)
    ends = np.cumsum(from_planes(sizes), dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)], numbers


def split(docs: DataFrame, buckets: int) -> DataFrame:
    """key, chunk, body: documents with key = chunk, words with key = -1 - bucket."""

    def rows_of(keys, chunk, bodies):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([chunk] * len(keys), pa.int64()), pa.array(bodies, pa.binary())], names=["key", "chunk", "body"])

    def run(batches):
        from pyspark import TaskContext

        chunk, words, size = TaskContext.get().partitionId() << 24, {}, 0

        def close():
            keys = list(words)
            if not keys:
                return
            bucket = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % buckets
            order = np.argsort(bucket, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
            rows = [order[a:b] for a, b in zip(begin, [*begin[1:], len(order)], strict=True)]
            for k in range(0, len(rows), 64):
                part = rows[k : k + 64]
                yield rows_of([-1 - int(bucket[r[0]]) for r in part], chunk, [pack_words([keys[i] for i in r], r) for r in part])

        for batch in batches:
            for first, piece in text_slices(batch.column("text")):
                found, count = units_of(piece)
                number = words.setdefault
                table = np.array([number(w, len(words)) for w in found.dictionary.to_pylist()], np.int64)
                codes = table[found.indices.to_numpy()] if len(found) else table
                ids = batch.column("doc_id").slice(first, len(piece))
                yield rows_of([chunk], chunk, [pack(ids.fill_null(0).to_numpy().tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), planes(np.diff(count)), planes(codes))])
                size += piece.nbytes
                if len(words) > CHUNK_WORDS or size > CHUNK_BYTES:
                    yield from close()
                    words, size = {}, 0
                    chunk += 1
        yield from close()
        words = found = table = codes = None
        release_memory()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, chunk bigint, body binary")


def encode_words(words: DataFrame, spec: str) -> DataFrame:
    """chunk, body (numbers, counts of ids, ids) for packed rows of words.

    Rows of a bucket come one after the other, and a word is in one bucket alone: what has been encoded is remembered to
    the end of the bucket, so that each distinct word is encoded once.
    """

    def run(batches):
        tok, known, bucket = load_tokenizer(spec), {}, None
        for batch in batches:
            for key, chunk, blob in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                words, numbers = unpack_words(blob.as_py())
                if key != bucket:
                    known, bucket = {}, key
                new = [w for w in words if w not in known]
                for a in range(0, len(new), 20_000):
                    part = new[a : a + 20_000]
                    for w, e in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                body = pack(numbers, planes(np.array([len(x) >> 2 for x in ids])), planes(np.frombuffer(b"".join(ids), "<u4")))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([body], pa.binary())], names=["chunk", "body"])
        known = words = new = ids = None
        release_memory()

    return words.sortWithinPartitions("key").mapInArrow(run, "chunk bigint, body binary")


def join_back(docs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of the documents of each chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [list(map(from_planes, unpack(blob.as_py()))) for blob in right.column("body")]
        number, size, flat = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.uint32)] * 3
        del parts
        start_of, size_of = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start_of[number], size_of[number] = np.cumsum(size, dtype=np.int64) - size, size
        doc_ids, ids = [], []
        for blob in left.column("body"):
            keys, null, counts, codes = unpack(blob.as_py())
            counts, codes = from_planes(counts).astype(np.int64), from_planes(codes)
            mask = np.unpackbits(np.frombuffer(null, np.uint8))[: len(counts)] > 0
            doc_ids.append(pa.array(np.frombuffer(keys, np.int64), mask=mask))
            sizes = size_of[codes]
            total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            ids.append(binary_rows(total[1:], flat[spread(start_of[codes], sizes)], "<u4"))
        del number, size, flat, start_of, size_of, left, right
        release_memory()
        return pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "ids": pa.chunked_array(ids, pa.binary())})

    return docs.groupBy("key").cogroup(words.groupBy("chunk")).applyInArrow(run, "doc_id bigint, ids binary")


def encode(docs: DataFrame, tokenizer: str, buckets: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text.

    Words are dealt to buckets, of which there should be more as the input grows (by default two for each shuffle
    partition); a chunk has a row for each at most. Only tokenizers that can be cut at white space are taken.
    """
    spec = tokenizer_spec(tokenizer)
    if plain_pattern(spec)[0] is None:
        raise ValueError("this tokenizer's pieces may cross white space, so that its words can't be encoded one by one")
    rows = split(docs, buckets or max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).repartition("key")
    # spark_partition_id() keeps the filters above the exchange, which both sides then read.
    of_docs, of_words = rows.where(F.expr("key >= 0 OR spark_partition_id() < 0")), rows.where(F.expr("key < 0 OR spark_partition_id() < 0"))
    return join_back(of_docs, encode_words(of_words, spec))


def piece_table(spec: str) -> pa.Array:
    """The bytes of each id's piece; ids without one have none."""
    parts = json.loads(spec)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    vocab = {i: t for t, i in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
    plain = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    return pa.array([plain(vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)], pa.binary())


def gather(table: pa.Array, values: list[bytes], between: bytes) -> list[bytes]:
    """For each binary row of ids the table's entries, joined."""
    ends = np.cumsum([len(v) >> 2 for v in values])
    entries = table.take(pa.array(np.frombuffer(b"".join(values), "<u4"))).cast(pa.large_binary())
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends]), entries)
    return pc.binary_join(lists, pa.scalar(between, pa.large_binary())).to_pylist()


def small_groups(values: list[bytes], most: int = 2 << 20):
    """Slices of values of about as many bytes."""
    a, size = 0, 0
    for b, v in enumerate(values):
        size += len(v)
        if size >= most:
            yield slice(a, b + 1)
            a, size = b + 1, 0
    if a < len(values):
        yield slice(a, len(values))


def decode(encoded: DataFrame, tokenizer: str, numbers: bool = False) -> DataFrame:
    """doc_id, ids, text and perhaps numbers (the ids in decimal, with commas between).

    Special tokens are kept, and bytes that form no character become U+FFFD.
    """
    spec = tokenizer_spec(tokenizer)

    def run(batches):
        table = piece_table(spec)
        decimals = pa.array([str(i).encode() for i in range(len(table))], pa.binary())
        for batch in batches:
            values = batch.column("ids").to_pylist()
            for part in small_groups(values):
                texts = [x.decode("utf-8", "replace") for x in gather(table, values[part], b"")]
                rows = batch.slice(part.start, part.stop - part.start)
                out = {"doc_id": rows.column("doc_id"), "ids": rows.column("ids"), "text": pa.array(texts, pa.string())}
                if numbers:
                    out["numbers"] = pa.array(gather(decimals, values[part], b","), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        values = texts = rows = out = None
        release_memory()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text string" + ", numbers string" * numbers)


def op3_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of ids and texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path, numbers=True)
    n = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("numbers", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
