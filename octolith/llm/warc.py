"""WARC archives with a globally ordered capture index.

Pages are dealt by payload digest. Of equal payloads of at least a threshold's bytes the one with the largest page_id is
written as a response, the others as revisits that refer to it. Every task writes one archive (a gzip member per record)
and index runs: captures sorted by URL key, timestamp and page, RUN_ROWS to a run.

The index is an external merge. A run file is split at common boundary keys into ranges, each reachable by offset. Tasks
merge FAN_IN runs at a time with a loser tree, range by range, until few runs are left; the last merge of each range gives
part files whose order is global: all keys of a part precede those of the next. Boundaries come from a bounded sample of
keys and decide only how even the parts are. Since they are whole keys, with page and place in the archives, captures of
one frequent URL are spread over parts too.

Records are read back by index, each from its archive at its offset.

Defined results: a null html is empty, a null url is the empty URL; a null page_id is never referred to unless all pages
of its payload have none, and rows that share the page_id referred to are all responses; an empty table gives no archives
and an empty index; other columns are ignored, whatever their names. Pages without a capture time get EPOCH.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import about, open_fs, open_output
from octolith.session import materialize, qualified, work_path

EPOCH = "2024-01-01T00:00:00Z"
#: Captures to a run, runs to a merge, keys sampled for boundaries.
RUN_ROWS, FAN_IN, SAMPLE = 100_000, 32, 4096
LINE = struct.Struct("<I")
CAPTURE = "urlkey string, timestamp string, page_id bigint, record_type string, digest string, file string, offset bigint, size bigint"


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then the path and query, all in lower case and without scheme, user, port, fragment."""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", "?" + query
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash + path).lower()


def record_id(page_id, file: str, offset: int) -> str:
    """Unique for each record, whatever the page_id: by its place in the archives."""
    return f"<urn:page:{page_id}:{file}:{offset}>"


def record(place: tuple[str, int], page_id, url: str, date: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record at a place (archive, offset); a revisit holds no payload but its length and digest."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, *place)}", f"X-Page-ID: {page_id}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields (lower-case names), record type and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields | {"payload": rest[: int(fields["content-length"])]}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """k-way merge: inner nodes hold losers, the winner is at the top, a step replays one path."""

    def __init__(self, streams):
        self.streams = [iter(s) for s in streams]
        self.k = max(1, len(self.streams))
        self.heads = [next(s, None) for s in self.streams] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self.replay(i)

    def less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits here for its rival
                self.tree[node] = i
                return
            if self.less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.heads[win := self.tree[0]] is not None:
            yield self.heads[win]
            self.heads[win] = next(self.streams[win], None)
            self.replay(win)


def sort_key(row: dict) -> list:
    """Text and numbers that order captures: URL key, time, page (null first), place."""
    page = row["page_id"]
    return [row["urlkey"], row["timestamp"], [0, 0] if page is None else [1, page], row["file"], row["offset"]]


def write_run(uri: str, ordered, boundaries: list[list]) -> None:
    """A run: captures (key, row) in order as length-prefixed JSON, then the offsets of its ranges and their number."""
    starts, at, size = [0], 0, 0
    with open_output(uri) as late:
        out = late()
        for key, row in ordered:
            while at < len(boundaries) and key >= boundaries[at]:
                starts.append(size)
                at += 1
            line = json.dumps(row).encode()
            out.write(LINE.pack(len(line)) + line)
            size += LINE.size + len(line)
        starts += [size] * (len(boundaries) + 2 - len(starts))
        out.write(struct.pack(f"<{len(starts)}Q", *starts) + LINE.pack(len(starts)))


def read_run(uri: str, part: int | None = None):
    """(key, row) of a range of a run, or of the whole, in order and a block at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - LINE.size)
        n = LINE.unpack(f.read(LINE.size))[0]
        f.seek(end - LINE.size - 8 * n)
        starts = struct.unpack(f"<{n}Q", f.read(8 * n))
        at, stop = (starts[0], starts[-1]) if part is None else (starts[part], starts[part + 1])
        f.seek(at)
        rest = b""
        while at < stop or rest:
            block = f.read(min(1 << 18, stop - at))
            at, rest, i = at + len(block), rest + block, 0
            while i + LINE.size <= len(rest) and i + LINE.size + (size := LINE.unpack_from(rest, i)[0]) <= len(rest):
                row = json.loads(rest[i + LINE.size : i + LINE.size + size])
                i += LINE.size + size
                yield sort_key(row), row
            rest = rest[i:]
            if not block and rest:
                raise ValueError("a run ends within a capture")


def with_roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, date, payload and refers_to (null: a response)."""
    date = F.coalesce(F.col("captured_at").cast("string"), F.lit(EPOCH)) if "captured_at" in pages.columns else F.lit(EPOCH)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), date.alias("date"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # One row per payload, written, so that the join deals both of its sides and a frequent payload is split at run time.
    stands = materialize(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper")), "payloads")
    return rows.join(stands, "digest", "left").select(
        "page_id", "url", "date", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    )


def boundaries_of(pages: DataFrame, parts: int) -> list[list]:
    """Keys that split the captures into about equal parts, from SAMPLE pages with the smallest hash."""
    rows = about(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")), SAMPLE, "page_id", "url")
    rows = rows.orderBy(F.xxhash64("page_id", "url")).limit(SAMPLE).collect()
    keys = sorted([url_key(r["url"]), EPOCH, [0, 0] if r["page_id"] is None else [1, r["page_id"]], "", 0] for r in rows)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if len(keys) >= parts else []


def write_archives(pages: DataFrame, folder: str, boundaries: list[list], least: int = 0, level: int = 1) -> list[str]:
    """Write archives and their index runs; returns the names of the runs."""

    def run(batches):
        from pyspark import TaskContext

        # Attempts of one task may run side by side, and rows may reach them in another order: each writes files of its own,
        # and only the files of the attempt that succeeds are named to the driver.
        held, names = [], []
        part = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        archive, at = f"archive-{part}.warc.gz", 0

        def spill():
            name = f"runs-0/run-{part}-{len(names):06d}"
            write_run(f"{folder}/{name}", sorted(((sort_key(r), r) for r in held), key=lambda x: x[0]), boundaries)
            names.append(name)
            held.clear()

        with open_output(f"{folder}/{archive}") as late:
            for batch in batches:
                for page, url, date, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest = base32_sha1(payload)
                    body = gzip.compress(record((archive, at), page, url, date, payload, digest, refers, refers is not None), level, mtime=0)
                    late().write(body)
                    held.append({"urlkey": url_key(url), "timestamp": date, "page_id": page, "record_type": "response" if refers is None else "revisit", "digest": digest, "file": archive, "offset": at, "size": len(body)})
                    at += len(body)
                    if len(held) >= RUN_ROWS:
                        spill()
        if held:
            spill()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])

    return sorted(r["name"] for r in with_roles(pages, least).mapInArrow(run, "name string").collect())


def merge_runs(spark: SparkSession, folder: str, runs: list[str], boundaries: list[list], fan_in: int = FAN_IN) -> DataFrame:
    """The globally ordered capture index: CAPTURE columns and part; parts are in order, and so are the rows of a part."""
    level = 0
    while len(runs) > fan_in:
        level += 1
        groups = [(f"runs-{level}/run-{k:06d}", runs[a : a + fan_in]) for k, a in enumerate(range(0, len(runs), fan_in))]

        def merge(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    name = f"{row['name']}-{uuid.uuid4().hex[:12]}"
                    write_run(f"{folder}/{name}", LoserTree([read_run(f"{folder}/{x}") for x in row["runs"]]), boundaries)
                    yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        runs = sorted(r["name"] for r in spark.createDataFrame(groups, "name string, runs array<string>").repartition(len(groups)).mapInArrow(merge, "name string").collect())

    schema = pa.schema([("part", pa.int64()), ("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])

    def last(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                held = []
                for _, row in LoserTree([read_run(f"{folder}/{x}", part) for x in runs]):
                    held.append({"part": part} | row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    parts = len(boundaries) + 1
    return spark.range(0, parts if runs else 0, 1, parts).mapInArrow(last, f"part bigint, {CAPTURE}")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index names: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null in revisits).

    A response's length and digest are computed from what was read, and must agree with its header.
    """
    number = lambda x: None if x == "None" else int(x)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            at = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True))
            held, size, opened, f = [], 0, None, None
            for name, offset, length in at:
                if name != opened:
                    if f is not None:
                        f.close()
                    fs, path = open_fs(f"{folder}/{name}")
                    opened, f = name, fs.open_input_file(path)
                f.seek(offset)
                x = parse(zlib.decompress(f.read(length), 31))
                bare = x["warc-payload-digest"].removeprefix("sha1:")
                revisit = x["warc-type"] == "revisit"
                if not revisit and (base32_sha1(x["payload"]) != bare or len(x["payload"]) != int(x["x-payload-length"])):
                    raise ValueError(f"{name} is damaged at {offset}")
                held.append({
                    "page_id": number(x["x-page-id"]), "url": x["warc-target-uri"], "record_type": x["warc-type"], "refers_to": number(x["x-refers-to-page-id"]) if revisit else None,
                    "payload_bytes": int(x["x-payload-length"]), "payload_digest": bare, "payload": None if revisit else x["payload"],
                })
                size += len(x["payload"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if f is not None:
                f.close()
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    columns = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    # Whole archives to a task, read from front to back. The index is small beside what it names, so that the number of
    # tasks is fixed here rather than by the index's bytes.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("file", "offset", "size").repartition(tasks, "file").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, columns)


def write_and_index(pages: DataFrame, folder: str, parts: int | None = None, least: int = 0) -> DataFrame:
    """Archive pages (page_id, url, html and perhaps captured_at) under folder; returns the merged index."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    boundaries = boundaries_of(pages, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return merge_runs(spark, folder, write_archives(pages, folder, boundaries, least), boundaries)


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, indexed, and read back by the index."""
    folder = work_path(spark, "warc")
    records = read_records(write_and_index(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), nibbles AS (
  SELECT DISTINCT h, [instr('0123456789abcdef', substr(h, i + 1, 1)) - 1 for i in range(40)] || [0, 0] AS n FROM p
), digest AS (
  SELECT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((((n[1 + (5 * k) // 4] * 256) + (n[2 + (5 * k) // 4] * 16) + n[3 + (5 * k) // 4]) >> (7 - (5 * k) % 4)) & 31)::INT, 1) for k in range(32)], '') AS d
  FROM nibbles
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM p JOIN digest USING (h) WINDOW w AS (PARTITION BY h)
"""
