"""Bytes of node files: BIN, LAS, PNTS and key files, by numpy.

A batch of points is a dict of numpy arrays by column name (schema.py).
"""

from __future__ import annotations

import itertools
import json
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np

from octolith import schema

Points = dict[str, np.ndarray]


def count(points: Points) -> int:
    return len(points["x"])


def attributes_in(points: Points) -> frozenset[str]:
    return frozenset(a.token for a in schema.ATTRIBUTES if all(c in points for c, _ in a.columns))


def interleaved(points: Points, a: schema.Attribute) -> np.ndarray:
    return np.stack([np.asarray(points[c]) for c, _ in a.columns], axis=1).astype(a.numpy)


# BIN: mask of attributes, count, then one block per attribute


def encode_bin(points: Points, compress: bool = False) -> bytes:
    """No points are an error, as a node without any isn't written."""
    if not count(points):
        raise ValueError("no points selected")
    have = attributes_in(points)
    mask = sum(1 << schema.BY_TOKEN[t].bit for t in have if schema.BY_TOKEN[t].bit is not None)
    blocks = [interleaved(points, schema.BY_TOKEN[t]).tobytes() for t in schema.BIN_ORDER if t in have]
    body = struct.pack("<IQ", mask, count(points)) + b"".join(blocks)
    return zlib.compress(body, 1) if compress else body


def decode_bin(data: bytes, compressed: bool = False) -> Points:
    data = zlib.decompress(data) if compressed else data
    mask, n = struct.unpack_from("<IQ", data)
    at, out = 12, {}
    for token in schema.BIN_ORDER:
        a = schema.BY_TOKEN[token]
        if a.bit is None or mask >> a.bit & 1:
            width = len(a.columns)
            block = np.frombuffer(data, a.numpy, n * width, at).reshape(n, width)
            at += block.nbytes
            out |= {c: block[:, k] for k, (c, _) in enumerate(a.columns)}
    return out


# LAS 1.0 to 1.4, point formats 0 to 3 and what 6 to 8 share


HEADER = "<4sHH16sBB32s32sHHHIIBHI5I12d"
SIGNATURE = b"LASF"


def record_type(point_format: int, length: int) -> np.dtype:
    """Fields of a point record; bytes beyond the known fields are passed over (public LAS specification)."""
    if point_format <= 5:
        fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
        if point_format in (1, 3, 4, 5):
            fields.append(("gps_time", "<f8"))
        if point_format in (2, 3, 5):
            fields.append(("rgb", "<u2", (3,)))
    elif point_format <= 8:
        fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
        if point_format in (7, 8):
            fields.append(("rgb", "<u2", (3,)))
    else:
        raise ValueError(f"point format {point_format} isn't supported")
    base = np.dtype(fields)
    if length < base.itemsize:
        raise ValueError("point records are too short for their format")
    return base if length == base.itemsize else np.dtype([*fields, ("rest", f"V{length - base.itemsize}")])


def las_header(data: bytes) -> dict:
    """Counts, bounds, scale and layout from the first bytes of a file."""
    if len(data) < 227 or data[:4] != SIGNATURE:
        raise ValueError("not a LAS file")
    h = struct.unpack_from(HEADER, data)
    major, minor = h[4], h[5]
    offset, fmt, length, n = h[11], h[13], h[14], h[15]
    if fmt & 0xC0:
        raise ValueError("LAZ files can't be read: no LASzip here")
    if (major, minor) >= (1, 4) and len(data) >= 255:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    d = h[21:33]
    return {
        "version": (major, minor), "point_offset": offset, "point_format": fmt, "record_length": length, "n_points": n, "scale": d[0:3], "offset": d[3:6],
        "low": (d[7], d[9], d[11]), "high": (d[6], d[8], d[10]),
    }


def decode_las(data: bytes, header: dict, attributes=None) -> Points:
    """Records to columns; only what is asked for is decoded. Positions are held within the header's bounds."""
    r = np.frombuffer(data, record_type(header["point_format"], header["record_length"]))
    wanted = set(attributes or schema.ALL) | {"POSITION"}
    out: Points = {}
    for k, (c, f) in enumerate(zip("xyz", "XYZ", strict=True)):
        out[c] = np.clip(r[f] * header["scale"][k] + header["offset"][k], header["low"][k], header["high"][k])
    old = header["point_format"] <= 5
    have = schema.las_attributes(header["point_format"]) | ({"GPS_TIME"} if "gps_time" in r.dtype.names else set())
    take = {
        "RGB": lambda: {c: (r["rgb"][:, k] >> 8).astype(np.int16) for k, c in enumerate("rgb")}, "INTENSITY": lambda: {"intensity": r["intensity"].astype(np.int32)},
        "CLASSIFICATION": lambda: {"classification": (r["classification"] & (31 if old else 255)).astype(np.int16)},
        "EDGE_OF_FLIGHT_LINE": lambda: {"edge_of_flight_line": (r["flags"] >> 7).astype(np.int16)}, "GPS_TIME": lambda: {"gps_time": r["gps_time"].astype(np.float64)},
        "NUMBER_OF_RETURNS": lambda: {"number_of_returns": ((r["flags"] >> 3 & 7) if old else r["returns"] >> 4).astype(np.int16)},
        "RETURN_NUMBER": lambda: {"return_number": ((r["flags"] & 7) if old else r["returns"] & 15).astype(np.int16)},
        "POINT_SOURCE_ID": lambda: {"point_source_id": r["point_source_id"].astype(np.int32)}, "SCAN_DIRECTION_FLAG": lambda: {"scan_direction_flag": (r["flags"] >> 6 & 1).astype(np.int16)},
        "SCAN_ANGLE_RANK": lambda: {"scan_angle_rank": r["scan_angle_rank"] if old else np.clip(np.round(r["scan_angle"] * 0.006), -90, 90).astype(np.int8)},
        "USER_DATA": lambda: {"user_data": r["user_data"].astype(np.int16)},
    }
    for token, get in take.items():
        if token in wanted & have:
            out |= get()
    return out


def las_scale(low, high) -> float:
    """K3 for one box."""
    diagonal = float(np.sqrt(sum((b - a) ** 2 for a, b in zip(low, high, strict=True))))
    return 0.01 if diagonal > 1e6 else 0.001 if diagonal > 1 else 0.0001


def encode_las(points: Points, low, high, scale: float | None = None) -> bytes:
    """LAS 1.2 with the bounds in the header and the offset at their low corner (K2)."""
    return las_start(points, low, high, count(points), scale) + las_records(points, low, high, scale)


def _las_kind(have: frozenset[str]) -> tuple[int, np.dtype]:
    """Point format and record that hold these attributes."""
    fmt = ("GPS_TIME" in have) + 2 * ("RGB" in have)
    return fmt, record_type(fmt, 20 + 8 * ("GPS_TIME" in have) + 6 * ("RGB" in have))


def las_start(points: Points, low, high, n: int, scale: float | None = None) -> bytes:
    """The header of n points of which these are some (or none, with their columns)."""
    fmt, kind = _las_kind(attributes_in(points))
    s = scale or las_scale(low, high)
    box = [v for a, b in zip(low, high, strict=True) for v in (b, a)]
    return struct.pack(HEADER, SIGNATURE, 0, 0, b"\0" * 16, 1, 2, b"octolith", b"octolith", 1, 2024, 227, 227, 0, fmt, kind.itemsize, n, n, 0, 0, 0, 0, s, s, s, *low, *box)


def las_records(points: Points, low, high, scale: float | None = None) -> bytes:
    """The records that follow the header."""
    n, have = count(points), attributes_in(points)
    kind = _las_kind(have)[1]
    s = scale or las_scale(low, high)
    r = np.zeros(n, kind)
    for k, (c, f) in enumerate(zip("xyz", "XYZ", strict=True)):
        r[f] = np.round((np.asarray(points[c]) - low[k]) / s)
    get = lambda c: np.asarray(points[c]).astype(np.int64) if c in points else np.zeros(n, np.int64)
    r["flags"] = (get("return_number") & 7) | (get("number_of_returns") & 7) << 3 | (get("scan_direction_flag") & 1) << 6 | (get("edge_of_flight_line") & 1) << 7
    for f in ("intensity", "classification", "scan_angle_rank", "user_data", "point_source_id"):
        r[f] = get(f)
    if "GPS_TIME" in have:
        r["gps_time"] = points["gps_time"]
    if "RGB" in have:
        r["rgb"] = np.stack([get(c) << 8 for c in "rgb"], axis=1)
    return r.tobytes()


# PNTS: header, feature table in JSON padded with spaces, aligned binary body


#: Feature names, types and alignments (fixed values).
FEATURES = [("POSITION", "POSITION", "<f4", 4), ("RGB", "RGB", "u1", 1), ("INTENSITY", "INTENSITY", "<u2", 2), ("CLASSIFICATION", "CLASSIFICATION", "u1", 1)]


def padded(body: bytes, to: int, fill: bytes, before: int = 0) -> bytes:
    return body + fill * (-(before + len(body)) % to)


def encode_pnts(points: Points, centre=(0.0, 0.0, 0.0)) -> bytes:
    """Positions in single precision; what the format has no place for is left out (K4)."""
    if not count(points):
        raise ValueError("no points selected")
    table: dict = {"POINTS_LENGTH": count(points), "RTC_CENTER": list(map(float, centre))}
    body, have = b"", attributes_in(points)
    for token, name, kind, alignment in FEATURES:
        if token in have:
            body = padded(body, alignment, b"\0")
            table[name] = {"byteOffset": len(body)}
            body += interleaved(points, schema.BY_TOKEN[token]).astype(kind).tobytes()
    head = padded(json.dumps(table, separators=(",", ":")).encode(), 8, b" ", 28)
    body = padded(body, 8, b"\0")
    return struct.pack("<4s6I", b"pnts", 1, 28 + len(head) + len(body), len(head), len(body), 0, 0) + head + body


def decode_pnts(data: bytes) -> tuple[Points, tuple[float, ...]]:
    """(points, centre); the centre isn't added to the positions."""
    magic, version, _, table_size, body_size, _, _ = struct.unpack_from("<4s6I", data)
    if magic != b"pnts" or version != 1:
        raise ValueError("not a PNTS file")
    table = json.loads(data[28 : 28 + table_size])
    body, n, out = data[28 + table_size : 28 + table_size + body_size], table["POINTS_LENGTH"], {}
    for token, name, kind, _ in FEATURES:
        if name in table:
            columns = schema.BY_TOKEN[token].columns
            block = np.frombuffer(body, kind, n * len(columns), table[name]["byteOffset"]).reshape(n, len(columns))
            out |= {c: block[:, k].astype(np.float64 if token == "POSITION" else np.int32) for k, (c, _) in enumerate(columns)}
    return out, tuple(table.get("RTC_CENTER", (0.0, 0.0, 0.0)))


# Nodes larger than a task should hold


class Spool:
    """A node's file from points that come in shares: what is known of each share waits in temporary files of this machine."""

    COPY = 1 << 22

    def __init__(self, fmt: str):
        self.fmt, self.parts, self.deflate = fmt, {}, zlib.compressobj(1) if fmt == "BINZ" else None

    def add(self, points: Points, low, high) -> None:
        if self.fmt in ("LAS", "ENTWINE_LAS"):
            self.put("records", las_records(points, low, high))
        elif self.fmt == "3DTILES":
            for token, _, kind, _ in FEATURES:
                if token in attributes_in(points):
                    self.put(token, interleaved(points, schema.BY_TOKEN[token]).astype(kind).tobytes())
        else:
            for token in schema.BIN_ORDER:
                if token in attributes_in(points):
                    self.put(token, interleaved(points, schema.BY_TOKEN[token]).tobytes())

    def put(self, part: str, data: bytes) -> None:
        if part not in self.parts:
            self.parts[part] = tempfile.TemporaryFile()
        self.parts[part].write(data)

    def read(self, part: str) -> Iterator[bytes]:
        f = self.parts[part]
        f.seek(0)
        while data := f.read(self.COPY):
            yield data

    def file(self, points: Points, n: int, low, high, centre) -> Iterator[bytes]:
        """The whole file of n points; points: the last share, which may be empty but has the columns."""
        have = attributes_in(points)
        if self.fmt in ("LAS", "ENTWINE_LAS"):
            yield las_start(points, low, high, n)
            yield from self.read("records")
        elif self.fmt == "3DTILES":
            table, at, gaps = {"POINTS_LENGTH": n, "RTC_CENTER": list(map(float, centre))}, 0, {}
            for token, name, kind, alignment in FEATURES:
                if token in have:
                    gaps[token] = -at % alignment
                    table[name] = {"byteOffset": at + gaps[token]}
                    at += gaps[token] + n * len(schema.BY_TOKEN[token].columns) * np.dtype(kind).itemsize
            head = padded(json.dumps(table, separators=(",", ":")).encode(), 8, b" ", 28)
            yield struct.pack("<4s6I", b"pnts", 1, 28 + len(head) + at + -at % 8, len(head), at + -at % 8, 0, 0) + head
            for token, gap in gaps.items():
                yield b"\0" * gap
                yield from self.read(token)
            yield b"\0" * (-at % 8)
        else:
            mask = sum(1 << schema.BY_TOKEN[t].bit for t in have if schema.BY_TOKEN[t].bit is not None)
            body = itertools.chain([struct.pack("<IQ", mask, n)], *(self.read(t) for t in schema.BIN_ORDER if t in have))
            if self.deflate is None:
                yield from body
            else:
                for data in body:
                    yield self.deflate.compress(data)
                yield self.deflate.flush()

    def close(self) -> None:
        for f in self.parts.values():
            f.close()


# Key files


def encode_keys(keys: np.ndarray, levels: int = 21) -> bytes:
    return struct.pack("<4sIQ", b"indx", levels, len(keys)) + np.asarray(keys).astype("<u8").tobytes()


def decode_keys(data: bytes) -> tuple[np.ndarray, int]:
    magic, levels, n = struct.unpack_from("<4sIQ", data)
    if magic != b"indx":
        raise ValueError("not a key file")
    return np.frombuffer(data, "<u8", n, 16).astype(np.int64), levels
