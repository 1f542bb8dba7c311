"""The point schema: attributes, their columns, formats and set algebra (P8-P10, P14, P15, P17, 1.4)."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    token: str
    columns: tuple[tuple[str, str], ...]  # Spark columns and types
    numpy: str  # type of one value in binary files
    bit: int | None  # bit in the mask of node files; None: always there
    ept: tuple[tuple[str, int, str], ...]  # names, bytes and kinds in ept.json


#: Tokens, file types, mask bits and EPT names (fixed values).
ATTRIBUTES = [
    Attribute("POSITION", (("x", "double"), ("y", "double"), ("z", "double")), "<f8", None, (("X", 4, "signed"), ("Y", 4, "signed"), ("Z", 4, "signed"))),
    Attribute("RGB", (("r", "smallint"), ("g", "smallint"), ("b", "smallint")), "u1", 0, (("Red", 2, "unsigned"), ("Green", 2, "unsigned"), ("Blue", 2, "unsigned"))),
    Attribute("NORMAL", (("nx", "float"), ("ny", "float"), ("nz", "float")), "<f4", 1, (("NX", 4, "float"), ("NY", 4, "float"), ("NZ", 4, "float"))),
    Attribute("INTENSITY", (("intensity", "int"),), "<u2", 2, (("Intensity", 2, "unsigned"),)),
    Attribute("CLASSIFICATION", (("classification", "smallint"),), "u1", 3, (("Classification", 1, "unsigned"),)),
    Attribute("EDGE_OF_FLIGHT_LINE", (("edge_of_flight_line", "smallint"),), "u1", 4, (("EdgeOfFlightLine", 1, "unsigned"),)),
    Attribute("GPS_TIME", (("gps_time", "double"),), "<f8", 5, (("GpsTime", 8, "float"),)),
    Attribute("NUMBER_OF_RETURNS", (("number_of_returns", "smallint"),), "u1", 6, (("NumberOfReturns", 1, "unsigned"),)),
    Attribute("RETURN_NUMBER", (("return_number", "smallint"),), "u1", 7, (("ReturnNumber", 1, "unsigned"),)),
    Attribute("POINT_SOURCE_ID", (("point_source_id", "int"),), "<u2", 8, (("PointSourceID", 2, "unsigned"),)),
    Attribute("SCAN_DIRECTION_FLAG", (("scan_direction_flag", "smallint"),), "u1", 9, (("ScanDirectionFlag", 1, "unsigned"),)),
    Attribute("SCAN_ANGLE_RANK", (("scan_angle_rank", "tinyint"),), "i1", 10, (("ScanAngleRank", 1, "signed"),)),
    Attribute("USER_DATA", (("user_data", "smallint"),), "u1", 11, (("UserData", 1, "unsigned"),)),
]
BY_TOKEN = {a.token: a for a in ATTRIBUTES}
#: In node files the scan angle comes before the scan direction, although its bit comes after.
BIN_ORDER = [*(a.token for a in ATTRIBUTES[:10]), "SCAN_ANGLE_RANK", "SCAN_DIRECTION_FLAG", "USER_DATA"]
#: What each output format can hold.
ALL = frozenset(BY_TOKEN)
FORMATS = {"BIN": ALL, "BINZ": ALL, "LAS": ALL, "LAZ": ALL, "ENTWINE_LAS": ALL, "ENTWINE_LAZ": ALL, "3DTILES": frozenset({"POSITION", "RGB", "INTENSITY"})}
LAS_RGB_FORMATS, LAS_GPS_FORMATS = frozenset({2, 3, 5, 7, 8, 10}), frozenset({1, 3})


class IgnoreErrors(enum.IntFlag):
    """Which errors an input scan passes over."""

    NONE = 0
    INACCESSIBLE_FILES = 1
    CORRUPTED_FILES = 2
    MISSING_FILES = 4
    UNSUPPORTED_FILE_FORMAT = 8
    MISSING_POINT_ATTRIBUTES = 16
    ALL_FILE_ERRORS = INACCESSIBLE_FILES | CORRUPTED_FILES | MISSING_FILES | UNSUPPORTED_FILE_FORMAT
    ALL = ALL_FILE_ERRORS | MISSING_POINT_ATTRIBUTES

    @classmethod
    def parse(cls, tokens: str) -> IgnoreErrors:
        out = cls.NONE
        for t in tokens.replace(",", " ").split():
            try:
                out |= cls[t.upper()]
            except KeyError:
                raise ValueError(f"unknown error class {t!r}") from None
        return out


def parse_attributes(tokens: str) -> frozenset[str]:
    """Space-separated tokens as a set; an unknown one is an error."""
    out = frozenset(tokens.split())
    if unknown := out - ALL:
        raise ValueError(f"unknown attributes: {', '.join(sorted(unknown))}")
    return out


def attributes_of(df: DataFrame) -> frozenset[str]:
    """The attributes whose columns a DataFrame has."""
    have = set(df.columns)
    return frozenset(a.token for a in ATTRIBUTES if have.issuperset(c for c, _ in a.columns))


def columns_of(attributes) -> list[tuple[str, str]]:
    return [c for a in ATTRIBUTES if a.token in attributes for c in a.columns]


def las_attributes(point_format: int) -> frozenset[str]:
    """What a LAS point format offers."""
    missing = {"NORMAL"} | ({"RGB"} - ({"RGB"} if point_format in LAS_RGB_FORMATS else set())) | ({"GPS_TIME"} - ({"GPS_TIME"} if point_format in LAS_GPS_FORMATS else set()))
    return ALL - missing


def plan_attributes(offered: list[frozenset[str]], fmt: str, rgb_from: str = "NONE") -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """(input, output, dropped): what all inputs share, cut down to what the format holds."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown output format {fmt!r}")
    common = frozenset.intersection(*offered) if offered else frozenset()
    extra = {"RGB"} if fmt == "3DTILES" and rgb_from != "NONE" and "INTENSITY" in common else set()
    return common & FORMATS[fmt], (common | extra) & FORMATS[fmt], common - FORMATS[fmt]


def missing_attributes(offered: dict[str, frozenset[str]], wanted: frozenset[str], ignore: IgnoreErrors = IgnoreErrors.NONE) -> dict[str, frozenset[str]]:
    """Per file what it lacks; an error unless ignored (P10)."""
    lacks = {f: wanted - have for f, have in offered.items() if wanted - have}
    if lacks and not ignore & IgnoreErrors.MISSING_POINT_ATTRIBUTES:
        raise ValueError("missing attributes: " + "; ".join(f"{f}: {', '.join(sorted(x))}" for f, x in sorted(lacks.items())))
    return lacks


def apply_schema(df: DataFrame, attributes, keep: list[str] | None = None) -> DataFrame:
    """Drop columns of other attributes and fill new ones with zero."""
    have = set(df.columns)
    wanted = [(F.col(c) if c in have else F.lit(0)).cast(t).alias(c) for c, t in columns_of(attributes)]
    return df.select(*wanted, *(keep or []))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; what one side lacks is zero there, never null."""
    both = attributes_of(a) | attributes_of(b)
    rest = [c for c in a.columns if c in b.columns and c not in {n for n, _ in columns_of(both)}]
    return apply_schema(a, both, rest).unionByName(apply_schema(b, both, rest))
