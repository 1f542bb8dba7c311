"""Morton keys and octree node keys as Column expressions.

Octants are x<<2 | y<<1 | z. A key holds `levels` octants (21 at most: 63 bits, never negative), the root's in the most
significant bits. A node is (idx, lvl): the first lvl octants of the keys below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 21
#: Bits of a number that one table lookup spreads by 3, and octants whose bits one lookup gathers.
SPREAD_BITS, GATHER_OCTANTS = 7, 3


def _col(c) -> Column:
    return F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c


def shl(v, n) -> Column:
    """Shift by a number or a column of numbers."""
    return F.shiftleft(v, n) if isinstance(n, int) else F.call_function("shiftleft", v, n.cast("int"))


def shr(v, n) -> Column:
    return F.shiftright(v, n) if isinstance(n, int) else F.call_function("shiftright", v, n.cast("int"))


def _table(values: list[int]) -> Column:
    """A literal array, parsed in one piece and folded when the query is planned."""
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def _spread(n: int) -> int:
    return sum((n >> i & 1) << 3 * i for i in range(n.bit_length()))


def _gathered(n: int) -> int:
    return sum((n >> 3 * i & 1) << i for i in range(GATHER_OCTANTS))


def expand(v) -> Column:
    """Bit i to bit 3i, for numbers of 21 bits (M1). Lookups keep the expression linear in its argument."""
    v = _col(v).cast("bigint")
    table, mask = _table([_spread(n) for n in range(1 << SPREAD_BITS)]), F.lit((1 << SPREAD_BITS) - 1)
    parts = [shl(F.get(table, shr(v, k).bitwiseAND(mask).cast("int")), 3 * k) for k in range(0, LEVELS, SPREAD_BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def contract(v) -> Column:
    """Bit 3i to bit i (M2)."""
    v, width = _col(v).cast("bigint"), 3 * GATHER_OCTANTS
    table, mask = _table([_gathered(n) for n in range(1 << width)]), F.lit((1 << width) - 1)
    parts = [shl(F.get(table, shr(v, 3 * k).bitwiseAND(mask).cast("int")), k) for k in range(0, LEVELS, GATHER_OCTANTS)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def cell(p: Column, low: float, extent: float, levels: int = LEVELS) -> Column:
    """Cell number along an axis; positions outside are clamped to the bounds. A cube without extent has one cell."""
    if extent <= 0:
        return F.lit(0).cast("bigint")
    q = ((F.greatest(_col(p), F.lit(low)) - F.lit(low)) * F.lit(2.0**levels / extent)).cast("bigint")
    return F.least(q, F.lit(2**levels - 1))


def interleave(x: Column, y: Column, z: Column) -> Column:
    return expand(z).bitwiseOR(shl(expand(y), 1)).bitwiseOR(shl(expand(x), 2))


def encode(x, y, z, bounds, levels: int = LEVELS) -> Column:
    """Key of a position in cubic bounds (M3, M5, M6)."""
    return interleave(*(cell(p, low, bounds.extent, levels) for p, low in zip((x, y, z), bounds.low, strict=True)))


def encode_naive(x, y, z, bounds, levels: int = LEVELS) -> Column:
    """The same key by descending octant by octant (M4)."""
    low, half = [F.lit(v) for v in bounds.low], bounds.extent / 2
    state = F.struct(F.lit(0).cast("bigint").alias("k"), *(v.alias(n) for v, n in zip(low, "xyz", strict=True)), F.lit(half).alias("h"))

    def step(s, _):
        hit = {n: (_col(p) >= s[n] + s["h"]).cast("bigint") for n, p in zip("xyz", (x, y, z), strict=True)}
        octant = shl(hit["x"], 2).bitwiseOR(shl(hit["y"], 1)).bitwiseOR(hit["z"])
        return F.struct(shl(s["k"], 3).bitwiseOR(octant).alias("k"), *((s[n] + hit[n] * s["h"]).alias(n) for n in "xyz"), (s["h"] / 2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state, step)["k"]


def octant_of(x, y, z, low: Sequence, extent) -> Column:
    """Octant of a position in a node's bounds."""
    bit = lambda p, a: F.greatest(F.lit(0), F.least(F.lit(1), ((_col(p) - a) * 2 / extent).cast("int")))
    bx, by, bz = (bit(p, a) for p, a in zip((x, y, z), low, strict=True))
    return shl(bx, 2).bitwiseOR(shl(by, 1)).bitwiseOR(bz)


# Fixed-depth keys


def octant_at(key, level: int, levels: int = LEVELS) -> Column:
    """Octant at a level from 0 (M7)."""
    return shr(_col(key), 3 * (levels - 1 - level)).bitwiseAND(F.lit(7)).cast("int")


def set_octant(key, level: int, octant, levels: int = LEVELS) -> Column:
    """The octant's bits added at a level; bits that are there stay (M8)."""
    return _col(key).bitwiseOR(shl(_col(octant).cast("bigint"), 3 * (levels - 1 - level)))


def truncate(key, level: int, levels: int = LEVELS) -> Column:
    """The first level + 1 octants, shifted down; level -1 is the root (M9)."""
    return F.lit(0).cast("bigint") if level < 0 else shr(_col(key), 3 * (levels - 1 - level))


def from_value(v, levels: int = LEVELS) -> Column:
    """A number as a key: the bits that the levels can hold."""
    return _col(v).cast("bigint").bitwiseAND(F.lit(2 ** (3 * levels) - 1))


def from_octants(octants: Sequence, levels: int = LEVELS) -> Column:
    """The key of these octants, the rest zero."""
    key = reduce(lambda k, o: shl(k, 3).bitwiseOR(_col(o).cast("bigint")), octants, F.lit(0).cast("bigint"))
    return shl(key, 3 * (levels - len(octants)))


def octal(v: Column, digits) -> Column:
    """Octal digits of a non-negative number; no digits for none."""
    digits = _col(digits)
    return F.when(digits == 0, F.lit("")).otherwise(F.lpad(F.conv(v.cast("string"), 10, 8), digits, F.lit("0")))


def to_string(key, n: int = LEVELS, levels: int = LEVELS, prefix: str = "") -> Column:
    """The first n octants as digits."""
    return F.concat(F.lit(prefix), octal(truncate(key, n - 1, levels), n))


def from_string(name, levels: int = LEVELS) -> Column:
    """Key from octant digits, an r before them ignored, digits beyond the depth cut; null for other strings."""
    digits = F.substring(F.regexp_replace(_col(name), "^r", ""), 1, levels)
    value = F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 8, 10).cast("bigint"))
    return F.when(digits.rlike("^[0-7]*$"), shl(value, (3 * (levels - F.length(digits))).cast("int")))


# Node keys


def node_of(key, lvl: int) -> Column:
    """idx of the node with lvl octants that a key is in."""
    return truncate(key, lvl - 1)


def common(a, la, b, lb) -> tuple[Column, Column]:
    """Both indices at the shallower level."""
    a, la, b, lb = map(_col, (a, la, b, lb))
    least = F.least(la, lb)
    return shr(a, (3 * (la - least)).cast("int")), shr(b, (3 * (lb - least)).cast("int"))


def node_less(a, la, b, lb) -> Column:
    x, y = common(a, la, b, lb)
    return x < y


def node_less_equal(a, la, b, lb) -> Column:
    x, y = common(a, la, b, lb)
    return x <= y


def node_equal(a, la, b, lb) -> Column:
    return (_col(a) == _col(b)) & (_col(la) == _col(lb))


def is_descendant(a, la, b, lb) -> Column:
    """a lies below b or is b."""
    x, y = common(a, la, b, lb)
    return (x == y) & (_col(la) >= _col(lb))


def node_octant(idx, lvl, level) -> Column:
    """Octant at a level from 1; 0 for the root's level."""
    idx, lvl, level = map(_col, (idx, lvl, level))
    return F.when(level < 1, F.lit(0)).otherwise(shr(idx, (3 * (lvl - level)).cast("int")).bitwiseAND(F.lit(7))).cast("int")


def parent(idx, lvl) -> Column:
    """idx of the parent; null for the root."""
    return F.when(_col(lvl) > 0, shr(_col(idx), 3))


def parent_at(idx, lvl, level) -> Column:
    """idx of the ancestor at a level; null where the level is deeper."""
    idx, lvl, level = map(_col, (idx, lvl, level))
    return F.when(level <= lvl, shr(idx, (3 * (lvl - level)).cast("int")))


def sibling(idx, lvl, octant) -> Column:
    """The parent's child in an octant; null for the root."""
    return F.when(_col(lvl) > 0, shl(shr(_col(idx), 3), 3).bitwiseOR(_col(octant).cast("bigint")))


def child(idx, lvl, octant) -> Column:
    """null at the greatest depth."""
    return F.when(_col(lvl) < LEVELS, shl(_col(idx), 3).bitwiseOR(_col(octant).cast("bigint")))


def to_static(idx, lvl) -> Column:
    """The least key below a node."""
    return shl(_col(idx), (3 * (LEVELS - _col(lvl))).cast("int"))


def to_grid(idx) -> tuple[Column, Column, Column]:
    """Cell numbers of a node in its level's grid."""
    idx = _col(idx)
    return contract(shr(idx, 2)), contract(shr(idx, 1)), contract(idx)


def grid_arrays(idx: np.ndarray) -> list[np.ndarray]:
    """The same for an array of nodes."""
    out = []
    for k in (2, 1, 0):
        v = (idx >> k) & 0x1249249249249249
        for step, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
            v = (v ^ (v >> step)) & mask
        out.append(v)
    return out


def from_grid(x, y, z) -> Column:
    return interleave(_col(x), _col(y), _col(z))


def name_simple(idx, lvl) -> Column:
    return octal(_col(idx), lvl)


def name_potree(idx, lvl) -> Column:
    return F.concat(F.lit("r"), name_simple(idx, lvl))


def name_entwine(idx, lvl) -> Column:
    return F.concat_ws("-", _col(lvl), *to_grid(idx))


def parse_simple(name) -> tuple[Column, Column]:
    """(idx, lvl); null for strings that are no name of 21 levels at most."""
    name = _col(name)
    ok = name.rlike("^[0-7]{0,21}$")
    return F.when(ok, F.when(name == "", F.lit(0)).otherwise(F.conv(name, 8, 10).cast("bigint"))).cast("bigint"), F.when(ok, F.length(name))


def parse_potree(name) -> tuple[Column, Column]:
    """As parse_simple, after an r; the r doesn't count towards the depth."""
    idx, lvl = parse_simple(F.substring(_col(name), 2, 100))
    ok = F.substring(_col(name), 1, 1) == "r"
    return F.when(ok, idx), F.when(ok, lvl)


def parse_entwine(name) -> tuple[Column, Column]:
    """D-X-Y-Z; null unless D is 21 at most and the cells exist at that depth."""
    part = lambda k: F.try_element_at(F.split(_col(name), "-"), F.lit(k)).try_cast("bigint")
    d, x, y, z = (part(k) for k in (1, 2, 3, 4))
    size = shl(F.lit(1).cast("bigint"), F.least(d, F.lit(21)).cast("int"))
    ok = _col(name).rlike(r"^\d{1,2}(-\d{1,7}){3}$") & (d <= LEVELS) & (x < size) & (y < size) & (z < size)
    return F.when(ok, from_grid(x, y, z)), F.when(ok, d.cast("int"))


def potree_to_entwine(name) -> Column:
    """null for strings that are no name."""
    idx, lvl = parse_potree(name)
    return F.when(idx.isNotNull(), name_entwine(idx, lvl))


# Octant lists of any depth


def octants_of(name) -> Column:
    """Octant digits as an array."""
    name = _col(name)
    return F.when(name == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(name, ""), lambda c: c.cast("int")))


def list_name(octants, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.transform(_col(octants), lambda o: o.cast("string")), ""))


def list_depth(octants) -> Column:
    return F.size(_col(octants))


def list_child(octants, octant) -> Column:
    return F.concat(_col(octants), F.array(_col(octant).cast("int")))


def list_parent(octants) -> Column:
    """null for the root."""
    o = _col(octants)
    return F.when(F.size(o) > 0, F.slice(o, 1, F.size(o) - 1))


def list_truncate(octants, depth) -> Column:
    return F.slice(_col(octants), F.lit(1), F.least(_col(depth), F.size(_col(octants))))


def list_to_static(octants) -> Column:
    """null beyond 21 levels."""
    o = _col(octants)
    value = F.aggregate(o, F.lit(0).cast("bigint"), lambda k, x: shl(k, 3).bitwiseOR(x.cast("bigint")))
    return F.when(F.size(o) <= LEVELS, shl(value, (3 * (LEVELS - F.size(o))).cast("int")))


def previous_power_of_two(v) -> Column:
    """The greatest power of two that isn't greater; 0 for 0."""
    v = _col(v).cast("bigint")
    for k in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(shr(v, k))
    return v - shr(v, 1)
