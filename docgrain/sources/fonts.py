"""TrueType files as tables: the table directory, offsets and checksums, and the tables that say where glyphs are."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaler types, and tables that a font embedded in a document does without.
SCALERS = (0x00010000, 0x74727565, 0x4F54544F, 0x74797031)
REMOVABLE = frozenset("DSIG FFTM GDEF GPOS GSUB JSTF LTSH PCLT VDMX hdmx kern mort morx name post".split())
CHECKSUM_MAGIC = 0xB1B0AFBA


@dataclass(frozen=True)
class Table:
    tag: str
    checksum: int
    offset: int
    data: bytes


def checksum(data: bytes) -> int:
    """Sum of big-endian 32-bit words, the last padded with zeros, modulo 2 ** 32."""
    padded = data + b"\0" * (-len(data) % 4)
    return int(np.frombuffer(padded, ">u4").sum(dtype=np.uint64) & 0xFFFFFFFF)


def parse(data: bytes) -> tuple[int, list[Table]]:
    """(scaler, tables) of a font file."""
    if len(data) < 12:
        raise ValueError("too short for a font")
    scaler, n = struct.unpack_from(">IH", data)
    if scaler not in SCALERS:
        raise ValueError(f"no scaler type {scaler:#x}")
    out = []
    for i in range(n):
        tag, check, offset, length = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        if offset + length > len(data):
            raise ValueError(f"table {tag!r} goes beyond the file")
        out.append(Table(tag.decode("latin-1"), check, offset, data[offset : offset + length]))
    return scaler, out


def layout(sizes: list[int], start: int) -> list[int]:
    """Offsets of tables laid one after another on multiples of four."""
    out, at = [], start
    for n in sizes:
        out.append(at)
        at += n + -n % 4
    return out


def build(scaler: int, tables: list[Table]) -> bytes:
    """A font file of these tables in order of tags, with offsets, sizes and checksums anew."""
    tables = sorted(tables, key=lambda t: t.tag)
    n = len(tables)
    power = max(0, n.bit_length() - 1)
    head = struct.pack(">IHHHH", scaler, n, 16 << power if n else 0, power, 16 * n - (16 << power) if n else 0)
    offsets = layout([len(t.data) for t in tables], 12 + 16 * n)
    for t, o in zip(tables, offsets):
        head += struct.pack(">4sIII", t.tag.encode("latin-1"), checksum(t.data), o, len(t.data))
    return head + b"".join(t.data + b"\0" * (-len(t.data) % 4) for t in tables)


def without(tables: list[Table], tags=REMOVABLE) -> list[Table]:
    return [t for t in tables if t.tag not in tags]


HEAD = ("version", "revision", "adjustment", "magic", "flags", "units", "created", "modified", "x_min", "y_min", "x_max", "y_max", "style", "least_size", "direction", "long_locations", "glyph_format")


def head(data: bytes) -> dict:
    """The fields of a head table; fixed-point ones as numbers."""
    values = struct.unpack_from(">iiIIHHqqhhhhHHhhh", data)
    out = dict(zip(HEAD, values))
    return out | {"version": out["version"] / 65536, "revision": out["revision"] / 65536}


def locations(data: bytes, long: bool, glyphs: int) -> list[int]:
    """Offsets of glyphs: 32-bit, or 16-bit halves."""
    kind, scale = (">u4", 1) if long else (">u2", 2)
    return (np.frombuffer(data, kind, glyphs + 1).astype(np.int64) * scale).tolist()


def slices(offsets: list[int]) -> list[tuple[int, int]]:
    """(start, length) of each glyph."""
    return [(a, b - a) for a, b in zip(offsets, offsets[1:])]


def short_fits(offsets: list[int]) -> bool:
    return all(o % 2 == 0 and o <= 131070 for o in offsets)


def glyph(data: bytes) -> dict:
    """What a glyph is, and its box."""
    if not data:
        return {"kind": "empty"}
    n, *box = struct.unpack_from(">hhhhh", data)
    ends = struct.unpack_from(f">{n}H", data, 10) if n > 0 else ()
    return {"kind": "simple" if n >= 0 else "composite", "contours": n, "box": box, "points": ends[-1] + 1 if ends else 0}


#: Bits of a point's flag (for x and y: one byte, and same as before or positive), and of a component's.
ON_CURVE, REPEATED, ONE_BYTE, SAME = 1, 8, (2, 4), (16, 32)
WORDS, MORE, SCALE, TWO_SCALES, MATRIX, HINTED = 1, 32, 8, 64, 128, 256


def flags_at(data: bytes, at: int, points: int) -> tuple[list[int], int]:
    """Flags of so many points, with repeats written out, and where they end."""
    out: list[int] = []
    while len(out) < points:
        flag, at = data[at], at + 1
        times = 1
        if flag & REPEATED:
            times, at = 1 + data[at], at + 1
        out += [flag] * times
    return out[:points], at


def coordinates_at(data: bytes, at: int, flags: list[int], axis: int) -> tuple[list[int], int]:
    """Coordinates of points along an axis (0 or 1), and where they end; a flag says how its difference is written."""
    out, now = [], 0
    for flag in flags:
        if flag & ONE_BYTE[axis]:
            now += data[at] if flag & SAME[axis] else -data[at]
            at += 1
        elif not flag & SAME[axis]:
            now += struct.unpack_from(">h", data, at)[0]
            at += 2
        out.append(now)
    return out, at


def outline(data: bytes) -> dict:
    """Ends of contours, points as (x, y, on curve) and the hints of a simple glyph; others have no points."""
    n = struct.unpack_from(">h", data)[0] if data else -1
    if n <= 0:
        return {"ends": [], "points": [], "hints": b""}
    ends = list(struct.unpack_from(f">{n}H", data, 10))
    at = 10 + 2 * n
    size = struct.unpack_from(">H", data, at)[0]
    hints, at = data[at + 2 : at + 2 + size], at + 2 + size
    flags, at = flags_at(data, at, ends[-1] + 1)
    xs, at = coordinates_at(data, at, flags, 0)
    ys, at = coordinates_at(data, at, flags, 1)
    return {"ends": ends, "points": [(x, y, bool(f & ON_CURVE)) for x, y, f in zip(xs, ys, flags)], "hints": bytes(hints)}


def without_hints(data: bytes) -> bytes:
    """A glyph without its instructions: their size is 0, and components no longer say that any follow."""
    if not data:
        return data
    n = struct.unpack_from(">h", data)[0]
    if n >= 0:
        at = 10 + 2 * n
        size = struct.unpack_from(">H", data, at)[0] if len(data) >= at + 2 else 0
        return data[:at] + b"\0\0" + data[at + 2 + size :] if size else data
    out, at, more = bytearray(data), 10, True
    while more:
        flags = struct.unpack_from(">H", data, at)[0]
        struct.pack_into(">H", out, at, flags & ~HINTED)
        at += 4 + (4 if flags & WORDS else 2) + (2 if flags & SCALE else 4 if flags & TWO_SCALES else 8 if flags & MATRIX else 0)
        more = bool(flags & MORE)
    return bytes(out[:at])


def relocated(glyphs: list[bytes]) -> tuple[bytes, bytes, bool]:
    """Glyphs one after another on even places, their location table, and whether that needs 32 bits."""
    offsets = [0]
    for g in glyphs:
        offsets.append(offsets[-1] + len(g) + len(g) % 2)
    long = not short_fits(offsets)
    table = np.array(offsets, ">u4") if long else (np.array(offsets) // 2).astype(">u2")
    return b"".join(g + b"\0" * (len(g) % 2) for g in glyphs), table.tobytes(), long


def unhinted(tables: list[Table]) -> list[Table]:
    """Tables with glyphs that have no hints, and their locations anew; fonts without such tables stay."""
    by_tag = {t.tag: t for t in tables}
    if not {"glyf", "loca", "head", "maxp"} <= set(by_tag):
        return tables
    glyf, first = by_tag["glyf"].data, head(by_tag["head"].data)
    count = struct.unpack_from(">H", by_tag["maxp"].data, 4)[0]
    spans = slices(locations(by_tag["loca"].data, bool(first["long_locations"]), count))
    data, places, long = relocated([without_hints(glyf[a : a + n]) for a, n in spans])
    changed = bytearray(by_tag["head"].data)
    struct.pack_into(">h", changed, 50, int(long))
    new = {"glyf": data, "loca": places, "head": bytes(changed)}
    return [Table(t.tag, 0, 0, new[t.tag]) if t.tag in new else t for t in tables]


POINTS = "path string, num long, seq long, x long, y long, on_curve boolean"


def glyph_points(glyphs: DataFrame) -> DataFrame:
    """A row for each point of simple glyphs given as (path, num, data); what is cut short has no rows."""

    def run(parts):
        for part in parts:
            rows = []
            for path, num, data in zip(part["path"], part["num"], part["data"]):
                try:
                    found = outline(bytes(data or b""))["points"]
                except (struct.error, IndexError):
                    continue
                rows += [(path, num, i, *p) for i, p in enumerate(found)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in POINTS.split(", ")])

    return glyphs.select("path", "num", "data").mapInPandas(run, POINTS)


def without_hints_column(data: Column) -> Column:
    """Glyphs without instructions; those cut short stay."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else without_hints(bytes(b))
            except struct.error:
                return bytes(b)

        return x.map(one)

    return run(data)


SCHEMA = "path string, num long, tag string, checksum long, computed long, offset long, length long"


def font_tables(streams: DataFrame) -> DataFrame:
    """The table directories of fonts given as (path, num, data); what is no font has no rows."""

    def run(parts):
        for part in parts:
            rows = []
            for path, num, data in zip(part["path"], part["num"], part["data"]):
                try:
                    found = parse(bytes(data or b""))[1]
                except ValueError:
                    continue
                rows += [(path, num, t.tag, t.checksum, checksum(t.data), t.offset, len(t.data)) for t in found]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return streams.select("path", "num", "data").mapInPandas(run, SCHEMA)


def built_column(*parts: Column) -> Column:
    """Font files of tables given as tag, data, tag, data, ..., without those that may go; null data is no table."""

    @F.pandas_udf("binary")
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            tables = [Table(tag, 0, 0, bytes(data)) for tag, data in zip(row[::2], row[1::2]) if data is not None]
            out.append(build(SCALERS[0], without(tables)))
        return pd.Series(out)

    return run(*parts)
