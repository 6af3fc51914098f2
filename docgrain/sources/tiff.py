"""Raw bitmaps as baseline TIFF files."""

from __future__ import annotations

import struct

#: Samples a pixel and photometric interpretation by colour space.
COLORS = {"gray": (1, 1), "rgb": (3, 2), "cmyk": (4, 5)}


def simple_tiff(width: int, height: int, color: str, data: bytes) -> bytes:
    """Eight-bit pixels as one uncompressed strip behind a little-endian header of twelve tags; empty for other colours."""
    if color not in COLORS:
        return b""
    samples, meaning = COLORS[color]
    count = 12
    after = 8 + 2 + 12 * count + 4  # what is too long for a tag stands here
    bits = struct.pack(f"<{samples}H", *[8] * samples)
    bits_at, resolution_at = after, after + len(bits) + len(bits) % 2
    data_at = resolution_at + 8
    short, long, ratio = 3, 4, 5
    tags = [
        (256, long, 1, width),
        (257, long, 1, height),
        (258, short, samples, 8 if samples == 1 else bits_at),
        (259, short, 1, 1),
        (262, short, 1, meaning),
        (273, long, 1, data_at),
        (277, short, 1, samples),
        (278, long, 1, height),
        (279, long, 1, len(data)),
        (282, ratio, 1, resolution_at),
        (283, ratio, 1, resolution_at),
        (296, short, 1, 2),
    ]
    out = b"II*\0" + struct.pack("<IH", 8, count) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    out += bits + b"\0" * (len(bits) % 2) + struct.pack("<II", 72, 1)
    return out + data
