"""PNG and TIFF predictors of bitmaps, and the entropies that choose between them, in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: The byte in front of a PNG-predicted row.
PNG = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}


def shannon(data: np.ndarray) -> float:
    """Bits a byte of the histogram's entropy."""
    if not len(data):
        return 0.0
    p = np.bincount(data, minlength=256) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def entropy_sum(data: np.ndarray) -> float:
    return float((data.astype(np.int64) - 128).sum())


def entropy_lfs(data: np.ndarray) -> float:
    """Sum of n log2 n over the histogram, largest where values repeat."""
    n = np.bincount(data, minlength=256)
    n = n[n > 0].astype(np.float64)
    return float((n * np.log2(n)).sum())


def entropy_deflate(data: np.ndarray) -> float:
    return float(len(zlib.compress(data.tobytes())))


#: Name: (entropy, whether the least is best).
ENTROPIES: dict[str, tuple[Callable[[np.ndarray], float], bool]] = {"shannon": (shannon, True), "sum": (entropy_sum, True), "lfs": (entropy_lfs, False), "deflate": (entropy_deflate, True)}


def row_size(width: int, components: int, bits: int = 8) -> int:
    return math.ceil(width * components * bits / 8)


def grid(data: bytes, size: int) -> np.ndarray:
    if size <= 0 or len(data) % size:
        raise ValueError(f"{len(data)} bytes are no whole rows of {size}")
    return np.frombuffer(data, np.uint8).reshape(-1, size)


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int32) for x in (a, b, c))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def png_rows(rows: np.ndarray, components: int, kind: str) -> np.ndarray:
    """Each row less its prediction; left and above of the picture stands 0."""
    above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    shift = lambda x: np.hstack([np.zeros((len(x), components), np.uint8), x])[:, : x.shape[1]]
    left, corner = shift(rows), shift(above)
    if kind == "none":
        return rows.copy()
    guess = {"sub": lambda: left, "up": lambda: above, "average": lambda: ((left.astype(np.uint16) + above) // 2).astype(np.uint8), "paeth": lambda: paeth(left, above, corner)}[kind]()
    return rows - guess


def predict(data: bytes, kind: str, width: int, components: int, entropy: str = "shannon", bits: int = 8) -> bytes:
    """A bitmap predicted: PNG rows have their kind in front, `optimum` chooses it for each row; `tiff` has none."""
    if kind == "tiff":
        return tiff_predict(data, width, components, bits)
    rows = grid(data, row_size(width, components, bits))
    names = list(PNG) if kind == "optimum" else [kind]
    tried = [png_rows(rows, components, n) for n in names]
    measure, least = ENTROPIES[entropy]
    out = bytearray()
    for i in range(len(rows)):
        best = 0
        if len(names) > 1:
            costs = [measure(t[i]) for t in tried]
            best = costs.index(min(costs) if least else max(costs))
        out.append(PNG[names[best]])
        out += tried[best][i].tobytes()
    return bytes(out)


def unpredict(data: bytes, kind: str, width: int, components: int, bits: int = 8) -> bytes:
    """The bitmap again; of PNG rows the byte in front says how, whatever kind is given."""
    if kind == "tiff":
        return tiff_unpredict(data, width, components, bits)
    size = row_size(width, components, bits)
    rows = grid(data, size + 1)
    above, out = np.zeros(size, np.uint8), []
    for row in rows:
        how, x = int(row[0]), row[1:].copy()
        if how == 1:
            for k in range(components):
                x[k::components] = np.cumsum(x[k::components], dtype=np.uint8)
        elif how == 2:
            x = x + above
        elif how in (3, 4):
            values, up = x.tolist(), above.tolist()
            for i in range(size):
                a = values[i - components] if i >= components else 0
                b, c = up[i], up[i - components] if i >= components else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                values[i] = (values[i] + guess) & 255
            x = np.array(values, np.uint8)
        elif how:
            raise ValueError(f"no PNG predictor {how}")
        out.append(x.tobytes())
        above = x
    return b"".join(out)


def samples(rows: np.ndarray, width: int, components: int, bits: int) -> np.ndarray:
    """(rows, width, components) of unpacked samples."""
    if bits == 16:
        flat = rows.view(">u2").astype(np.int64)
    else:
        flat = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
        flat = (flat * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2, dtype=np.int64)
    return flat[:, : width * components].reshape(len(rows), width, components)


def packed(values: np.ndarray, bits: int, size: int) -> bytes:
    flat = values.reshape(len(values), -1)
    if bits == 16:
        return flat.astype(">u2").tobytes()
    if bits == 8:
        return flat.astype(np.uint8).tobytes()
    ones = (flat[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(len(flat), -1)
    ones = np.hstack([ones, np.zeros((len(ones), size * 8 - ones.shape[1]), np.uint8)])
    return np.packbits(ones, axis=1).tobytes()


def tiff_checked(width: int, components: int, bits: int) -> int:
    if bits not in (2, 4, 8, 16) or not 1 <= components <= 4:
        raise ValueError("TIFF prediction takes 2, 4, 8 or 16 bits and 1 to 4 components")
    return row_size(width, components, bits)


def tiff_predict(data: bytes, width: int, components: int, bits: int = 8) -> bytes:
    """Samples less those of the pixel to the left, modulo their size."""
    size = tiff_checked(width, components, bits)
    v = samples(grid(data, size), width, components, bits)
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    return packed(d % (1 << bits), bits, size)


def tiff_unpredict(data: bytes, width: int, components: int, bits: int = 8) -> bytes:
    size = tiff_checked(width, components, bits)
    v = samples(grid(data, size), width, components, bits)
    return packed(np.cumsum(v, axis=1) % (1 << bits), bits, size)


def configurations(size: int) -> list[tuple[int, int, int]]:
    """(bits, components, width) of one row that takes a size of bytes exactly."""
    return [(b, c, size * 8 // (b * c)) for b in (2, 4, 8, 16) for c in (1, 2, 3, 4) if size and size * 8 % (b * c) == 0]


def only_gray(data: bytes) -> bool:
    """Whether whole RGB pixels differ by one at most between components."""
    if len(data) % 3:
        return False
    p = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int16)
    return bool((p.max(1) - p.min(1) <= 1).all()) if len(p) else True


def to_gray(data: bytes) -> bytes:
    """The first component of each RGB pixel."""
    return data[::3]


def same_parity(data: bytes) -> bytes:
    """RGB components made even or odd as most of their pixel's are: one less towards even, one more (modulo a byte) towards odd."""
    n = len(data) // 3 * 3
    p = np.frombuffer(data[:n], np.uint8).reshape(-1, 3)
    odd = (p & 1).sum(1, keepdims=True) >= 2
    out = np.where(odd & (p & 1 == 0), p + np.uint8(1), np.where(~odd & (p & 1 == 1), p - np.uint8(1), p))
    return out.astype(np.uint8).tobytes() + data[n:]


def predict_column(data: Column, kind: str, width: int, components: int, entropy: str = "shannon") -> Column:
    @pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else predict(bytes(b), kind, width, components, entropy))

    return run(data)


def unpredict_column(data: Column, kind: str, width: int, components: int) -> Column:
    @pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else unpredict(bytes(b), kind, width, components))

    return run(data)
