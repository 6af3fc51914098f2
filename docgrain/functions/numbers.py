"""Numbers: rounding, shortest decimal text, byte widths and useful precisions, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go towards plus infinity, so -2.5 becomes -2."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def shortest_number(x: Column, digits: int = 6) -> Column:
    """Decimal text of x rounded half up: no exponent, no trailing zeros, no zero before the point."""
    text = F.format_string(f"%.{digits}f", round_half_up(x, digits))
    text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    text = F.regexp_replace(text, r"^(-?)0\.", "$1.")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def byte_width(n: Column) -> Column:
    """Bytes that a non-negative integer takes; 0 takes one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.hex(n.cast("bigint"))) / F.lit(2))).cast("bigint")


def int_to_bytes(n: Column, width: int) -> Column:
    """Big-endian in a fixed width."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def useful_precision(scale: Column) -> Column:
    """Digits after the point that can matter at a scale."""
    return F.when(scale < 1e-6, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.log10(scale)).cast("int") + F.lit(2))).cast("bigint")


def matrix_precision(a: Column) -> Column:
    """Digits after the point that keep a matrix entry's leading ones."""
    return F.when(a == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(a))).cast("int"))).cast("bigint")


def digits_of(n: Column, letters: str, prefix: str = "") -> Column:
    """n in base len(letters), most significant digit first."""
    base = len(letters)
    letter = lambda d: F.substring(F.lit(letters), (d + 1).cast("int"), F.lit(1))
    powers = [base**i for i in range(64) if base**i < 1 << 63]
    places = F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: (p <= n) | (p == 1))
    return F.concat(F.lit(prefix), F.array_join(F.reverse(F.transform(places, lambda p: letter(F.floor(n / p).cast("bigint") % base))), ""))


#: The digits of short names.
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE26 = "abcdefghijklmnopqrstuvwxyz"


def affine_product(m: list[Column], n: list[Column]) -> list[Column]:
    """The six entries of the product of two plane affine maps (a b c d e f), the first applied last."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d, t * a + u * c + e, t * b + u * d + f]


def row_bytes(width: Column, components: Column, bits: Column) -> Column:
    """Bytes of a bitmap row, padded to whole bytes."""
    return F.ceil(width * components * bits / F.lit(8)).cast("bigint")


def matrix_scale(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A vector under the linear part of a matrix [a, b, c, d, e, f]."""
    a, b, c, d = m[:4]
    return a * x + c * y, b * x + d * y


def useful_text_precision(scale: Column) -> Column:
    """Digits after the point that can matter to a text at a scale: one more than to a path."""
    return F.when(scale < 1e-6, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.log10(scale)).cast("int") + F.lit(3))).cast("bigint")


def useful_color_precision() -> Column:
    """Digits that matter to a color component, a fixed value."""
    return F.lit(2)


def interleaved(parts: list[Column]) -> Column:
    """Binary columns of one length each woven together, a byte of each in turn."""
    pieces = F.arrays_zip(*[F.split(F.hex(p), "(?<=\\G..)").alias(f"p{i}") for i, p in enumerate(parts)])
    return F.unhex(F.array_join(F.transform(pieces, lambda z: F.concat(*[z[f"p{i}"] for i in range(len(parts))])), ""))


def hex_dump(data: Column, start: Column | int = 0, size: int = 256) -> Column:
    """The bytes from a place on as pairs of hex digits, 16 a line."""
    start = F.lit(start) if isinstance(start, int) else start
    pairs = F.regexp_replace(F.lower(F.hex(F.substring(data, start + 1, F.lit(size)))), "(..)", "$1 ")
    return F.rtrim(F.regexp_replace(pairs, "((?:.. ){15}..) ", "$1\n"))
