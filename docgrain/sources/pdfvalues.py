"""Values of PDF files: reading them from bytes, writing them as short as the syntax allows, walking through them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

WHITE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"


class Name(str):
    """A name, its escapes resolved; bytes are held as Latin-1."""


class Keyword(str):
    """A word that is neither true, false nor null."""


class Text(bytes):
    """A string in parentheses."""


class Hex(bytes):
    """A string of hex digits."""


class Ref(NamedTuple):
    num: int
    gen: int


class ParseError(ValueError):
    def __init__(self, offset: int, message: str):
        super().__init__(f"at byte {offset}: {message}")
        self.offset = offset


NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
OCTAL = re.compile(rb"[0-7]{1,3}")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def unhex(digits: bytes) -> bytes:
    clean = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode())


class Reader:
    """Reads values from data at a position that moves on. with_references: whether `1 0 R` is one value, as in files, or not, as in content streams."""

    def __init__(self, data: bytes, at: int = 0, with_references: bool = True):
        self.data, self.at, self.with_references = data, at, with_references

    def blank(self) -> None:
        self.at = BLANK.match(self.data, self.at).end()

    def ended(self) -> bool:
        self.blank()
        return self.at >= len(self.data)

    def value(self, depth: int = 0) -> Any:
        self.blank()
        data, at = self.data, self.at
        if depth > 200:
            raise ParseError(at, "values are nested too deep")
        first = data[at : at + 1]
        if not first:
            raise ParseError(at, "a value was expected")
        if first == b"/":
            return self.name()
        if first == b"(":
            return self.text()
        if data[at : at + 2] == b"<<":
            return self.dictionary(depth)
        if first == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise ParseError(at, "a hex string is not closed")
            self.at = end + 1
            return Hex(unhex(data[at + 1 : end]))
        if first == b"[":
            self.at += 1
            out = []
            while True:
                self.blank()
                if data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if self.with_references and (m := REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := NUMBER.match(data, at):
            self.at = m.end()
            return float(m[0])
        if m := REGULAR.match(data, at):
            self.at = m.end()
            word = m[0].decode("latin-1")
            return {"true": True, "false": False, "null": None}.get(word, Keyword(word))
        raise ParseError(at, f"{first!r} begins no value")

    def name(self) -> Name:
        m = REGULAR.match(self.data, self.at + 1)
        raw = m[0] if m else b""
        self.at += 1 + len(raw)
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), raw).decode("latin-1"))

    def text(self) -> Text:
        data, begin = self.data, self.at
        out, depth, i = bytearray(), 1, begin + 1
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                follow = data[i + 1 : i + 2]
                if m := OCTAL.match(data, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                elif follow in (b"\r", b"\n"):
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                else:
                    out += ESCAPES.get(follow, follow)
                    i += 2
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return Text(out)
            elif c == b"\r":  # every line end is a line feed
                c = b"\n"
                i += data[i + 1 : i + 2] == b"\n"
            out += c
            i += 1
        raise ParseError(begin, "a string is not closed")

    def dictionary(self, depth: int = 0) -> dict[str, Any]:
        """Of a key that repeats, the last value counts."""
        begin, out = self.at, {}
        self.at += 2
        while True:
            self.blank()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            if self.data[self.at : self.at + 1] != b"/":
                raise ParseError(self.at if self.at < len(self.data) else begin, "a dictionary's key was expected")
            key = str(self.name())
            out[key] = self.value(depth + 1)


def number_text(x: float, digits: int = 6) -> bytes:
    """As few characters as a number takes: rounded half up, no exponent, no zero before the point."""
    if digits <= 6 and -1e9 < x < 1e9 and x == int(x):
        return b"%d" % x
    x = math.floor(x * 10**digits + 0.5) / 10**digits
    out = f"{x:.{digits}f}".rstrip("0").rstrip(".")
    out = re.sub(r"^(-?)0\.", r"\1.", out)
    return b"0" if out in ("", "-", "-0") else out.encode()


@lru_cache(4096)
def name_text(name: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02x" % m[0][0], name.encode("latin-1"))


def string_text(data: bytes) -> bytes:
    """The string in parentheses; only what must be is escaped, balanced parentheses are not."""
    depth, level = [], 0
    lone: set[int] = set()
    for i, c in enumerate(data):
        if c == 40:
            depth.append(i)
            level += 1
        elif c == 41:
            if depth:
                depth.pop()
            else:
                lone.add(i)
    lone.update(depth)
    out = bytearray(b"(")
    for i, c in enumerate(data):
        if c == 92 or i in lone:
            out += b"\\" + bytes((c,))
        elif c == 13:
            out += b"\\r"
        else:
            out.append(c)
    return bytes(out + b")")


def to_bytes(value: Any) -> bytes:
    """A value as bytes; keys in ascending order."""
    if f := WRITERS.get(type(value)):
        return f(value)
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, Name):
        return name_text(value)
    if isinstance(value, Hex):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, bytes):
        return string_text(value)
    if isinstance(value, dict):
        return b"<<" + spaced([y for k in sorted(value) for y in (Name(k), value[k])]) + b">>"
    if isinstance(value, (list, tuple)):
        return b"[" + spaced(value) + b"]"
    return str(value).encode("latin-1")


def spaced(values) -> bytes:
    """Values in a row, a space only where two would run together."""
    out, last = [], b""
    for part in map(to_bytes, values):
        if last and last[-1] not in FREE and part[:1] not in DELIMITERS_BYTES:
            out.append(b" ")
        if part:
            out.append(part)
            last = part
    return b"".join(out)


DELIMITERS_BYTES = {bytes((c,)) for c in DELIMITERS}
#: After these no space is needed; after the slash of an empty name it is.
FREE = frozenset(DELIMITERS + WHITE) - {47}
WRITERS: dict[type, Callable[[Any], bytes]] = {
    dict: lambda v: b"<<" + spaced([y for k in sorted(v) for y in (Name(k), v[k])]) + b">>",
    list: lambda v: b"[" + spaced(v) + b"]",
    float: number_text, Name: name_text, Ref: lambda v: b"%d %d R" % v, Keyword: lambda v: v.encode("latin-1"),
}


def references_of(value: Any) -> list[Ref]:
    """All references in a value, in order."""
    if type(value) is Ref:
        return [value]
    if isinstance(value, dict):
        value = value.values()
    elif not isinstance(value, list):
        return []
    out: list[Ref] = []
    for v in value:
        if type(v) is Ref:
            out.append(v)
        elif isinstance(v, (dict, list)):
            out += references_of(v)
    return out


def walk(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """All leaves, each with the keys and places that lead to it."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, (*path, str(i)))
    else:
        yield path, value


def deep_map(value: Any, f: Callable[[tuple[str, ...], Any], Any], path: tuple[str, ...] = ()) -> Any:
    """The same value with every leaf replaced."""
    if isinstance(value, dict):
        return {k: deep_map(v, f, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [deep_map(v, f, (*path, str(i))) for i, v in enumerate(value)]
    return f(path, value)


def find_all(value: Any, want: Callable[[Any], bool]) -> Iterator[Any]:
    """Values at any depth that a predicate takes; not inside those that it took."""
    if want(value):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from find_all(v, want)
    elif isinstance(value, list):
        for v in value:
            yield from find_all(v, want)


def reduced(value: Any) -> Any:
    """Numbers rounded: six digits under Matrix, else four."""
    return deep_map(value, lambda path, x: math.floor(x * 10 ** (d := 6 if "Matrix" in path else 4) + 0.5) / 10**d if isinstance(x, float) else x)


#: The characters of PDFDocEncoding that differ from Latin-1, from 0x18 and 0x80 on, and the one at 0xA0.
PDFDOC_18 = "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc"
PDFDOC_80 = "\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e"
PDFDOC_A0 = "\u20ac"
PDFDOC = {
    **{chr(c): c for c in (9, 10, 13, *range(32, 127), *range(161, 256)) if c != 0xAD},
    **{c: 0x18 + i for i, c in enumerate(PDFDOC_18)},
    **{c: 0x80 + i for i, c in enumerate(PDFDOC_80)},
    PDFDOC_A0: 0xA0,
}


def is_utf16(data: bytes) -> bool:
    return data[:2] == b"\xfe\xff"


def is_ascii(data: bytes) -> bool:
    return data.isascii()


def to_pdfdoc(text: str) -> bytes | None:
    """A text in PDFDocEncoding, None if it has a character that this lacks."""
    codes = [PDFDOC.get(c) for c in text]
    return None if None in codes else bytes(codes)


def plain_string(value: Any) -> Any:
    """Hex strings as strings in parentheses, UTF-16 as one byte a character where PDFDocEncoding has all of them."""
    if isinstance(value, Hex):
        value = Text(value)
    if isinstance(value, Text) and is_utf16(value):
        try:
            short = to_pdfdoc(value[2:].decode("utf-16-be"))
        except UnicodeDecodeError:
            return value
        if short is not None:
            return Text(short)
    return value
