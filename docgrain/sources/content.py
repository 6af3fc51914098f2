"""Content streams as tables of commands, and rewrites that make them shorter without changing the picture."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.sources.pdfvalues import DELIMITERS_BYTES, FREE, REGULAR, Keyword, Name, Reader, Text, plain_string, to_bytes

#: The operators by category.
CATEGORIES = {
    "general": "q Q w J j M d ri i gs BI ID EI",
    "special": "cm",
    "path": "m l c v y h re",
    "paint": "S s f F f* B B* b b* n",
    "clip": "W W*",
    "text object": "BT ET",
    "text state": "Td TD Tm T* Tc Tw Tz TL Tf Tr Ts",
    "text": "Tj ' \" TJ",
    "type 3": "d0 d1",
    "color": "CS cs SC SCN sc scn G g RG rg K k",
    "shading": "sh",
    "object": "Do",
    "marked": "MP DP BMC BDC EMC",
    "compatibility": "BX EX",
}
CATEGORY = {op: name for name, ops in CATEGORIES.items() for op in ops.split()}
#: Operators that show something, after which a state matters.
PAINTS = frozenset("S s f F f* B B* b b* sh Do EI Tj ' \" TJ".split())
#: Operators that a following one of the same kind makes useless.
OVERWRITTEN = frozenset("w J j M d ri i Tc Tw Tz TL Tf Tr Ts g G rg RG k K Tm".split())
STROKE_COLOR, FILL_COLOR = frozenset("G RG K".split()), frozenset("g rg k".split())
#: What state commands set, and what it is at first.
STATE = {"w": 1.0, "J": 0.0, "j": 0.0, "M": 10.0, "i": 1.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "Ts": 0.0}
#: Digits that are kept by category.
DIGITS = {"color": 2, "path": 2, "text state": 3, "special": 5}
#: Scales that `scaled` tries.
SCALES = (1, 10, 100, 1000)
ROUNDS = 64
SHORT_KEYS = {"BitsPerComponent": "BPC", "ColorSpace": "CS", "Decode": "D", "DecodeParms": "DP", "Filter": "F", "Height": "H", "ImageMask": "IM", "Interpolate": "I", "Width": "W"}
SHORT_NAMES = {"DeviceGray": "G", "DeviceRGB": "RGB", "DeviceCMYK": "CMYK", "Indexed": "I", "ASCIIHexDecode": "AHx", "ASCII85Decode": "A85", "LZWDecode": "LZW", "FlateDecode": "Fl", "RunLengthDecode": "RL", "CCITTFaxDecode": "CCF", "DCTDecode": "DCT"}


@dataclass(frozen=True)
class Command:
    op: str
    args: tuple = ()

    @property
    def category(self) -> str:
        return CATEGORY.get(self.op, "general")


#: Words in a row that begin like no number: operators, or a truth value or null.
WORDS = re.compile(rb"(?:[\0\t\n\f\r ]*[^\0\t\n\f\r ()<>\[\]{}/%+\-.0-9][^\0\t\n\f\r ()<>\[\]{}/%]*)+")
CONSTANTS = {b"true": True, b"false": False, b"null": None}


@lru_cache(32768)
def bare(word: bytes) -> Command:
    """The command of an operator without operands."""
    return Command(word.decode("latin-1"))


def parse(data: bytes) -> list[Command]:
    """The commands of a stream; operands without an operator at the end are a command without a name."""
    r, out, args = Reader(data, with_references=False), [], []
    while not r.ended():
        if m := WORDS.match(data, r.at):
            words = REGULAR.findall(m[0])
            n = words.index(b"BI") if b"BI" in words else len(words)
            for w in words[:n]:
                if w in CONSTANTS:
                    args.append(CONSTANTS[w])
                elif args:
                    out.append(Command(w.decode("latin-1"), tuple(args)))
                    args = []
                else:
                    out.append(bare(w))
            if n == len(words):
                r.at = m.end()
                continue
            r.at = [x.start() for x in REGULAR.finditer(data, m.start(), m.end())][n]
        value = r.value()
        if not isinstance(value, Keyword):
            args.append(value)
            continue
        if value == "BI":
            d: dict[str, Any] = {}
            while not r.ended():
                key = r.value()
                if isinstance(key, Keyword):
                    break
                d[str(key)] = r.value()
            end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(data, r.at)
            stop = end.start() if end else len(data)
            out.append(Command("BI", (d, bytes(data[r.at + 1 : stop]))))
            r.at = end.end() if end else len(data)
            args = []
            continue
        out.append(Command(str(value), tuple(args)))
        args = []
    return out + ([Command("", tuple(args))] if args else [])


def token_list(command: Command) -> list:
    """Operands, then the operator."""
    return [*command.args, *([Keyword(command.op)] if command.op else [])]


def inline_image(command: Command) -> bytes:
    d, data = command.args
    short = {SHORT_KEYS.get(k, k): Name(SHORT_NAMES.get(v, v)) if isinstance(v, Name) else v for k, v in d.items()}
    return b"BI" + to_bytes(short)[2:-2] + b" ID " + data + b"\nEI"


def write(commands: list[Command]) -> bytes:
    """A stream as short as the syntax allows."""
    out: list[bytes] = []
    last = b""
    for c in commands:
        if c.op == "BI":
            parts = [inline_image(c)]
        elif c.args:
            parts = [to_bytes(t) for t in token_list(c)]
        else:
            parts = [c.op.encode("latin-1")]
        for part in filter(None, parts):
            if last and last[-1] not in FREE and part[:1] not in CLOSE:
                out.append(b" ")
            out.append(part)
            last = part
    return b"".join(out)


#: Before these no space is needed.
CLOSE = DELIMITERS_BYTES - {b"{", b"}", b"%"}


def rounded(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def reduce_precision(c: Command) -> Command:
    digits = DIGITS.get(c.category, 4)

    def one(x):
        if isinstance(x, float):
            return rounded(x, digits)
        return [one(y) for y in x] if isinstance(x, list) else plain_string(x)

    return replace(c, args=tuple(one(x) for x in c.args)) if c.op != "BI" else c


def simpler_color(c: Command) -> Command:
    """Gray for RGB of equal components, and for CMYK of black alone."""
    if c.op in ("RG", "rg") and len(c.args) == 3 and len(set(c.args)) == 1:
        return Command("G" if c.op == "RG" else "g", c.args[:1])
    if c.op in ("K", "k") and len(c.args) == 4 and not any(c.args[:3]):
        return Command("G" if c.op == "K" else "g", (rounded(1 - c.args[3], 2),))
    return c


def matching(program: list[Command], at: int) -> int:
    """The place of the Q that closes the q at a place, or -1."""
    depth = 0
    for i in range(at, len(program)):
        depth += {"q": 1, "Q": -1}.get(program[i].op, 0)
        if not depth:
            return i
    return -1


def without_idle_saves(program: list[Command]) -> list[Command]:
    """Without q ... Q around nothing, or around a whole balanced program or another such pair."""
    depth = low = 0
    for c in program:
        depth += {"q": 1, "Q": -1}.get(c.op, 0)
        low = min(low, depth)
    if depth or low:
        return program
    drop: set[int] = set()
    for i, c in enumerate(program):
        if c.op == "q" and i not in drop:
            j = matching(program, i)
            inner = [x for x in program[i + 1 : j]]
            if not inner:
                drop |= {i, j}
            elif inner[0].op == "q" and matching(program, i + 1) == j - 1:
                drop |= {i + 1, j - 1}
    return [c for i, c in enumerate(program) if i not in drop]


def without_overwritten(program: list[Command]) -> list[Command]:
    def useless(a: Command, b: Command) -> bool:
        return a.op in OVERWRITTEN and a.op == b.op or any(a.op in s and b.op in s for s in (STROKE_COLOR, FILL_COLOR))

    return [c for c, n in zip(program, [*program[1:], Command("")]) if not useless(c, n)]


def without_ineffective(program: list[Command]) -> list[Command]:
    """Without state that is restored, or ends, before anything is shown; text objects that show nothing go."""
    keep = [True] * len(program)
    shown = [False]  # whether something follows, for each open level; read from the end
    for i in range(len(program) - 1, -1, -1):
        c = program[i]
        if c.op == "Q":
            shown.append(False)
        elif c.op == "q" and len(shown) > 1:
            inner = shown.pop()
            shown[-1] |= inner
        elif c.op in PAINTS or c.op in ("BI", "W", "W*", "n", "BDC", "BMC", "EMC", "BX", "EX", "d0", "d1", "MP", "DP", ""):
            shown[-1] = True
        elif c.category in ("color", "special", "text state") or c.op in STATE or c.op in ("d", "ri", "gs"):
            keep[i] = shown[-1] or len(shown) == 1
    out = [c for c, k in zip(program, keep) if k]
    i = 0
    while i < len(out) - 1:
        if out[i].op == "BT" and out[i + 1].op == "ET":
            del out[i : i + 2]
            i = max(0, i - 1)
        else:
            i += 1
    return out


def merged_text(program: list[Command]) -> list[Command]:
    """Texts shown one after another in one command."""
    out: list[Command] = []

    def joined(items: list) -> list:
        got: list = []
        for x in items:
            if got and isinstance(x, bytes) and isinstance(got[-1], bytes):
                got[-1] = Text(got[-1] + x)
            else:
                got.append(x)
        return got

    for c in program:
        if c.op in ("Tj", "TJ") and out and out[-1].op in ("Tj", "TJ"):
            parts = [x for y in (out[-1], c) for x in (y.args[0] if y.op == "TJ" else y.args)]
            parts = joined(parts)
            out[-1] = Command("Tj", (parts[0],)) if len(parts) == 1 and isinstance(parts[0], bytes) else Command("TJ", (parts,))
        else:
            out.append(c)
    return out


def rectangles(program: list[Command]) -> list[Command]:
    """m l l l (l) h around an axis-aligned rectangle as re."""
    out, i = [], 0
    while i < len(program):
        for n in (6, 5):
            ops = [c.op for c in program[i : i + n]]
            if ops in (["m", "l", "l", "l", "l", "h"], ["m", "l", "l", "l", "h"]):
                p = [c.args for c in program[i : i + n - 1]]
                if all(len(a) == 2 for a in p) and (n == 5 or p[4] == p[0]):
                    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p[:4]
                    if y0 == y1 and x1 == x2 and y2 == y3 and x3 == x0 or x0 == x1 and y1 == y2 and x2 == x3 and y3 == y0:
                        out.append(Command("re", (x0, y0, x2 - x0, y2 - y0)))
                        i += n
                        break
        else:
            out.append(program[i])
            i += 1
    return out


def shorter_paths(program: list[Command]) -> list[Command]:
    """Closing and painting in one, curves whose control points are ends, points on a straight line."""
    fused = {"S": "s", "B": "b", "B*": "b*"}
    out: list[Command] = []
    point: tuple | None = None
    for i, c in enumerate(program):
        after = program[i + 1] if i + 1 < len(program) else Command("")
        if c.op in fused and out and out[-1].op == "h":
            out[-1] = Command(fused[c.op])
            point = None
            continue
        if c.op == "c" and len(c.args) == 6:
            if point == c.args[:2]:
                c = Command("v", c.args[2:])
            elif c.args[2:4] == c.args[4:6]:
                c = Command("y", c.args[:4])
        if c.op == "l" and len(c.args) == 2 and point is not None and after.op == "l" and len(after.args) == 2:
            (x0, y0), (x1, y1), (x2, y2) = point, c.args, after.args
            between = min(x0, x2) <= x1 <= max(x0, x2) and min(y0, y2) <= y1 <= max(y0, y2)
            if between and (x1 - x0) * (y2 - y0) == (y1 - y0) * (x2 - x0):
                continue
        if c.category == "path":
            point = tuple(c.args[-2:]) if c.op in ("m", "l", "c", "v", "y") else None
        out.append(c)
    return out


Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: Matrix, n: Matrix) -> Matrix:
    """n, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d, t * a + u * c + e, t * b + u * d + f)


def merged_matrices(program: list[Command]) -> list[Command]:
    """Without maps that change nothing; maps in a row are one."""
    out: list[Command] = []
    for c in program:
        if c.op == "cm" and len(c.args) == 6:
            if c.args == IDENTITY:
                continue
            if out and out[-1].op == "cm":
                out[-1] = Command("cm", product(out[-1].args, c.args))
                continue
        out.append(c)
    return out


@dataclass
class State:
    """What commands have set so far; each save is a copy."""

    values: dict[str, Any] = field(default_factory=lambda: dict(STATE))
    stack: list[dict[str, Any]] = field(default_factory=list)

    def save(self) -> None:
        self.stack.append(dict(self.values))

    def restore(self) -> None:
        self.values = self.stack.pop() if self.stack else dict(STATE)


def without_unchanged(program: list[Command]) -> list[Command]:
    """Without commands that set what is set already, and texts that are empty."""
    state, out = State(), []
    for c in program:
        key = "stroke" if c.op in STROKE_COLOR else "fill" if c.op in FILL_COLOR else c.op
        if c.op == "q":
            state.save()
        elif c.op == "Q":
            state.restore()
        elif c.op == "gs":
            state.values.clear()  # it may set anything
        elif c.op in STATE or c.op in ("Tf", "TL", "Tr", "ri") or key in ("stroke", "fill"):
            value = c.args[0] if c.op in STATE and len(c.args) == 1 else (c.op, c.args)
            if key in state.values and state.values[key] == value:
                continue
            state.values[key] = value
        elif c.op in ("CS", "SC", "SCN"):
            state.values.pop("stroke", None)
        elif c.op in ("cs", "sc", "scn"):
            state.values.pop("fill", None)
        elif c.op == "Tj" and c.args and not c.args[0] or c.op == "TJ" and c.args and not any(isinstance(x, bytes) and x or isinstance(x, float) and x for x in c.args[0]):
            continue
        out.append(c)
    return out


def without_doubled_marks(program: list[Command]) -> list[Command]:
    """Two equal BDC in a row, closed by two EMC in a row with no EMC between: one of each."""
    out, i = [], 0
    while i < len(program):
        c = program[i]
        if c.op == "BDC" and i + 1 < len(program) and program[i + 1] == c:
            end = next((k for k in range(i + 2, len(program)) if program[k].op == "EMC"), None)
            if end is not None and end + 1 < len(program) and program[end + 1].op == "EMC":
                out += [c, *program[i + 2 : end + 1]]
                i = end + 2
                continue
            out += [c, program[i + 1]]
            i += 2
            continue
        out.append(c)
        i += 1
    return out


def moved_texts(program: list[Command]) -> list[Command]:
    """A text matrix that differs in its translation alone from the one before, with nothing that moves the line between, as Td."""
    out, last = [], None
    for c in program:
        if c.op == "Tm" and len(c.args) == 6 and all(isinstance(x, float) for x in c.args):
            if last is not None and c.args[:4] == last[:4]:
                a, b, p, q = c.args[:4]
                det, x, y = a * q - b * p, c.args[4] - last[4], c.args[5] - last[5]
                moved = (rounded((x * q - y * p) / det, 4), rounded((y * a - x * b) / det, 4)) if det else None
                # Only where the shorter numbers lead to the same place.
                if moved and abs(moved[0] * a + moved[1] * p - x) < 1e-6 and abs(moved[0] * b + moved[1] * q - y) < 1e-6:
                    shorter = Command("Td", moved)
                    if len(write([shorter])) < len(write([c])):
                        out.append(shorter)
                        last = c.args
                        continue
            last = c.args
        elif c.op in ("BT", "ET", "Td", "TD", "T*", "'", '"', "q", "Q", "cm"):
            last = None
        out.append(c)
    return out


#: Each rule with the operators without which it changes nothing.
RULES = (
    (without_idle_saves, frozenset(("q",))),
    (without_doubled_marks, frozenset(("BDC",))),
    (moved_texts, frozenset(("Tm",))),
    (rectangles, frozenset(("h",))),
    (without_ineffective, frozenset(("Q", "BT"))),
    (without_overwritten, OVERWRITTEN | STROKE_COLOR | FILL_COLOR),
    (merged_text, frozenset(("Tj", "TJ"))),
    (merged_matrices, frozenset(("cm",))),
    (shorter_paths, frozenset(("h", "c", "l"))),
    (without_unchanged, frozenset((*STATE, "Tf", "TL", "Tr", "ri", "Tj", "TJ")) | STROKE_COLOR | FILL_COLOR),
)


def optimized(program: list[Command], rounds: int = ROUNDS) -> list[Command]:
    """All rules until nothing changes, at most so many times. A program that would come out empty stays as it is."""
    now = [simpler_color(reduce_precision(c)) if c.args else c for c in program]
    for _ in range(rounds):
        then, ops = now, {c.op for c in now}
        for rule, needs in RULES:
            if not ops.isdisjoint(needs):
                then = rule(then)
        if then == now:
            break
        now = then
    return now or program


def scaled(program: list[Command], scale: int) -> list[Command]:
    """The same picture with coordinates of paths times a scale, inside a map that undoes it; without texts and images only."""
    if scale == 1 or any(c.category not in ("general", "path", "paint", "color", "clip") or c.op in ("BI", "gs", "d") for c in program):
        return program
    wide = {"w"}
    out = [Command("q"), Command("cm", (1 / scale, 0.0, 0.0, 1 / scale, 0.0, 0.0))]
    out += [replace(c, args=tuple(x * scale for x in c.args)) if c.category == "path" or c.op in wide else c for c in program]
    if not any(c.op == "w" for c in program):
        out.insert(2, Command("w", (float(scale),)))
    return [*out, Command("Q")]


def shortest(data: bytes) -> bytes:
    """The shortest of the optimised stream at several scales, or the stream itself."""
    if b"/CIDInit" in data:
        return data
    program = optimized(parse(data))
    # Without operands that a scale changes, a map around is only longer.
    scales = SCALES if any(c.args and (c.category == "path" or c.op == "w") for c in program) else SCALES[:1]
    return min((data, *(write(p) for s in scales if (p := scaled(program, s)) is not program or s == 1)), key=len)


def human(commands: list[Command]) -> str:
    """A line a command, indented inside saves, texts and marked content."""
    out, depth = [], 0
    for c in commands:
        if c.op in ("Q", "ET", "EMC"):
            depth = max(0, depth - 1)
        out.append("  " * depth + " ".join(to_bytes(t).decode("latin-1") for t in (token_list(c) if c.op != "BI" else [Keyword("BI ... EI")])))
        if c.op in ("q", "BT", "BMC", "BDC"):
            depth += 1
    return "\n".join(out)


def resources_used(commands: list[Command]) -> list[tuple[str, str]]:
    """Distinct (kind, name) that commands name."""
    kinds = {"gs": "ExtGState", "CS": "ColorSpace", "cs": "ColorSpace", "Tf": "Font", "sh": "Shading", "Do": "XObject", "SCN": "Pattern", "scn": "Pattern", "BDC": "Properties", "DP": "Properties"}
    found = set()
    for c in commands:
        names = [x for x in c.args if isinstance(x, Name)]
        if c.op in kinds and names:
            found.add((kinds[c.op], str(names[-1] if c.op in ("BDC", "DP", "SCN", "scn") else names[0])))
    return sorted(found)


def kept_resources(resources: dict, used: set[tuple[str, str]]) -> dict:
    """Resources by kind and name, without those that no command names; kinds left empty go, and what is no dictionary stays."""
    out = {}
    for kind, names in resources.items():
        if isinstance(names, dict):
            left = {n: v for n, v in names.items() if (str(kind), str(n)) in used}
            if left:
                out[kind] = left
        else:
            out[kind] = names
    return out


def text_scales(program: list[Command]) -> list[tuple[Matrix, Matrix, float]]:
    """Before each command: the map from user space, the text matrix, and the horizontal scale as a fraction."""
    now: tuple[Matrix, Matrix, float] = (IDENTITY, IDENTITY, 1.0)
    saved, out = [], []
    for c in program:
        out.append(now)
        space, text, wide = now
        if c.op == "q":
            saved.append(now)
        elif c.op == "Q":
            now = saved.pop() if saved else (IDENTITY, IDENTITY, 1.0)
        elif c.op == "cm" and len(c.args) == 6:
            now = (product(space, c.args), text, wide)
        elif c.op == "BT":
            now = (space, IDENTITY, wide)
        elif c.op == "Tm" and len(c.args) == 6:
            now = (space, tuple(c.args), wide)
        elif c.op in ("Td", "TD") and len(c.args) == 2:
            now = (space, product(text, (1.0, 0.0, 0.0, 1.0, *c.args)), wide)
        elif c.op == "Tz" and c.args:
            now = (space, text, c.args[0] / 100)
    return out


def renamed(commands: list[Command], names: dict[tuple[str, str], str]) -> list[Command]:
    """Resource names by a table; names that it does not have stay."""
    out = []
    for c in commands:
        to = {n: names[kind, n] for kind, n in resources_used([c]) if (kind, n) in names}
        out.append(replace(c, args=tuple(Name(to[x]) if isinstance(x, Name) and x in to else x for x in c.args)) if to else c)
    return out


SCHEMA = "path string, num long, seq long, op string, category string, params array<string>"


def commands(streams: DataFrame) -> DataFrame:
    """A row for each command of decoded streams given as (path, num, data); a stream that can't be read has one without a name."""

    def run(parts):
        for part in parts:
            rows = []
            for path, num, data in zip(part["path"], part["num"], part["data"]):
                try:
                    program = parse(bytes(data or b""))
                except ValueError as e:
                    program = [Command("", (Text(str(e).encode("latin-1", "replace")),))]
                rows += [(path, num, i, c.op, c.category, [to_bytes(a).decode("latin-1") for a in c.args]) for i, c in enumerate(program)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return streams.select("path", "num", "data").mapInPandas(run, SCHEMA)


def optimized_column(data: Column) -> Column:
    """Streams at their shortest; those that can't be read stay."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return shortest(bytes(b))
            except ValueError:
                return bytes(b)

        return x.map(one)

    return run(data)




def rewritten_column(data: Column) -> Column:
    """Streams after all rules, at the scale they have; those that can't be read stay."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else write(optimized(parse(bytes(b))))
            except ValueError:
                return bytes(b)

        return x.map(one)

    return run(data)


def human_column(data: Column) -> Column:
    """Streams as text, a line a command; null where they can't be read."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else human(parse(bytes(b)))
            except ValueError:
                return None

        return x.map(one)

    return run(data)
