"""PDF files as tables of objects.

`read` lists the objects of files, those in object streams too, with their references; further functions are queries on that
table: `info`, `stat`, `hashes`, `extract`, `get`, `used`, `optimize` and `assemble`. A file is read in one task, files
in parallel; what can't be read of a file is a row of kind `error`.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from docgrain.cluster import released
from docgrain.functions import codecs, predictors
from docgrain.operators import dedup, refs
from docgrain.sources import content, fonts
from docgrain.sources.pdfvalues import Keyword, Name, ParseError, Reader, Ref, deep_map, plain_string, reduced, references_of, to_bytes, walk

SCHEMA = "path string, pos long, num long, gen long, kind string, type string, subtype string, body binary, stream binary, filters array<string>, container long, offset long, refs array<struct<num:long,gen:long>>, error string"
OBJECT = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
SPACE = re.compile(rb"[\0\t\n\f\r ]*")
LINE = re.compile(rb"[^\r\n]*")
NOTHING = re.compile(rb"[\0\t\n\f\r ]*endobj")
CLOSED = re.compile(rb"[\0\t\n\f\r ]*endstream")
AFTER_ENTRY = re.compile(rb"[\t ]*[\r\n]*")
SUBSECTION = re.compile(rb"[\0\t\n\f\r ]*(\d+) (\d+)[\t ]*[\r\n]+")
STOP = re.compile(rb"endobj|stream")
#: Texts of values up to so many bytes are kept with what they are read as, so many of them a worker: most files have the same small objects.
SHORT, KEPT = 512, 4096
#: Rows and bytes of a batch that goes back to Spark, and bytes of what is taken of one that came.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 5000, 4_000_000, 2_000_000

#: Filter names, short and long, and their codecs.
FILTERS = {"FlateDecode": "deflate", "Fl": "deflate", "RunLengthDecode": "rle", "RL": "rle", "LZWDecode": "lzw", "LZW": "lzw", "ASCII85Decode": "a85", "A85": "a85", "ASCIIHexDecode": "hex", "AHx": "hex"}


def as_list(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def filters_of(d: dict) -> list[tuple[str, dict]]:
    """Filters with their parameters, which may be fewer."""
    names = as_list(d.get("Filter", d.get("F") if isinstance(d.get("F"), (Name, list)) else None))
    parms = as_list(d.get("DecodeParms", d.get("DP")))
    return [(str(n), p if isinstance(p, dict) else {}) for n, p in zip(names, parms + [None] * len(names))]


def unfiltered(d: dict, data: bytes) -> tuple[bytes, list[tuple[str, dict]]]:
    """The stream decoded as far as its filters are known, and those that are left."""
    chain = filters_of(d)
    while chain and chain[0][0] in FILTERS:
        codec, parms = FILTERS[chain[0][0]], chain[0][1]
        data = codecs.DECODERS[codec](data)
        kind = int(parms.get("Predictor", 1) or 1)
        if kind > 1 and codec in ("deflate", "lzw"):
            columns, colors, bits = (int(parms.get(k, n)) for k, n in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8)))
            data = predictors.unpredict(data, "tiff" if kind == 2 else "png", columns, colors, bits)
        chain = chain[1:]
    return data, chain


def stream_at(data: bytes, at: int, d: dict) -> tuple[bytes, int]:
    """The bytes of a stream whose keyword ends at a place, and the place after it. A direct length counts if it leads to the end; else the end is looked for."""
    if data[at : at + 2] == b"\r\n":
        at += 2
    elif data[at : at + 1] in (b"\n", b"\r"):
        at += 1
    n = d.get("Length")
    if isinstance(n, float) and (m := CLOSED.match(data, at + int(n))):
        return data[at : at + int(n)], m.end()
    end = data.find(b"endstream", at)
    if end < 0:
        raise ParseError(at, "a stream is not closed")
    cut = end - 2 if data[end - 2 : end] == b"\r\n" else end - 1 if data[end - 1 : end] in (b"\n", b"\r") else end
    return data[at : max(at, cut)], end + 9


def embedded(container: int, d: dict, stream: bytes) -> list[tuple[int, Any]]:
    """The (number, value) pairs of an object stream."""
    data, left = unfiltered(d, stream)
    if left:
        raise ParseError(0, f"object stream {container} has an unknown filter")
    first = int(d.get("First", 0))
    index = [int(x) for x in data[:first].split()]
    nums, places = index[::2], [first + offset for offset in index[1::2]]
    out = []
    for num, at, after in zip(nums, places, [*places[1:], len(data)]):
        text = data[at:after].rstrip() if at < after <= at + SHORT else b""
        # A value that closes at its end is read the same with what follows or without.
        out.append((num, kept_value(text) if text[:1] in (b"<", b"[") and text[-1:] in (b">", b"]") and closes(text) else Reader(data, at).value()))
    return out


@lru_cache(KEPT)
def kept_value(text: bytes) -> Any:
    """The value that a short text begins with; not to be changed."""
    return Reader(text).value()


@lru_cache(KEPT)
def closes(text: bytes) -> bool:
    """Whether a text is one value to its end."""
    try:
        r = Reader(text)
        r.value()
        return r.at == len(text)
    except (ValueError, RecursionError):
        return False


def value_of(body: bytes) -> Any:
    """The value of an object's body; not to be changed."""
    return kept_value(body) if len(body) <= SHORT else Reader(body).value()


def xref_entries(reader: Reader) -> list:
    """Subsections of a classic cross-reference table: [start, [[offset, generation, state], ...]]."""
    out = []
    while m := SUBSECTION.match(reader.data, reader.at):
        reader.at = m.end()
        entries = []
        for _ in range(int(m[2])):
            e = ENTRY.match(reader.data, reader.at)
            if e is None:
                raise ParseError(reader.at, "a cross-reference entry was expected")
            entries.append([int(e[1]), int(e[2]), e[3].decode()])
            reader.at = e.end()
            reader.at = AFTER_ENTRY.match(reader.data, reader.at).end()
        out.append([int(m[1]), entries])
    return out


def facts(value: Any) -> tuple:
    """What a row tells of a value: type, subtype, body, the filters if it is a stream's, and references."""
    if isinstance(value, Keyword):
        return None, None, to_bytes(value), [], []
    kind = subtype = None
    filters: list[str] = []
    if isinstance(value, dict):
        kind, subtype = (str(x) if isinstance(x := value.get(k), Name) else None for k in ("Type", "Subtype"))
        filters = [n for n, _ in filters_of(value)]
    return kind, subtype, to_bytes(value), filters, references_of(value)


@lru_cache(KEPT)
def short_value(text: bytes, tail: int) -> tuple | None:
    """(value, facts) of a text that is one value up to the word of so many bytes at its end; None if it is not."""
    r = Reader(text)
    try:
        value = r.value() if not NOTHING.match(text) else None
        r.blank()
        return (value, facts(value)) if r.at == len(text) - tail else None
    except (ValueError, RecursionError):
        return None


def table_body(sections: list) -> bytes:
    """What to_bytes makes of the subsections of a cross-reference table."""
    return b"[%b]" % b"".join(b"[%d[%b]]" % (s, b"".join(b"[%d %d %b]" % (o, g, k.encode()) for o, g, k in e)) for s, e in sections)


def parse(data: bytes) -> list[dict]:
    """All objects of a file in order, and those of its object streams after their container."""
    out: list[dict] = []

    def add(kind: str, offset: int, value: Any = None, num=None, gen=None, stream=None, container=None, error=None, known=None):
        of, subtype, body, filters, named = known or facts(value)
        out.append({
            "pos": len(out), "num": num, "gen": gen, "kind": kind, "offset": offset, "container": container, "error": error, "type": of, "subtype": subtype,
            "body": body, "stream": stream, "filters": filters if stream is not None else None, "refs": named,
        })

    at = 0
    while (at := SPACE.match(data, at).end()) < len(data):
        begin = at
        try:
            if data[at : at + 1] == b"%":
                end = LINE.match(data, at).end()
                line = data[at:end]
                add("version" if line.startswith(b"%PDF-") else "eof" if line.startswith(b"%%EOF") else "comment", begin, Keyword(line.decode("latin-1")))
                at = end
            elif m := OBJECT.match(data, at):
                r = Reader(data, m.end())
                stop = STOP.search(data, r.at, r.at + SHORT)
                if stop and (short := short_value(data[r.at : stop.end()], 6)):
                    value, known = short
                    r.at = stop.start()
                else:
                    value, known = r.value() if not NOTHING.match(data, r.at) else None, None
                    r.blank()
                stream = None
                if data[r.at : r.at + 6] == b"stream" and isinstance(value, dict):
                    stream, r.at = stream_at(data, r.at + 6, value)
                    r.blank()
                num, gen = int(m[1]), int(m[2])
                kind = {"ObjStm": "objstm", "XRef": "xref"}.get(str(value.get("Type"))) if stream is not None else None
                add(kind or ("stream" if stream is not None else "object"), begin, value, num, gen, stream, known=known)
                if kind == "objstm":
                    for inner, v in embedded(num, value, stream):
                        add("object", begin, v, inner, 0, container=num)
                at = r.at + 6 if data[r.at : r.at + 6] == b"endobj" else r.at
            elif data.startswith(b"xref", at):
                r = Reader(data, at + 4)
                add("xreftable", begin, known=(None, None, table_body(xref_entries(r)), [], []))
                at = r.at
            elif data.startswith(b"trailer", at):
                r = Reader(data, at + 7)
                end = data.find(b"startxref", r.at, r.at + SHORT)
                if end > 0 and (short := short_value(data[r.at : end + 9], 9)):
                    add("trailer", begin, known=short[1])
                    at = end
                else:
                    add("trailer", begin, r.value())
                    at = r.at
            elif data.startswith(b"startxref", at):
                r = Reader(data, at + 9)
                add("startxref", begin, r.value())
                at = r.at
            else:
                raise ParseError(at, f"{data[at : at + 10]!r} begins no object")
        except Exception as e:
            add("error", begin, error=f"{type(e).__name__}: {e}")
            more = OBJECT.search(data, begin + 1)  # go on with the next object
            if more is None:
                break
            at = more.start()
    return out


REFS = pa.list_(pa.struct([("num", pa.int64()), ("gen", pa.int64())]))
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<struct<num:long,gen:long>>": REFS}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, _, kind in (f.partition(" ") for f in schema.split(", "))])


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of bounded rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of the same rows as lists, of a few megabytes at a time; a batch is let go before the next is read."""
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield [listed(c) for c in batch.slice(i, step).columns]
        batch = None
        released()


def listed(column: pa.Array) -> list:
    """A column as a list; lists of structs as lists of tuples."""
    if not (pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type)):
        return column.to_pylist()
    offsets = column.offsets.to_pylist()
    inner = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = list(zip(*(inner.field(k).to_pylist() for k in range(inner.type.num_fields))))
    return [rows[i - offsets[0] : j - offsets[0]] for i, j in zip(offsets, offsets[1:])]


def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """(path, rows without it) of each file, from rows that are sorted by path, their first column."""
    path, held = None, []
    for columns in slices(batches):
        for row in zip(*columns):
            if row[0] != path and held:
                yield path, held
                held = []
            path = row[0]
            held.append(row[1:])
    if held:
        yield path, held


def map_files(table: DataFrame, order: list[str], one: Callable[[str, list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of each file: its path, and its rows of the other columns in order. A file is gathered, many go through a task one after another."""

    def run(batches):
        yield from batched((row for path, rows in by_file(batches) for row in one(path, rows)), arrow_schema(schema))

    return table.repartition("path").sortWithinPartitions("path", *order).mapInArrow(run, schema)


def objects(files: DataFrame) -> DataFrame:
    """The objects of files given as (path, content)."""
    schema = arrow_schema(SCHEMA)
    names = schema.names[1:]

    def rows(batches):
        for paths, contents in slices(batches):
            for path, content in zip(paths, contents):
                for r in parse(content):
                    yield (path, *[r[n] for n in names])

    def run(batches):
        yield from batched(rows(batches), schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark.read.format("binaryFile").load(path))


def latest(table: DataFrame) -> DataFrame:
    """Of objects that files define anew, the last."""
    keyed = table.where("num is not null")
    return refs.last_versions(keyed, ["path", "num"], [F.col("pos")], [c for c in table.columns if c not in ("path", "num")])


def references(table: DataFrame) -> DataFrame:
    """(path, src, num, gen): an edge for each reference."""
    return table.select("path", F.col("num").alias("src"), F.explode("refs").alias("r")).select("path", "src", "r.num", "r.gen")


def used(table: DataFrame) -> DataFrame:
    """Objects that some reference names; not reachability. Linearization dictionaries go."""
    named = references(table).select("path", "num", "gen").distinct()
    return table.join(named, ["path", "num", "gen"], "left_semi").where(~F.contains(F.col("body"), F.lit("/Linearized").cast("binary")))


def decoded(body: bytes, stream: bytes | None) -> tuple[bytes | None, str | None]:
    """(value, error) of a stream decoded by the filters that its dictionary names."""
    if stream is None:
        return None, None
    try:
        data, left = unfiltered(value_of(bytes(body)), bytes(stream))
        return data, f"filters left: {', '.join(n for n, _ in left)}" if left else None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def unfiltered_column(body: Column, stream: Column) -> Column:
    """(value, error) of streams decoded by the filters that their dictionaries name."""

    @pandas_udf("value binary, error string")
    def run(b: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(x, y) for x, y in zip(b, s)], columns=["value", "error"])

    return run(body, stream)


def with_data(table: DataFrame) -> DataFrame:
    """Adds data, the decoded stream (or what the unknown filters leave of it), and data_error."""
    got = table.withColumn("dg_d", unfiltered_column(F.col("body"), F.col("stream")))
    return got.withColumn("data", F.col("dg_d.value")).withColumn("data_error", F.col("dg_d.error")).drop("dg_d")


def starts(column: str, head: bytes, at: int = 0) -> Column:
    return F.substring(column, at + 1, len(head)) == F.lit(bytearray(head))


def category() -> Column:
    """What a stream is, by the first sign that holds."""
    return (
        F.when(F.col("subtype") == "XML", "xml").when(F.col("type") == "ObjStm", "objstm").when(F.col("type") == "XRef", "xref")
        .when(starts("data", b"acsp", 36), "icc").when(starts("data", b"\xff\xd8"), "jpeg").when(starts("data", b"\0\0\0\x0cjP  \r\n\x87\n"), "jpeg2000")
        .when(F.col("subtype") == "Image", "bitmap").when(starts("data", b"\0\1\0\0") | starts("data", b"true"), "font").when(F.col("type") == "Metadata", "xml")
        .when((F.col("type") == "Pattern") | (F.col("subtype") == "Form") | F.col("type").isNull(), "vector").otherwise("other")
    )


def category_of(kind: str | None, subtype: str | None, data: bytes | None) -> str:
    """The same as category, of one stream."""
    d = data or b""
    if subtype == "XML":
        return "xml"
    if kind in ("ObjStm", "XRef"):
        return kind.lower()
    if d[36:40] == b"acsp":
        return "icc"
    if d.startswith(b"\xff\xd8"):
        return "jpeg"
    if d.startswith(b"\0\0\0\x0cjP  \r\n\x87\n"):
        return "jpeg2000"
    if subtype == "Image":
        return "bitmap"
    if d.startswith((b"\0\1\0\0", b"true")):
        return "font"
    if kind == "Metadata":
        return "xml"
    return "vector" if kind is None or kind == "Pattern" or subtype == "Form" else "other"


def info(table: DataFrame) -> DataFrame:
    """A line for each object: category, number, offset, stored and decoded size, container, description."""
    d = with_data(table.where("num is not null"))
    what = F.when(F.col("stream").isNull(), "object").otherwise(category())
    return d.select("path", what.alias("category"), "num", "offset", F.octet_length("stream").alias("compressed"), F.octet_length("data").alias("uncompressed"), "container", F.concat_ws("/", "type", "subtype").alias("description"))


CATEGORIES = ("xml", "bitmap", "vector", "font", "jpeg", "jpeg2000", "icc", "objstm", "xref", "other")


def stat(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """A line for each file: streams and bytes of each category, and what is left of its size. sizes: (path, length)."""
    d = with_data(table.where("stream is not null")).withColumn("category", category()).withColumn("n", F.octet_length("stream"))
    own = []
    for c in CATEGORIES:
        mark = F.col("category") == c
        own += [F.count_if(mark).alias(f"{c}_count"), F.coalesce(F.sum(F.when(mark, F.col("n"))), F.lit(0)).alias(f"{c}_size")]
    known = d.groupBy("path").agg(*own, F.sum("n").alias("streams"))
    return sizes.join(known, "path", "left").withColumn("structures", F.col("length") - F.coalesce("streams", F.lit(0))).drop("streams")


def hashes(table: DataFrame) -> DataFrame:
    """The hash of each stored stream, and whether one before it in its file has the same."""
    s = table.where("stream is not null").select("path", "num", "pos", F.sha2("stream", 512).alias("hash"))
    first = s.groupBy("path", "hash").agg(F.min("pos").alias("first"))
    return s.join(first, ["path", "hash"]).select("path", "num", "hash", (F.col("pos") > F.col("first")).alias("is_duplicate"))


def extract(table: DataFrame, num: int) -> DataFrame:
    """(path, data, error): the decoded stream of an object of each file; why there is none else."""
    mine = F.col("num") == num
    last = F.max_by(F.struct("body", "stream", F.lit(1).alias("there")), F.when(mine, F.col("pos"))).alias("last")
    held = table.select("path", "num", "pos", F.when(mine, F.col("body")).alias("body"), F.when(mine, F.col("stream")).alias("stream"))
    got = with_data(held.groupBy("path").agg(last).select("path", "last.*"))
    why = F.when(F.col("there").isNull(), "object not found").when(F.col("stream").isNull(), "object has no stream").otherwise(F.col("data_error"))
    return got.select("path", "data", why.alias("error"))


def get(table: DataFrame, num: int) -> DataFrame:
    """(path, text): an object as text, references replaced by what they name, once on each way down; /Parent is not followed.

    The bodies of a file are gathered, without its streams; those that the object reaches are read.
    """

    def one(path, rows):
        bodies = {n: b for n, _, b in rows}  # of a number's rows the last counts
        values: dict[int, Any] = {}

        def value(n):
            if n not in values:
                values[n] = value_of(bodies[n])
            return values[n]

        def show(v, seen, pad, key=None):
            if isinstance(v, Ref) and key != "Parent" and v.num not in seen and v.num in bodies:
                return show(value(v.num), seen | {v.num}, pad, key)
            inner = pad + "  "
            if isinstance(v, dict):
                return "<<\n" + "".join(f"{inner}/{k} {show(x, seen, inner, k)}\n" for k, x in sorted(v.items())) + pad + ">>"
            if isinstance(v, list):
                return "[" + " ".join(show(x, seen, inner, key) for x in v) + "]"
            return to_bytes(v).decode("latin-1")

        if num in bodies:
            yield path, show(value(num), {num}, "")

    return map_files(table.where("num is not null").select("path", "num", "pos", "body"), ["num", "pos"], one, "path string, text string")


def json_of(value: Any) -> Any:
    """A value as JSON can hold it: names as /name, references as {"$ref": [num, gen]}."""
    if isinstance(value, Ref):
        return {"$ref": list(value)}
    if isinstance(value, Name):
        return "/" + value
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, dict):
        return {k: json_of(v) for k, v in value.items()}
    if isinstance(value, list):
        return [json_of(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def as_json(table: DataFrame, column: str = "json") -> DataFrame:
    """Adds each object's value as JSON text, for variant functions."""


    @pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else json.dumps(json_of(Reader(bytes(b)).value())))

    held = F.when(F.col("kind").isin("object", "stream", "objstm", "xref", "trailer"), F.col("body"))
    return table.withColumn(column, run(held))


def has_key(body: Column, key: str) -> Column:
    """Whether an object is a dictionary with a key."""

    @pandas_udf("boolean")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: x is not None and isinstance(d := Reader(bytes(x)).value(), dict) and key in d)

    return run(body)


def is_info() -> Column:
    return F.col("num").isNotNull() & has_key(F.col("body"), "Author")


def is_catalog() -> Column:
    return F.coalesce(F.col("type") == "Catalog", F.lit(False))


def is_plain() -> Column:
    """An object with a number and no stream: it can be embedded, and stand in an object stream."""
    return F.col("num").isNotNull() & F.col("stream").isNull()


def has_content() -> Column:
    return F.col("stream").isNotNull() & (F.col("kind") != "trailer")


def optimizable() -> Column:
    """Whether all filters of a stream are known."""
    return F.forall(F.coalesce("filters", F.array().cast("array<string>")), lambda f: f.isin(sorted(FILTERS)))


def partition(table: DataFrame) -> dict[str, DataFrame]:
    """Objects with streams, plain objects, and trailers."""
    return {"streams": table.where(has_content()), "plain": table.where(is_plain()), "trailers": table.where("kind = 'trailer'")}


def masks(table: DataFrame) -> DataFrame:
    """(path, num): objects that some dictionary names as its /SMask."""

    @pandas_udf("array<bigint>")
    def named(b: pd.Series) -> pd.Series:
        def one(x):
            found = [] if x is None else [v.num for p, v in walk(Reader(bytes(x)).value()) if p and p[-1] == "SMask" and isinstance(v, Ref) and v.num]
            return sorted(set(found))

        return b.map(one, na_action=None)

    return table.where(F.contains("body", F.lit(bytearray(b"/SMask")))).select("path", F.explode(named("body")).alias("num")).distinct()


def shape(table: DataFrame) -> DataFrame:
    """(path, is_empty, has_version, xref_entries) of each file: whether it has no objects, a header, and the entries of its tables."""

    @pandas_udf("bigint")
    def entries(kind: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([sum(len(part[1]) for part in Reader(bytes(b)).value()) if k == "xreftable" else 0 for k, b in zip(kind, body)], dtype="int64")

    n = entries("kind", "body")
    return table.select("path", "num", "kind", n.alias("n")).groupBy("path").agg((F.count("num") == 0).alias("is_empty"), (F.count_if(F.col("kind") == "version") > 0).alias("has_version"), F.sum("n").alias("xref_entries"))


def put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects (path, num, gen, kind, body, stream) with others in place of those of their numbers, or beside them."""
    columns = ["path", "num", "gen", "kind", "body", "stream"]
    kept = table.select(*columns).join(rows.select("path", "num").distinct(), ["path", "num"], "left_anti")
    return kept.unionByName(rows.select(*columns))


def put_new(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Objects with further ones (path, body, stream and the order's columns), numbered after the last of their file."""
    last = table.groupBy("path").agg(F.max("num").alias("dg_last"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    new = rows.join(last, "path", "left").withColumn("num", (F.coalesce("dg_last", F.lit(0)) + place).cast("bigint"))
    kind = F.when(F.col("stream").isNull(), "object").otherwise("stream")
    return put(table, new.select("path", "num", F.lit(0).cast("bigint").alias("gen"), kind.alias("kind"), "body", "stream"))


def merged_contents(table: DataFrame) -> DataFrame:
    """Objects in which each page with several content streams has one new stream instead: their decoded data in order, a space before each.

    A page with a stream that can't be decoded, or that is missing, stays as it is. A page's streams are gathered, not a file's.
    """
    own = refs.written(with_data(latest(table)).where("kind not in ('objstm', 'xref')"))

    @pandas_udf("array<bigint>")
    def parts_of(body: pd.Series) -> pd.Series:
        def one(b):
            d = Reader(bytes(b)).value()
            held = d.get("Contents") if isinstance(d, dict) else None
            return [x.num for x in held] if isinstance(held, list) and len(held) > 1 and all(isinstance(x, Ref) for x in held) else []

        return body.map(one)

    pages = own.where("type = 'Page'").select("path", F.col("num").alias("page"), F.posexplode(parts_of("body")).alias("at", "num"))
    streams = own.where("stream is not null and data is not null and data_error is null").select("path", "num", "data")
    met = pages.join(streams, ["path", "num"], "left").groupBy("path", "page").agg(F.count(F.lit(1)).alias("n"), F.count("data").alias("known"), F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("20"), F.hex(p["data"]))), ""))
    new = met.where("n = known").select("path", "page", whole.alias("stream"))
    new = new.withColumn("body", F.concat(F.lit("<</Length "), F.octet_length("stream").cast("string"), F.lit(">>")).cast("binary"))
    added = put_new(own, new, ["page"])
    # The page of the n-th new stream of a file names it.
    last = own.groupBy("path").agg(F.max("num").alias("dg_last"))
    to = new.join(last, "path").select("path", F.col("page").alias("num"), (F.col("dg_last") + F.row_number().over(Window.partitionBy("path").orderBy("page"))).alias("to"))

    @pandas_udf("binary")
    def pointed(body: pd.Series, to: pd.Series) -> pd.Series:
        return pd.Series([b if t != t or t is None else to_bytes(Reader(bytes(b)).value() | {"Contents": Ref(int(t), 0)}) for b, t in zip(body, to)])

    return added.join(to, ["path", "num"], "left").select("path", "num", "gen", "kind", pointed("body", "to").alias("body"), "stream")


def shorter_data(kind: str | None, value: dict, data: bytes) -> tuple[dict, bytes]:
    """A decoded stream by its category: content rewritten, white space between tags gone, removable tables of fonts gone, RGB of equal components as gray."""
    try:
        if kind == "vector":
            return value, content.shortest(data)
        if kind == "xml":
            return value, re.sub(rb">\s+<", b"><", data)
        if kind == "font":
            scaler, tables = fonts.parse(data)
            return value, min(data, fonts.build(scaler, fonts.without(tables)), key=len)
        if kind == "bitmap" and value.get("ColorSpace") == "DeviceRGB" and value.get("BitsPerComponent") == 8 and data and not {"SMask", "Mask", "Decode"} & set(value) and predictors.only_gray(data):
            return value | {"ColorSpace": Name("DeviceGray")}, predictors.to_gray(data)
    except ValueError:
        pass  # what can't be read stays
    return value, data


def cheapest_stream(d: dict, data: bytes) -> tuple[dict, bytes]:
    """A decoded stream encoded by the cheapest of: none, deflate, run lengths, run lengths and deflate, and predictors where the rows are known."""
    keep = {k: v for k, v in d.items() if k not in ("Filter", "DecodeParms", "Length")}
    deflate, rle = codecs.ENCODERS["deflate"], codecs.ENCODERS["rle"]
    options: list[tuple[list[str], dict | None, bytes]] = [([], None, data), (["FlateDecode"], None, deflate(data)), (["RunLengthDecode"], None, rle(data)), (["FlateDecode", "RunLengthDecode"], None, deflate(rle(data)))]
    width, bits = d.get("Width"), d.get("BitsPerComponent")
    colors = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(str(d.get("ColorSpace")))
    if isinstance(width, float) and bits == 8 and colors and data and len(data) % predictors.row_size(int(width), colors) == 0:
        parms = {"Columns": width, "Colors": float(colors), "BitsPerComponent": 8.0}
        options.append((["FlateDecode"], parms | {"Predictor": 15.0}, deflate(predictors.predict(data, "optimum", int(width), colors))))
        options.append((["FlateDecode"], parms | {"Predictor": 2.0}, deflate(predictors.tiff_predict(data, int(width), colors))))

    def whole(option):
        names, parms, raw = option
        out = dict(keep)
        if names:
            out["Filter"] = Name(names[0]) if len(names) == 1 else [Name(n) for n in names]
        if parms:
            out["DecodeParms"] = parms
        out["Length"] = float(len(raw))
        return out, raw

    return min((whole(o) for o in options), key=lambda x: len(to_bytes(x[0])) + len(x[1]))


def optimize(table: DataFrame) -> DataFrame:
    """(path, num, gen, kind, body, stream): objects without duplicates and unused ones, references to the kept, numbers rounded, strings plain, streams rewritten by what they are and at their cheapest.

    The objects of a file are gathered, its streams as they are stored and one at a time decoded.
    """

    def one(path, rows):
        last = {r[0]: r for r in rows if r[0] is not None}  # of a number's rows the last counts
        first: dict[tuple[bytes, bytes], int] = {}
        to: dict[int, int] = {}
        for num, _, _, kind, _, _, body, stream in last.values():  # in order of numbers
            if kind not in (None, "objstm", "xref") and stream is not None and (data := decoded(body, stream)[0]) is not None:
                kept = first.setdefault((hashlib.sha256(data).digest(), hashlib.sha256(body).digest()), num)
                if kept != num:
                    to[num] = kept
        named = {x.num for r in rows if r[3] in ("trailer", "xref") for x in references_of(value_of(r[6]))}
        done = []
        for num, _, gen, kind, of, subtype, body, stream in last.values():
            if kind in (None, "objstm", "xref") or num in to:
                continue
            value = reduced(deep_map(value_of(body), lambda _, x: Ref(to[x.num], 0) if isinstance(x, Ref) and x.num in to else plain_string(x)))
            if stream is not None and isinstance(value, dict):
                data, error = decoded(body, stream)
                if data is not None and error is None:
                    better, raw = cheapest_stream(*shorter_data(category_of(of, subtype, data), value, data))
                    if len(to_bytes(better)) + len(raw) < len(to_bytes(value)) + len(stream):
                        value, stream = better, raw
            named.update(x.num for x in references_of(value))
            done.append((path, num, gen, kind, to_bytes(value), stream))
        yield from (r for r in done if r[1] in named)

    rows = table.where("num is not null or kind in ('trailer', 'xref')").select("path", "num", "pos", "gen", "kind", "type", "subtype", "body", "stream")
    return map_files(rows, ["num", "pos"], one, "path string, num long, gen long, kind string, body binary, stream binary")


def object_stream(num: int, items: list[tuple[int, bytes]]) -> tuple[dict, bytes]:
    """The dictionary and the stream, deflated, of an object stream of these (number, body)."""
    index, at = [], 0
    for n, body in items:
        index.append(b"%d %d" % (n, at))
        at += len(body) + 1
    head = b" ".join(index) + b"\n"
    raw = codecs.ENCODERS["deflate"](head + b"\n".join(body for _, body in items))
    return {"Type": Name("ObjStm"), "N": float(len(items)), "First": float(len(head)), "Filter": Name("FlateDecode"), "Length": float(len(raw))}, raw


def xref_stream(entries: dict[int, tuple[int, int, int]], trailer: dict) -> tuple[dict, bytes]:
    """The dictionary and the stream, deflated, of a cross-reference stream: (type, field, field) by number, gaps free; with the trailer's entries."""
    size = max(entries, default=0) + 1
    rows = [entries.get(n, (0, 0, 65535 if n == 0 else 0)) for n in range(size)]
    widths = [1, *(max(1, (max(r[i] for r in rows).bit_length() + 7) // 8) for i in (1, 2))]
    raw = codecs.ENCODERS["deflate"](b"".join(x.to_bytes(w, "big") for r in rows for x, w in zip(r, widths)))
    kept = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    return kept | {"Type": Name("XRef"), "W": [float(w) for w in widths], "Index": [0.0, float(size)], "Size": float(size), "Filter": Name("FlateDecode"), "Length": float(len(raw))}, raw


#: Objects in one object stream at most.
EMBEDDED = 200


def file_bytes(items: list[tuple[int, int, bytes, bytes | None]], found: bytes | None, compact: bool) -> bytes:
    """A whole file of objects (num, gen, body, stream) in order of numbers and of a trailer's body."""
    out, offsets = bytearray(b"%PDF-1.7\n%\xb5\xb5\xb5\xb5\n"), {}
    trailer = value_of(found) if found is not None else {}
    if compact:
        entries, last = {}, max(n for n, *_ in items)
        plain = [(n, body) for n, gen, body, raw in items if raw is None and not gen]
        streams = [x for x in items if x[3] is not None or x[1]]
        for i in range(0, len(plain), EMBEDDED):
            last += 1
            some = plain[i : i + EMBEDDED]
            entries |= {n: (2, last, k) for k, (n, _) in enumerate(some)}
            d, raw = object_stream(last, some)
            streams.append((last, 0, to_bytes(d), raw))
        for n, gen, body, raw in streams:
            entries[n] = (1, len(out), gen)
            out += b"%d %d obj\n" % (n, gen) + body + (b"" if raw is None else b"\nstream\n" + raw + b"\nendstream") + b"\nendobj\n"
        entries[last + 1] = (1, len(out), 0)
        at = len(out)
        d, raw = xref_stream(entries, trailer)
        out += b"%d 0 obj\n" % (last + 1) + to_bytes(d) + b"\nstream\n" + raw + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(out)
    for n, gen, body, raw in items:
        offsets[n] = len(out)
        out += b"%d %d obj\n" % (n, gen) + body
        if raw is not None:
            out += b"\nstream\n" + raw + b"\nendstream"
        out += b"\nendobj\n"
    size, at = max(offsets, default=0) + 1, len(out)
    free = [n for n in range(size) if n not in offsets]
    following = dict(zip(free, [*free[1:], 0]))
    out += b"xref\n0 %d\n" % size
    for n in range(size):
        out += b"%010d 00000 n\r\n" % offsets[n] if n in offsets else b"%010d 65535 f\r\n" % following[n]
    trailer = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")} | {"Size": float(size)}
    out += b"trailer\n" + to_bytes(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def assemble(table: DataFrame, trailers: DataFrame | None = None, compact: bool = False) -> DataFrame:
    """(path, content): whole files of objects (path, num, gen, body, stream) and trailers (path, kind, pos, body): each file's last trailer counts.

    Objects stand in order of numbers, then a cross-reference table with free entries for the numbers that are missing. Compact files have
    their plain objects in object streams, and a cross-reference stream. Without trailers, those among the table's rows count, so that it is read once.
    """
    place = F.when(F.col("kind").isin("trailer", "xref"), F.coalesce(F.col("pos").cast("bigint"), F.lit(-1)))
    columns = ["path", F.col("num").cast("bigint").alias("num"), F.col("gen").cast("bigint").alias("gen"), "body", "stream"]
    if trailers is None:
        rows = table.select(*columns, place.alias("place")).where("num is not null or place is not null")
    else:
        none = lambda kind: F.lit(None).cast(kind)
        last = trailers.select("path", none("bigint").alias("num"), none("bigint").alias("gen"), "body", none("binary").alias("stream"), place.alias("place"))
        rows = table.select(*columns, none("bigint").alias("place")).unionByName(last.where("place is not null"))

    def one(path, rows):
        items = [r[:4] for r in rows if r[0] is not None]
        if items:
            yield path, file_bytes(items, max(((r[4], r[2]) for r in rows if r[4] is not None), default=(0, None))[1], compact)

    return map_files(rows, ["num"], one, "path string, content binary")


def assembled(rows: DataFrame, compact: bool = False) -> DataFrame:
    """As assemble, of files whose objects stand together: (path, objects, trailer), an array of (num, gen, body, stream) and the trailer's body."""
    schema = arrow_schema("path string, content binary")

    def files(batches):
        for columns in slices(batches):
            for path, items, trailer in zip(*columns):
                if items:
                    yield path, file_bytes(sorted(items, key=lambda x: x[0]), trailer, compact)

    def run(batches):
        yield from batched(files(batches), schema)

    objects = F.transform("objects", lambda o: F.struct(*[o[k].alias(k) for k in ("num", "gen", "body", "stream")]))
    return rows.select("path", objects.alias("objects"), "trailer").mapInArrow(run, "path string, content binary")


def duplicates(table: DataFrame) -> DataFrame:
    """Groups of decoded streams that stand more than once in all files."""
    d = with_data(table.where("stream is not null")).select(F.struct("path", "num").alias("key"), "data")
    return dedup.content_groups(d, "key", "data")
