"""WARC 1.1 archives: a writer in DataFrame operations and a reader as a Python data source.

The reader plans partitions of whole files, reads record headers first, and steps over the payloads of records that pushed
down predicates on record type or headers reject, without reading or decoding them. `spark.read.format("warc")` takes the
options `payload` (false: never read payloads) and `partitionBytes`.

The writer makes one response record for each page, or a revisit record (identical payload digest) where another page with
the same payload of at least MIN_REVISIT bytes is kept as response. Records are written by Spark's own text writer, so any
store that Spark writes to will do, and a task that is run again leaves no half file. Null html is an empty payload, a
null url gives no target URI; rows without a page_id revisit others but are revisited by none. Repeated rows give records
each.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .common import opened, saved, scratch, ship

MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:"
#: Columns that are known from headers alone, and the header each comes from.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_OF) + ", content_length long, http_length long, payload binary, path string, offset long"


@dataclass
class Files(InputPartition):
    paths: list[str]


def accepts(f: Filter, row: dict) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    if isinstance(f, LessThan):
        return value < f.value
    return value <= f.value


def skip(file, n: int, plain: bool, size: int | None = None) -> None:
    """Step over n bytes; size is that of a plain file, beyond whose end nothing can be stepped over."""
    if plain:
        if size is not None and file.tell() + n > size:
            raise ValueError("the archive ends inside a record")
        file.seek(n, io.SEEK_CUR)
        return
    while n:
        n -= len(part := file.read(min(n, 1 << 20)))
        if not part:
            raise ValueError("the archive ends inside a record")


def exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the archive ends inside a record")
    return data


def headers(file, most: int | None = None) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line or most bytes, and the bytes taken; names in lower case, continued lines joined."""
    out: dict[str, str] = {}
    name, taken = None, 0
    while most is None or taken < most:
        raw = file.readline(-1 if most is None else most - taken)
        taken += len(raw)
        line = raw.rstrip(b"\r\n")
        if not line:
            break
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out, taken


def records(file, plain: bool, filters: tuple = (), payload: bool = True) -> Iterator[dict]:
    """Records of one archive whose headers pass the filters. Payloads of others, or all without payload, are stepped over.

    The payload of an HTTP response is what follows its status line and fields, inside the record; of all other records it is the whole
    block, so that of a request has its first line.
    """
    at, size = 0, None
    if plain:
        at = file.tell()
        size = file.seek(0, io.SEEK_END)
        file.seek(at)
    while True:
        at = file.tell()
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            at = file.tell()
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}: {line[:40]!r}")
        found, _ = headers(file)
        if not found.get("content-length", "").isdigit():
            raise ValueError(f"the record at byte {at} has no length")
        left = int(found["content-length"])
        row = {c: found.get(h) for c, h in HEADER_OF.items()} | {"content_length": left, "offset": at}
        if not all(accepts(f, row) for f in filters):
            skip(file, left, plain, size)
            continue
        row["http_length"], first = None, b""
        if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
            first = file.readline(left) if left else b""
            left -= len(first)
            if first.startswith(b"HTTP/"):
                sent, taken = headers(file, left)
                first, left = b"", left - taken
                row["http_length"] = int(sent["content-length"]) if sent.get("content-length", "").isdigit() else None
        if payload:
            row["payload"] = first + exactly(file, left)
        else:
            row["payload"] = None
            skip(file, left, plain, size)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionBytes", str(64 << 20)))
        self.filters: tuple = ()

    def pushFilters(self, filters):
        taken = []
        for f in filters:
            simple = isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if simple and len(f.attribute) == 1 and f.attribute[0] in (*HEADER_OF, "content_length"):
                taken.append(f)
            else:
                yield f
        self.filters = tuple(taken)

    def partitions(self):
        from pyarrow import fs

        system, inside = opened(self.path)
        info = system.get_file_info(inside)
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.most:
                out.append(Files(held))
                held, size = [], 0
            held, size = [*held, prefix + path], size + n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string()] * len(HEADER_OF) + [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        for path in partition.paths:
            system, inside = opened(path)
            with system.open_input_file(inside) as raw:
                magic = raw.read(2)
                raw.seek(0)
                plain = magic != b"\x1f\x8b"
                file = io.BufferedReader(raw, 1 << 18) if plain else gzip.GzipFile(fileobj=raw)
                rows, size = [], 0
                for row in records(file, plain, self.filters, self.payload):
                    row["path"] = path
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """One archive file a partition under path.

    Which page of equal payloads is kept is decided on digests alone. The table of digests that stand more than once
    is written and then joined by its known size: broadcast below the session's threshold, else dealt by digest, where
    AQE splits a digest that very many pages share.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    groups = own.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("rows"))
    groups = saved(groups.where("rows > 1 and kept is not null").select(F.col("digest").alias("shared"), "kept"), "payloads")
    joined = own.join(groups, (F.col("digest") == F.col("shared")) & (F.col("n") >= min_revisit), "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    line = "\r\n"
    urn = lambda x: F.concat(F.lit(RECORD_ID), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    # A target URI holds no white space or control characters; they are percent-encoded.
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\t", "%09"), " ", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n").cast("string"), F.lit(line + line))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n"))
    record = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit(f"{line}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: "), urn(F.col("kept")))).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: application/http;msgtype=response{line}Content-Length: "),
        size.cast("string"),
        F.lit(line + line),
        http,
        F.when(again, F.lit("")).otherwise(F.col("html")),
        F.lit("\r\n\r"),  # the writer ends the row with \n
    )
    joined.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def page_of(record_id):
    return F.regexp_extract(record_id, f"^{RECORD_ID}(-?[0-9]+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read whole and their digests computed anew; of revisits only headers are read.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    write_warc(pages, path)
    back = spark.read.format("warc").load(path).where("record_type = 'response'")
    responses = back.select(page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    revisits = revisits.select(page_of(F.col("record_id")).alias("page_id"), F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    return responses.unionByName(revisits)
